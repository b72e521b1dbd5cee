"""Inventories of drug names in labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.functions.ranking import percent
from corbel.functions.text import description_name, norm_name, title_names
from corbel.operators.ordered import sorted_set


def chunk_names(chunks: DataFrame) -> DataFrame:
    """(chunk, spl_set_id, kind, name): each chunk's brand and generic names, each once per kind.

    ``chunks`` has chunk_id, spl_set_id, and brand_names and generic_names as arrays.
    """
    rows = None
    for kind in ("brand", "generic"):
        one = chunks.where("spl_set_id is not null and spl_set_id <> ''").select("chunk_id", "spl_set_id", F.lit(kind).alias("kind"), F.explode(f"{kind}_names").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("chunk_id", "spl_set_id", "kind", norm_name("n").alias("name")).where("name is not null").distinct()


def name_inventory(found: DataFrame) -> DataFrame:
    """Per name: chunks that have it, and labels, counted for each kind."""
    hits = found.groupBy("name").agg(F.count("*").alias("total_chunk_hits"))
    labels = found.select("spl_set_id", "kind", "name").distinct().groupBy("name").agg(F.count("*").alias("unique_spl_count"))
    return labels.join(hits, "name").select(F.col("name").alias("name_norm"), F.lit("mixed").alias("name_type"), "total_chunk_hits", "unique_spl_count").orderBy(F.desc("unique_spl_count"), "name_norm")


def label_names(found: DataFrame) -> DataFrame:
    """Per label: its brand and generic names, sorted."""
    pick = lambda k: sorted_set(F.when(F.col("kind") == k, F.col("name")))
    return found.groupBy("spl_set_id").agg(pick("brand").alias("brand_names_norm"), pick("generic").alias("generic_names_norm"))


def master_names(labels: DataFrame) -> DataFrame:
    """(spl_set_id, kind, name) told by titles, and by descriptions where the title tells no generic name."""
    brand, generic = title_names("title")
    rows = labels.select("spl_set_id", brand.alias("brand"), F.coalesce(generic, description_name("description")).alias("generic")).where("spl_set_id <> ''")
    pair = F.explode(F.array(F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("name")), F.struct(F.lit("generic").alias("kind"), F.col("generic").alias("name"))))
    return rows.select("spl_set_id", pair.alias("n")).select("spl_set_id", "n.kind", "n.name").where("name is not null")


def name_counts(found: DataFrame) -> DataFrame:
    """Per kind and name the number of records."""
    return found.groupBy("kind", "name").agg(F.count("*").alias("unique_spl_count")).select(F.col("name").alias("name_norm"), F.col("kind").alias("name_type"), "unique_spl_count").orderBy(F.desc("unique_spl_count"), "name_norm", "name_type")


def coverage(labels: DataFrame, found: DataFrame) -> DataFrame:
    """How many labels there are, and how many of them have a name."""
    every = labels.select("spl_set_id", F.lit(None).cast("string").alias("named")).unionByName(found.select("spl_set_id", F.col("spl_set_id").alias("named")))
    return every.agg(F.count_distinct("spl_set_id").alias("labels"), F.count_distinct("named").alias("named")).withColumn("coverage", percent("named", "labels"))
