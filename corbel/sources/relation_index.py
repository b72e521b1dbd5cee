"""Relations, attributes and names of drugs as bucketed tables, written once and looked up without a shuffle of their own.

A lookup joins the drugs asked for with a table that is already dealt by its
key, so only what is asked moves, however large the table; what is found lies
by its key, so that grouping it moves nothing either.  In a table where a key
has more than CROWD rows, such keys lie in several parts, each in a bucket of
its own; how many is kept beside the table, and the asking side is repeated
once for each part.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators import drugs
from corbel.operators.ordered import last_rows

#: Rows of one key in one bucket, on the average, at most.
CROWD = 100_000
#: Bytes of names that may go to every task, 64 a row besides the text; of more, those asked for are looked up first.
FEW_NAMES = 64_000_000


def _by(table: dict) -> list[str]:
    """The columns that a table is dealt by; indexes written before it was kept are dealt by both."""
    return table.get("by", [table["key"], "part"])


@dataclass
class RelationIndex:
    """An index below ``path`` that ``build`` wrote or ``load`` opened."""

    spark: SparkSession
    path: str
    tables: dict[str, dict]

    @classmethod
    def build(cls, path: str, relations: DataFrame, names: DataFrame, attributes: DataFrame, buckets: int | None = None) -> RelationIndex:
        """Write an index to a folder that doesn't exist yet.

        ``relations`` has src_rxcui, rela, dst_rxcui and sab, ``names`` rxcui,
        preferred_term and tty, ``attributes`` rxcui, atn and atv.  Relations
        and attributes count once, of repeated names one; rows whose key is
        null are found by nobody and left out.  Buckets are the session's
        shuffle partitions unless given.
        """
        index = cls(relations.sparkSession, path.rstrip("/"), {})
        n = buckets or int(index.spark.conf.get("spark.sql.shuffle.partitions"))
        index._write("relations", relations.select("src_rxcui", "rela", "dst_rxcui", "sab"), "src_rxcui", n)
        index._write("attributes", attributes.select("rxcui", "atn", "atv"), "rxcui", n)
        single = last_rows(names.withColumn("ord", F.struct("preferred_term", "tty")), ["rxcui"])
        index._write("names", single.select("rxcui", F.col("preferred_term").alias("name"), "tty"), "rxcui", n, single=True)
        # The manifest comes last: an index without it isn't one.
        index.spark.createDataFrame([(json.dumps(index.tables),)], "tables string").coalesce(1).write.parquet(f"{index.path}/manifest")
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RelationIndex:
        """Open an index, also one that another session wrote."""
        path = path.rstrip("/")
        index = cls(spark, path, json.loads(spark.read.parquet(f"{path}/manifest").first()["tables"]))
        for name, t in index.tables.items():
            columns = ", ".join(f"`{c}` {k}" for c, k in t["columns"])
            by = ", ".join(f"`{c}`" for c in _by(t))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {index._table(name)} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {t['buckets']} BUCKETS LOCATION '{path}/{name}'")
        return index

    def forget(self) -> None:
        """Take the tables out of the session's catalog; the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")

    def _table(self, name: str) -> str:
        return f"corbel_{hashlib.sha1(self.path.encode()).hexdigest()[:16]}_{name}"

    def _write(self, name: str, rows: DataFrame, key: str, buckets: int, single: bool = False) -> None:
        """Write the distinct ``rows``, or, if there is a ``single`` one of each key, the rows as they are."""
        rows = rows.where(F.col(key).isNotNull())
        by, placed = [key], rows
        if not single:
            # Repeats count here, so that no key brings more rows than that to its bucket.
            sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1")
            sizes.write.parquet(f"{self.path}/{name}_crowded")
            sizes = self.spark.read.schema(sizes.schema).parquet(f"{self.path}/{name}_crowded")
            if not sizes.isEmpty():
                # A crowded key may be one row many times over: repeats go before rows are dealt by key.
                by = [key, "part"]
                placed = rows.distinct().join(sizes, key, "left").withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        # Each task has one bucket and writes one file.
        dealt = placed.repartition(buckets, *by)
        if not single and by == [key]:
            # Equal rows lie in one bucket, so this shuffles nothing.
            dealt = dealt.distinct()
        dealt.write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{self.path}/{name}").saveAsTable(self._table(name))
        self.tables[name] = {"key": key, "by": by, "buckets": buckets, "columns": [[f.name, f.dataType.simpleString()] for f in placed.schema.fields]}
        if single:
            table = self.spark.table(self._table(name))
            self.tables[name]["bytes"] = table.agg(F.sum(F.octet_length(F.concat_ws("", *table.columns)) + 64)).first()[0] or 0

    def _found(self, name: str, asked: DataFrame) -> DataFrame:
        """The rows of a table whose key is in ``asked``'s column of that name."""
        key, by = self.tables[name]["key"], _by(self.tables[name])
        ids = asked.select(F.col(key).cast("string").alias(key)).distinct()
        if "part" in by:
            sizes = self.spark.read.schema(f"`{key}` string, parts int").parquet(f"{self.path}/{name}_crowded")
            parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
            ids = ids.join(sizes, key, "left").select(key, F.explode(parts).alias("part"))
        return ids.join(self.spark.table(self._table(name)), by).drop("part")

    def _names_of(self, rows: DataFrame) -> DataFrame:
        """dst_rxcui, name and tty of what ``rows`` lead to; of few names all of them."""
        size = self.tables["names"].get("bytes")
        if size is not None and size <= FEW_NAMES and not self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
            return F.broadcast(self.spark.table(self._table("names")).select(F.col("rxcui").alias("dst_rxcui"), "name", "tty"))
        return self._found("names", rows.select(F.col("dst_rxcui").alias("rxcui"))).withColumnRenamed("rxcui", "dst_rxcui")

    def related(self, asked: DataFrame, kinds: list[str] | None = None, source: str = "RXNORM") -> DataFrame:
        """src_rxcui, rela, dst_rxcui, sab, name and tty of the relations of ``asked``'s rxcui, of some kinds or all; name is null where nothing is so called."""
        rows = self._found("relations", asked.select(F.col("rxcui").alias("src_rxcui"))).where(F.upper("sab") == source.upper())
        if kinds is not None:
            rows = rows.where(F.col("rela").isin(kinds))
        return rows.join(self._names_of(rows), "dst_rxcui", "left").select("src_rxcui", "rela", "dst_rxcui", "sab", "name", "tty")

    def attributes(self, asked: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        """rxcui, atn and atv of the attributes of ``asked``'s rxcui, of some kinds or all."""
        rows = self._found("attributes", asked)
        return rows if kinds is None else rows.where(F.upper("atn").isin([k.upper() for k in kinds]))

    def enrich(self, asked: DataFrame) -> DataFrame:
        """What ``drugs.enrich`` gives for ``asked`` (rxcui and preferred_term), from the index."""
        return drugs.enriched(asked, self.related(asked, list(drugs.RELATED)), drugs.attribute_arrays(self.attributes(asked)))
