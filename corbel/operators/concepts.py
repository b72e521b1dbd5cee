"""Concept terminology: release tables to aggregated concepts and their chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel import constants as K
from corbel.functions.keys import blake2s_of_json, iso_date, short_sha1, short_sha256
from corbel.functions.text import clean_term, fold_ascii, literal_map, strip_tag, tokens_estimate
from corbel.operators.ordered import compact_text_set, last_rows, newest_rows, ordered_list

_CONTENT = "relationship_id effective_time active module_id sourceId destinationId relationshipGroup typeId characteristicTypeId modifierId".split()


def concept_rows(rf2: DataFrame, run_ts: str) -> DataFrame:
    status = F.when(F.col("definitionStatusId") == K.DEFINED, "defined").when(F.col("definitionStatusId") == K.PRIMITIVE, "primitive").otherwise("unknown")
    out = rf2.select(
        F.concat(F.lit("snomed:concept:"), "id").alias("doc_id"), F.col("id").alias("snomed_id"), F.lit("Concept").alias("table"), iso_date("effectiveTime").alias("effective_time"), (F.col("active") == "1").alias("active"),
        F.col("moduleId").alias("module_id"), "definitionStatusId", status.alias("definition_status"), F.lit("snomed_ct").alias("source"), F.lit(run_ts).alias("last_ingested"), "ord",
    )
    return out.withColumn("record_hash", short_sha256(F.to_json(F.struct(*[c for c in out.columns if c != "ord"]))))


def description_rows(rf2: DataFrame, run_ts: str, lang: str | None = None, only_active: bool = False) -> DataFrame:
    rows = rf2
    if lang:
        rows = rows.where(F.col("languageCode") == lang)
    if only_active:
        rows = rows.where("active = '1'")
    kind = F.when(F.col("typeId") == K.FSN, "fsn").when(F.col("typeId") == K.SYNONYM, "synonym").when(F.col("typeId") == K.TEXT_DEFINITION, "textdef").otherwise("other")
    case = F.coalesce(literal_map(K.CASE_BY_ID)[F.trim("caseSignificanceId")], literal_map(K.CASE_BY_LABEL)[F.upper(F.trim("caseSignificanceId"))], F.lit("unknown"))
    out = rows.select(
        F.concat(F.lit("snomed:desc:"), "id").alias("doc_id"), F.lit("Description").alias("table"), F.col("id").alias("description_id"), "conceptId", iso_date("effectiveTime").alias("effective_time"), (F.col("active") == "1").alias("active"),
        F.col("moduleId").alias("module_id"), "languageCode", "typeId", kind.alias("kind"), clean_term("term").alias("term"), F.trim("caseSignificanceId").alias("caseSignificanceId"), case.alias("case_significance"),
        F.lit("snomed_ct").alias("source"), F.lit(run_ts).alias("last_ingested"), "ord",
    )
    out = out.withColumn("term_folded", fold_ascii("term"))
    return out.withColumn("record_hash", short_sha256(F.to_json(F.struct(*[c for c in out.columns if c != "ord"]))))


def relationship_rows(rf2: DataFrame, run_ts: str, only_active: bool = False, types: list[str] | None = None) -> DataFrame:
    """The hash covers what a relationship says, not when it was read."""
    out = rf2.select(
        F.concat(F.lit("snomed:rel:"), F.trim("id")).alias("doc_id"), F.lit("Relationship").alias("table"), F.trim("id").alias("relationship_id"), iso_date("effectiveTime").alias("effective_time"), (F.trim("active") == "1").alias("active"),
        F.trim("moduleId").alias("module_id"), F.trim("sourceId").alias("sourceId"), F.trim("destinationId").alias("destinationId"), F.coalesce(F.expr("try_cast(nullif(relationshipGroup, '') as int)"), F.lit(0)).alias("relationshipGroup"),
        F.trim("typeId").alias("typeId"), F.trim("characteristicTypeId").alias("characteristicTypeId"), F.trim("modifierId").alias("modifierId"), "ord",
    )
    if only_active:
        out = out.where("active")
    if types:
        out = out.where(F.col("typeId").isin(types))
    out = out.withColumn("is_a", F.col("typeId") == K.IS_A).withColumn("source", F.lit("snomed_ct")).withColumn("last_ingested", F.lit(run_ts))
    return out.withColumn("record_hash", blake2s_of_json(F.to_json(F.struct(*_CONTENT))))


def latest_concepts(concepts: DataFrame, include_inactive: bool = False) -> DataFrame:
    """The newest row of each concept; only then inactive ones go."""
    newest = newest_rows(concepts, ["snomed_id"], "effective_time")
    return newest if include_inactive else newest.where(F.coalesce("active", F.lit(True)))


def terms(descriptions: DataFrame) -> DataFrame:
    """Per concept: its newest full name, and its synonyms, newest of each spelling, in order of first appearance."""
    rows = descriptions.where(F.coalesce("active", F.lit(True)) & (F.col("term") != ""))
    term = F.struct(F.col("description_id").alias("id"), "term", F.col("languageCode").alias("lang"))
    full = newest_rows(rows.where("kind = 'fsn'"), ["conceptId"], "effective_time").select("conceptId", term.alias("fsn"))
    syn = rows.where("kind = 'synonym'")
    begin = syn.groupBy("conceptId", "term", "languageCode").agg(F.min("ord").alias("first"))
    newest = newest_rows(syn, ["conceptId", "term", "languageCode"], "effective_time").join(begin, ["conceptId", "term", "languageCode"])
    lists = newest.groupBy("conceptId").agg(ordered_list(term, F.col("first"), distinct=False).alias("synonyms"))
    return full.join(lists, "conceptId", "full")


def parents(relationships: DataFrame, characteristic: str = K.INFERRED) -> DataFrame:
    """Per concept: the newest is-a row to each parent, and the parents' ids sorted."""
    rows = relationships.where(F.coalesce("active", F.lit(True)) & ((F.col("typeId") == K.IS_A) | F.col("is_a")) & (F.col("characteristicTypeId") == characteristic))
    newest = newest_rows(rows, ["sourceId", "destinationId"], "effective_time")
    listed = F.sort_array(F.collect_list(F.struct("destinationId", "effective_time", F.col("module_id").alias("moduleId"))))
    return newest.groupBy(F.col("sourceId").alias("conceptId")).agg(listed.alias("parents")).withColumn("parent_ids", F.transform("parents", lambda p: p["destinationId"]))


def aggregate(concepts: DataFrame, descriptions: DataFrame, relationships: DataFrame, run_ts: str, include_stated: bool = False, include_inactive: bool = False) -> DataFrame:
    """One document per concept: terms, hierarchy, and a hash.

    Without any concept row, concepts are made from the descriptions and parents.
    """
    base = latest_concepts(concepts, include_inactive).select(F.col("snomed_id").alias("conceptId"), "active", F.col("module_id").alias("moduleId"), "definitionStatusId", "effective_time")
    names, inferred = terms(descriptions), parents(relationships)
    if base.isEmpty():
        ids = names.select("conceptId").union(inferred.select("conceptId")).distinct()
        base = ids.select("conceptId", F.lit(True).alias("active"), *[F.lit("").alias(c) for c in ("moduleId", "definitionStatusId", "effective_time")])
    out = base.join(names, "conceptId", "left").join(inferred, "conceptId", "left")
    default = F.when(F.col("fsn").isNotNull(), F.create_map(F.lit("default"), F.struct(F.col("fsn.id").alias("id"), strip_tag("fsn.term").alias("term"))))
    count = F.greatest(F.coalesce(F.size("parent_ids"), F.lit(0)), F.lit(0))
    hierarchy = [F.coalesce("parents", F.array().cast("array<struct<destinationId:string,effective_time:string,moduleId:string>>")).alias("parents"), F.coalesce("parent_ids", F.array().cast("array<string>")).alias("parent_ids"), count.alias("parent_count"), F.lit(K.INFERRED).alias("characteristic")]
    if include_stated:
        stated = parents(relationships, K.STATED).select("conceptId", F.col("parents").alias("stated_parents"))
        out = out.join(stated, "conceptId", "left")
        hierarchy.append(F.col("stated_parents"))
    out = out.select(
        F.concat(F.lit("snomed:concept:"), "conceptId").alias("doc_id"), F.lit("ConceptAggregate").alias("table"), "conceptId", "active", "moduleId", "definitionStatusId", (F.col("definitionStatusId") == K.DEFINED).alias("is_fully_defined"), "effective_time",
        F.struct(F.col("fsn"), default.alias("pt"), F.col("synonyms")).alias("terms"), F.struct(*hierarchy).alias("hierarchy"), F.lit("snomed_ct").alias("source"), F.lit(run_ts).alias("last_ingested"),
    )
    return out.withColumn("record_hash", short_sha256(F.to_json(F.struct(*out.columns))))


def best_name(pt: Column, fsn: Column, concept: Column) -> Column:
    """The preferred term by language, else the full name, without its tag, else the id."""
    return F.coalesce(*[strip_tag(F.nullif(pt[k]["term"], F.lit(""))) for k in ("en-US", "en-GB", "default")], strip_tag(F.nullif(fsn["term"], F.lit(""))), F.concat(F.lit("SNOMED "), concept))


def display_names(docs: DataFrame) -> DataFrame:
    named = docs.select("conceptId", best_name(F.col("terms.pt"), F.col("terms.fsn"), F.col("conceptId")).alias("name"), F.col("ord") if "ord" in docs.columns else F.lit(0).alias("ord"))
    return last_rows(named, ["conceptId"]).drop("ord")


def pack(pieces: list[str], prefix: str, budget: int) -> Iterator[str]:
    """Texts of lines under a prefix, each within a budget of tokens unless one line alone is over it."""
    text = prefix
    for piece in (f"- {p}\n" for p in pieces):
        if text != prefix and -(-len(text + piece) // 4) > budget:
            yield text
            text = prefix
        text += piece
    if text != prefix:
        yield text


def concept_chunks(docs: DataFrame, run_ts: str, budget: int = 300) -> DataFrame:
    """A core chunk for each concept, and its synonyms packed into chunks."""
    names = display_names(docs).select(F.col("conceptId").alias("pid"), F.col("name").alias("pname"))
    lines = docs.select("conceptId", F.posexplode("hierarchy.parent_ids").alias("pos", "pid")).join(names, "pid", "left")
    lines = lines.groupBy("conceptId").agg(ordered_list(F.concat(F.lit("- "), "pid", F.coalesce(F.concat(F.lit(": "), "pname"), F.lit(""))), F.col("pos"), distinct=False).alias("parent_lines"))
    fsn = F.nullif(F.col("terms.fsn.term"), F.lit(""))
    text = F.concat_ws("\n", best_name(F.col("terms.pt"), F.col("terms.fsn"), F.col("conceptId")), F.concat(F.lit("SNOMED CT conceptId: "), "conceptId"), F.concat(F.lit("Definition status: "), F.when(F.col("is_fully_defined"), "fully_defined").otherwise("primitive")), F.concat(F.lit("FSN: "), fsn), F.when(F.size("parent_lines") > 0, F.concat(F.lit("Parents:\n"), F.array_join("parent_lines", "\n"))))

    def chunk(df: DataFrame, section: str, ident: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit("snomed:chunk:"), "conceptId", F.lit(":"), ident).alias("chunk_id"), F.concat(F.lit("snomed:concept:"), "conceptId").alias("doc_id"), "conceptId", F.lit(section).alias("section"), "text",
            tokens_estimate("text").alias("token_estimate"), "order", F.lit("snomed_ct").alias("source"), F.lit(run_ts).alias("last_updated"),
        )

    core = docs.join(lines, "conceptId", "left").select("conceptId", F.concat(F.trim(text), F.lit("\n")).alias("text"), F.lit(0).alias("order"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, t, k) for c, syn in zip(b["conceptId"], b["syn"]) for k, t in enumerate(pack(list(syn), "Synonyms:\n", budget), 1)]
            yield pd.DataFrame(rows, columns=["conceptId", "text", "order"])

    syn = docs.select("conceptId", compact_text_set(F.filter(F.transform("terms.synonyms", lambda s: s["term"]), lambda t: t != "")).alias("syn")).where(F.size("syn") > 0).mapInPandas(packed, "conceptId string, text string, order int")
    return chunk(core, "core", short_sha1("conceptId", F.lit("core"))).unionByName(chunk(syn, "synonyms", short_sha1("conceptId", F.lit("syn"), "order")))


def counts(concepts: DataFrame) -> DataFrame:
    return concepts.agg(F.count("*").alias("rows"), F.count_if("active").alias("active"), F.count_if(F.col("definition_status") == "defined").alias("defined"), F.count_if(F.col("definition_status") == "primitive").alias("primitive"))
