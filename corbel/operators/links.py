"""Links between labels, drugs and conditions, and the graph that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel import constants as K
from corbel.functions.keys import ndc11
from corbel.functions.ranking import edge_score, link_score
from corbel.functions.text import literal_map
from corbel.operators.cut import materialize
from corbel.operators.ordered import fallback, first_rows, ordered_list, sorted_set, top_rows


def label_drug_links(labels: DataFrame, keys: DataFrame, fold_case: bool = True) -> DataFrame:
    """(spl_set_id, rxcui, via): by label id, and by package code only for labels that no id links.

    ``labels`` has row_id, spl_set_id and ndcs; ``keys`` is the table of link keys.
    """
    fold = F.lower if fold_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    by_id = keys.select(F.explode("spl_set_ids").alias("k"), "rxcui").select(fold("k").alias("k"), "rxcui").distinct()
    by_code = keys.select(F.explode("ndc11s").alias("k"), "rxcui").select(ndc11("k").alias("k"), "rxcui").where("k is not null").distinct()
    direct = labels.join(by_id, fold(F.trim("spl_set_id")) == by_id.k).select("row_id", "spl_set_id", "rxcui", F.lit("spl_set_id").alias("via")).distinct()
    codes = labels.select("row_id", "spl_set_id", F.explode("ndcs").alias("n"))
    other = codes.join(by_code, ndc11("n") == by_code.k).select("row_id", "spl_set_id", "rxcui", F.lit("ndc11").alias("via")).distinct()
    return fallback(direct, other, ["row_id"]).select(F.nullif("spl_set_id", F.lit("")).alias("spl_set_id"), "rxcui", "via")


def resolve_links(links: DataFrame, meta: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One row per label: the best drug as ``primary``, the others in order as ``secondary``."""
    rows = links.where("spl_set_id is not null and spl_set_id <> ''").join(meta.select("rxcui", "tty", F.col("has_ndc").alias("known")), "rxcui", "left")
    if keys is not None:
        rows = rows.join(keys.groupBy("rxcui").agg(F.max(F.size("ndc11s") > 0).alias("told")), "rxcui", "left")
    else:
        rows = rows.withColumn("told", F.lit(None).cast("boolean"))
    rows = rows.withColumn("has_ndc", F.coalesce("known", "told", F.lit(False))).withColumn("via", F.coalesce(F.nullif("via", F.lit("")), F.lit("spl_set_id"))).withColumn("tty", F.coalesce("tty", F.lit("")))
    rows = rows.withColumn("score", link_score("tty", "has_ndc", "via").cast("int"))
    number = F.expr("try_cast(rxcui as bigint)")
    order = F.struct((-F.col("score")).alias("s"), number.isNull().alias("w"), number.alias("n"), F.col("rxcui").alias("r"), F.col("via").alias("v"))
    one = F.struct("rxcui", "tty", "has_ndc", "via", "score")
    listed = rows.groupBy("spl_set_id").agg(ordered_list(one, order, distinct=False).alias("l"))
    return listed.select("spl_set_id", F.col("l")[0].alias("primary"), F.slice("l", 2, 1 << 30).alias("secondary"))


def link_report(links: DataFrame) -> DataFrame:
    """Labels that are linked, by which way, and with more than one drug."""
    per = links.groupBy("spl_set_id").agg(F.count_distinct("rxcui").alias("n"), F.max(F.col("via") == "spl_set_id").alias("by_id"))
    return per.agg(F.count("*").alias("linked"), F.count_if("by_id").alias("via_spl"), F.count_if(~F.col("by_id")).alias("via_ndc"), F.count_if(F.col("n") > 1).alias("conflicts"))


def type_histogram(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(F.col("primary.tty").alias("tty")).agg(F.count("*").alias("labels"), F.avg(F.size("secondary")).alias("mean_secondary"))


def label_to_drug(resolved: DataFrame, prefer_types: bool = False) -> DataFrame:
    """(spl_set_id in lower case, rxcui, tty): the primary drug, else the first secondary one, or the first by type."""
    some = F.filter("secondary", lambda s: F.coalesce(s["rxcui"], F.lit("")) != "")
    if prefer_types:
        place = literal_map({t: k for k, t in enumerate(K.FALLBACK_TYPES)})
        some = F.transform(F.array_sort(F.transform(some, lambda s, i: F.struct(F.coalesce(place[F.upper(s["tty"])], F.lit(99)).alias("p"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    chosen = F.when(F.coalesce("primary.rxcui", F.lit("")) != "", F.col("primary")).otherwise(F.get(some, F.lit(0)))
    rows = resolved.select(F.lower(F.trim("spl_set_id")).alias("spl_set_id"), chosen.alias("c"), F.col("ord") if "ord" in resolved.columns else F.lit(0).alias("ord")).where("c.rxcui is not null and spl_set_id <> ''")
    return rows.groupBy("spl_set_id").agg(F.max_by(F.struct("c.rxcui", "c.tty"), "ord").alias("c")).select("spl_set_id", "c.rxcui", "c.tty")


def _drugs(resolved: DataFrame) -> DataFrame:
    """(spl_set_id, drugs): a label's drugs that have an id, with their places, the primary one first."""
    every = F.transform(F.concat(F.array("primary"), "secondary"), lambda d, pos: F.struct(pos.alias("pos"), d["rxcui"].alias("rxcui"), d["tty"].alias("tty"), d["has_ndc"].alias("has_ndc"), d["via"].alias("via")))
    return resolved.select("spl_set_id", F.filter(every, lambda d: d["rxcui"].isNotNull()).alias("drugs"))


def _own_chunks(rows: DataFrame) -> bool:
    """Whether no chunk is of several labels; if in doubt it is said to be."""
    label = F.xxhash64("spl_set_id")
    per = rows.groupBy(F.xxhash64("chunk_id")).agg(F.min(label).alias("least"), F.max(label).alias("most"))
    return not per.agg(F.max(F.col("least") != F.col("most"))).first()[0]


def crosswalk(mentions: DataFrame, resolved: DataFrame, min_conf: float = 0.0) -> DataFrame:
    """Mentions of conditions with the drugs of their label; of one chunk, drug, concept and link type the first.

    Rows lie by label after the join; as long as no chunk is of several labels
    they are told apart where they lie, and later steps by label find them so.
    """
    rows = mentions.where(F.col("confidence") >= min_conf)
    own = _own_chunks(rows)
    rows = rows.join(_drugs(resolved), "spl_set_id").withColumn("d", F.explode("drugs")).select("*", "d.rxcui", "d.tty", "d.has_ndc", "d.via").withColumn("ord", F.struct("ord", "d.pos")).drop("drugs", "d")
    return first_rows(rows, ["spl_set_id"] * own + ["chunk_id", "rxcui", "snomed_id", "link_type"])


EDGE = ["rxcui", "snomed_id", "link_type"]
#: What a row of support says; the first row of a group speaks for those that were left out, too.
SAID = ["ord", "section", "text", "negated", "mentions", "confidence", "more"]


def support_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Each mention as a row of support: it counts once, and no further sections are known."""
    return rows.select(*keys, "ord", "section", F.col("match_text").alias("text"), F.col("qualifiers.negated").alias("negated"), F.lit(1).cast("long").alias("mentions"), "confidence", F.lit(None).cast("array<string>").alias("more"))


def merged_support(rows: DataFrame, keys: list[str], examples: int = 5) -> DataFrame:
    """The first rows of support of each group; the first one has the group's mentions, greatest confidence and the sections of those left out.

    Support of several batches adds up to what it would be if they had come in
    one.  Groups are sorted, never held as a whole.
    """
    order = Window.partitionBy(*keys).orderBy("ord", "section", "text", "negated")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("at", F.row_number().over(order))
    told = rows.withColumn("all_mentions", F.sum("mentions").over(every)).withColumn("most", F.max("confidence").over(every)).withColumn("lost", F.collect_set(F.when(F.col("at") > examples, F.col("section"))).over(every)).withColumn("known", F.collect_set("more").over(every))
    first, more = F.col("at") == 1, F.array_union("lost", F.flatten("known"))
    return told.where(F.col("at") <= examples).select(*keys, "ord", "section", "text", "negated", F.when(first, F.col("all_mentions")).otherwise(0).alias("mentions"), F.when(first, F.col("most")).alias("confidence"), F.when(first & ((F.size("lost") > 0) | (F.size("known") > 0)), more).alias("more"))


def label_support(rows: DataFrame, examples: int = 5) -> DataFrame:
    """What each label says for each edge: its first mentions as rows of support."""
    return merged_support(support_rows(rows, *EDGE, "spl_set_id"), ["spl_set_id", *EDGE], examples)


def drug_support(mentions: DataFrame, resolved: DataFrame, min_conf: float = 0.0, examples: int = 5) -> DataFrame:
    """What each label says for each condition and link type, with its drugs; ``edge_support`` makes edges' support of it.

    It says what ``label_support`` says of ``crosswalk``'s rows.  As long as
    no chunk is of several labels, and no label is resolved twice, mentions
    are told apart and added up before they meet the drugs.
    """
    rows = mentions.where(F.col("confidence") >= min_conf)
    labels = resolved.groupBy(F.xxhash64("spl_set_id")).count().agg(F.max("count")).first()[0] or 0
    if labels > 1 or not _own_chunks(rows):
        found = label_support(crosswalk(mentions, resolved, min_conf), examples)
        return found.withColumn("drugs", F.array(F.struct(F.col("ord.pos").alias("pos"), "rxcui"))).withColumn("ord", F.col("ord.ord")).select("spl_set_id", "snomed_id", "link_type", *SAID, "drugs")
    names = F.concat(F.array("primary.rxcui"), F.col("secondary.rxcui"))
    placed = F.arrays_zip(F.sequence(F.lit(0), F.size(names) - 1).alias("pos"), names.alias("rxcui"))
    # Of a drug that comes twice the first place counts.
    once = F.filter(placed, lambda d, k: F.array_position(names, d["rxcui"]) == k + 1)
    drugs = resolved.select("spl_set_id", F.when(F.size(F.array_distinct(names)) == F.size(names), placed).otherwise(once).alias("drugs"))
    keys = ["spl_set_id", "snomed_id", "link_type"]
    # Rows are dealt by label once, for all that follows.
    once = first_rows(support_rows(rows, *keys, "chunk_id").where("spl_set_id is not null"), ["spl_set_id", "chunk_id", "snomed_id", "link_type"])
    return merged_support(once, keys, examples).join(drugs, "spl_set_id").select(*keys, *SAID, "drugs")


def edge_support(support: DataFrame) -> DataFrame:
    """The support of edges by that of labels with their drugs."""
    rows = support.withColumn("d", F.explode("drugs")).where("d.rxcui is not null")
    return rows.select("d.rxcui", "snomed_id", "link_type", "spl_set_id", F.struct("ord", "d.pos").alias("ord"), *SAID[1:])


def composed(support: DataFrame, run_ts: str, labels: int = 50, examples: int = 5) -> DataFrame:
    """One row per edge from its labels' support, with its first labels and its first examples.

    A label may have several rows, and an edge any number of labels: after one
    shuffle by edge, mentions are numbered by their order and labels by their
    names, and only the first ones are brought together.
    """
    edge = Window.partitionBy(*EDGE)
    by_name = edge.orderBy(F.asc_nulls_last("spl_set_id"))
    every = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = support.withColumn("first_at", F.row_number().over(edge.orderBy("ord", "spl_set_id", "section", "text", "negated")))
    rows = rows.withColumn("row_at", F.row_number().over(by_name)).withColumn("name_at", F.dense_rank().over(by_name)).withColumn("before", F.lag("spl_set_id").over(by_name))
    new = F.col("spl_set_id").isNotNull() & ~F.col("spl_set_id").eqNullSafe(F.col("before"))
    shown = F.struct("first_at", F.struct("spl_set_id", "section", "text", "negated").alias("example"))
    told = {
        "sections": F.collect_set("section"), "more": F.collect_set("more"), "spl_set_ids": F.collect_list(F.when(new & (F.col("name_at") <= labels), F.col("spl_set_id"))), "spl_count": F.count(F.when(new, 1)),
        "chunk_count": F.sum("mentions"), "max_confidence": F.max("confidence"), "examples": F.collect_list(F.when(F.col("first_at") <= examples, shown)),
    }
    found = rows.select(*EDGE, "row_at", *[c.over(every).alias(k) for k, c in told.items()]).where("row_at = 1")
    sections = F.when(F.size("more") > 0, F.array_union("sections", F.flatten("more"))).otherwise(F.col("sections"))
    return found.select(
        *EDGE, F.sort_array(sections).alias("sections"), "spl_set_ids", "spl_count", "chunk_count", F.round("max_confidence", 3).alias("max_confidence"),
        F.sort_array("examples")["example"].alias("examples"), F.lit(run_ts).alias("last_updated"),
    )


def rollup(rows: DataFrame, run_ts: str, labels: int = 50, examples: int = 5) -> DataFrame:
    """One row per drug, concept and link type, with its sections, labels, support and first examples."""
    return composed(label_support(rows, examples), run_ts, labels, examples)


def all_negated(examples: Column) -> Column:
    """Whether all examples are negated; null if none tells."""
    told = F.filter(examples, lambda e: e["negated"].isNotNull())
    return F.when(F.size(told) > 0, F.forall(told, lambda e: e["negated"]))


def edges(rolled: DataFrame) -> DataFrame:
    """Edges of the graph; rows without drug, concept or type are none."""
    return rolled.where("rxcui <> '' and snomed_id <> '' and link_type <> ''").withColumn("score", edge_score("max_confidence", "spl_count"))


def nested_edges(by_drug: DataFrame, by_condition: DataFrame) -> DataFrame:
    """Edges of the two nested tables, an edge of both twice, with examples if both have them."""
    held = [set(df.schema[name].dataType.elementType.names) for df, name in ((by_drug, "conditions"), (by_condition, "drugs"))]
    told = [f"e.{c}" for c in ("link_type", "max_confidence", "spl_count", "examples") if c != "examples" or all(c in h for h in held)]
    one = by_drug.select("rxcui", F.explode("conditions").alias("e")).select("rxcui", "e.snomed_id", *told)
    two = by_condition.select("snomed_id", F.explode("drugs").alias("e")).select("e.rxcui", "snomed_id", *told)
    return edges(one.unionByName(two))


def strongest(graph: DataFrame, by: str, link_types: list[str] | None = None, min_conf: float = 0.80, min_labels: int = 2, blocklist: DataFrame | None = None, drop_negated: bool = True, top: int = 10) -> DataFrame:
    """The best edges of every drug (``by='rxcui'``) or condition (``by='snomed_id'``) with their rank."""
    rows = graph.where((F.col("max_confidence") >= min_conf) & (F.col("spl_count") >= min_labels))
    if link_types:
        rows = rows.where(F.col("link_type").isin(link_types))
    if blocklist is not None:
        rows = rows.join(blocklist.select(F.col("id").alias("snomed_id")), "snomed_id", "left_anti")
    if drop_negated:
        rows = rows.where(~F.coalesce(all_negated(F.col("examples")), F.lit(False)))
    other = "snomed_id" if by == "rxcui" else "rxcui"
    return top_rows(rows, [by], [F.desc("score"), F.asc(other), F.asc("link_type")], top, "rank")


def generic_statistics(rolled: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per concept: how many drugs and edges it has, of which types, and whether its name is generic."""
    # What examples tell is counted before the edges are written.
    told = F.filter("examples", lambda e: e["negated"].isNotNull())
    rolled = materialize(rolled.select(*EDGE, "max_confidence", "spl_count", F.size(told).alias("told"), F.exists(told, lambda e: ~e["negated"]).alias("affirmed")), "edges")
    per = rolled.where("rxcui <> '' and snomed_id <> ''").groupBy("snomed_id").agg(
        F.count_distinct("rxcui").alias("degree_rx"), F.count("*").alias("edge_count"), F.avg(F.coalesce("max_confidence", F.lit(0.0))).alias("mean_max_conf"), F.avg(F.coalesce("spl_count", F.lit(0))).alias("mean_spl_count"),
        F.sum("told").alias("examples_with_negation_info"), ~F.coalesce(F.max("affirmed"), F.lit(False)).alias("all_examples_negated"),
    )
    types = rolled.groupBy("snomed_id", F.lower("link_type").alias("t")).count()
    types = top_rows(types, ["snomed_id"], [F.desc("count"), F.asc("t")], 3, "k").groupBy("snomed_id").agg(F.array_join(ordered_list(F.concat_ws(":", "t", F.col("count").cast("string")), F.col("k")), ",").alias("top_link_types"))
    out = per.join(types, "snomed_id", "left")
    if names is not None:
        out = out.join(names.select("snomed_id", "pt", "fsn"), "snomed_id", "left")
    else:
        out = out.withColumn("pt", F.lit("")).withColumn("fsn", F.lit(""))
    out = out.withColumn("pt", F.coalesce("pt", F.lit(""))).withColumn("fsn", F.coalesce("fsn", F.lit("")))
    return out.withColumn("name_is_generic", F.coalesce(F.nullif("pt", F.lit("")), F.col("fsn")).rlike("(?i)" + K.GENERIC_NAME))


def suggested_blocklist(stats: DataFrame, top: int = 50) -> DataFrame:
    return stats.orderBy(F.desc("degree_rx"), F.desc("edge_count"), F.desc("mean_spl_count"), "snomed_id").limit(top).select("snomed_id")
