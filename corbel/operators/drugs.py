"""Drug terminology: names, relations, attributes, link keys, enrichment and fact chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel import constants as K
from corbel.functions.keys import is_number, ndc11, ndc11_by_segment
from corbel.functions.text import any_of, first_true, fold_accents, literal_map, strip
from corbel.operators.ordered import first_rows, last_rows, ordered_list, sorted_set, top_rows


def drug_master(conso: DataFrame, run_ts: str, min_synonyms: int = 0) -> DataFrame:
    """One row per drug of the main source: preferred term, synonyms by normalised form, sources."""
    rows = conso.select("RXCUI", "STR", "ord", *[F.upper(c).alias(c) for c in ("SAB", "TTY", "ISPREF", "SUPPRESS")])
    rows = rows.where((F.col("RXCUI") != "") & (F.col("STR") != "") & ~F.col("SUPPRESS").isin("Y", "O")).withColumn("norm", fold_accents("STR"))
    w = Window.partitionBy("RXCUI")
    rows = rows.withColumn("own", F.col("SAB") == "RXNORM").withColumn("some", F.max("own").over(w))
    best = F.struct(-F.coalesce(literal_map(K.PREFERRED_TYPE)[F.col("TTY")], F.lit(1)), F.col("ISPREF") != "Y", F.length("STR"), F.col("ord"))
    # Only drugs that the main source knows are admitted, so the pool is its rows.
    preferred = rows.where("own").groupBy("RXCUI").agg(F.min_by(F.struct("STR", "TTY", "norm"), best).alias("p"))
    spelled = rows.where((F.col("norm") != "") & F.col("some")).groupBy("RXCUI", "norm").agg(F.min_by("STR", "ord").alias("STR"), F.min("ord").alias("ord"))
    names = spelled.groupBy("RXCUI").agg(ordered_list(F.col("STR"), F.col("ord"), distinct=False).alias("synonyms"))
    sources = rows.where("some").groupBy("RXCUI").agg(sorted_set(F.col("SAB")).alias("sab_sources"))
    kind = literal_map({k: v[0] for k, v in K.TYPE_KIND.items()}), literal_map({k: v[1] for k, v in K.TYPE_KIND.items()})
    out = preferred.join(names, "RXCUI").join(sources, "RXCUI").where(F.size("synonyms") >= min_synonyms)
    return out.select(
        F.col("RXCUI").alias("rxcui"), F.col("p.STR").alias("preferred_term"), F.col("p.TTY").alias("tty"), "synonyms", F.col("p.norm").alias("normalized_name"),
        kind[0][F.col("p.TTY")].alias("brand_generic"), kind[1][F.col("p.TTY")].alias("node_kind"), "sab_sources", F.lit("rxnorm").alias("source"), F.lit(run_ts).alias("last_updated"),
    )


def admit(master: DataFrame) -> DataFrame:
    """Drugs of the main source, and ingredients and brands of any."""
    return master.where(F.array_contains("sab_sources", "RXNORM") | F.upper("tty").isin("IN", "PIN", "MIN", "BN"))


def canonical(relation: Column, src: Column, dst: Column, extra: bool = False) -> tuple[Column, Column, Column]:
    """(relation, source, target) in canonical direction; the relation is null if it isn't known."""
    known = K.RELATIONS | (K.ENRICHMENT_RELATIONS if extra else {})
    name, sign = literal_map({k: v[0] for k, v in known.items()}), literal_map({k: v[1] for k, v in known.items()})
    r = F.upper(relation)
    flip = sign[r] == -1
    return name[r], F.when(flip, dst).otherwise(src), F.when(flip, src).otherwise(dst)


def drug_relations(rel: DataFrame, sources: list[str] | None = None, drop_suppressed: bool = True, distinct: bool = True) -> DataFrame:
    """Edges between drugs in canonical direction."""
    rows = rel.where((F.upper("STYPE1") == "CUI") & (F.upper("STYPE2") == "CUI") & is_number("RXCUI1") & is_number("RXCUI2"))
    if sources:
        rows = rows.where(F.upper("SAB").isin([s.upper() for s in sources]))
    if drop_suppressed:
        rows = rows.where(~F.upper("SUPPRESS").startswith("Y"))
    name, src, dst = canonical(F.col("RELA"), F.col("RXCUI1"), F.col("RXCUI2"))
    edges = rows.select(src.alias("src_rxcui"), name.alias("rela"), dst.alias("dst_rxcui"), F.upper("SAB").alias("sab"), "ord").where("rela is not null")
    return first_rows(edges, ["src_rxcui", "rela", "dst_rxcui", "sab"]).drop("ord") if distinct else edges.drop("ord")


def drug_attributes(sat: DataFrame, names: list[str] | None = None, sources: list[str] | None = None, drop_suppressed: bool = False, normalize: bool = False, only_valid: bool = False, distinct: bool = True, sample: int | None = None) -> DataFrame:
    """Attribute rows; with ``normalize`` package codes become NDC11 by segment.

    The lists of names and sources are held against the rows as they come in.
    """
    rows = sat.select(F.trim("RXCUI").alias("rxcui"), F.upper(F.trim("ATN")).alias("atn"), F.trim("ATV").alias("atv"), F.upper(F.trim("SAB")).alias("sab"), F.nullif(F.trim("SUPPRESS"), F.lit("")).alias("suppress"), "ord").where(is_number("rxcui"))
    if names:
        rows = rows.where(F.col("atn").isin(names))
    if sources:
        rows = rows.where(F.col("sab").isin(sources))
    if drop_suppressed:
        rows = rows.where(~F.upper(F.coalesce("suppress", F.lit(""))).startswith("Y"))
    if normalize:
        code = F.col("atn").isin("NDC", "NDC11")
        rows = rows.withColumn("atv", F.when(code, ndc11_by_segment("atv")).otherwise(F.col("atv")))
        if only_valid:
            rows = rows.where(~code | (F.length("atv") == 11))
        rows = rows.withColumn("atn", F.when(code, "NDC11").otherwise(F.col("atn")))
    if distinct:
        rows = first_rows(rows, ["rxcui", "atn", "atv", "sab"])
    if sample:
        rows = rows.orderBy("ord").limit(sample)
    return rows.drop("ord")


def drug_attributes_emitting(sat: DataFrame, names: list[str] | None = None, sources: list[str] | None = None, drop_suppressed: bool = False, normalize: bool = False, emit_ndc: bool = False, distinct: str | None = "source") -> DataFrame:
    """Attribute rows where one package code may give two: the normalised and the written one.

    Names are held against rows as they come in, codes to be normalised
    excepted, and against rows as they go out.  ``distinct``: by "source", over "all" sources, or not.
    """
    rows = sat.select(F.trim("RXCUI").alias("rxcui"), F.trim("ATN").alias("atn"), F.trim("ATV").alias("atv"), F.trim("SAB").alias("sab"), F.trim("SUPPRESS").alias("suppress"), "ord").where("rxcui <> '' and atn <> '' and sab <> ''")
    if drop_suppressed:
        rows = rows.where("suppress = 'N'")
    if sources:
        rows = rows.where(F.col("sab").isin(sources))
    code = F.col("atn").isin("NDC", "NDC11") if normalize else F.lit(False)
    if names:
        rows = rows.where(F.col("atn").isin(names) | code)
    pair = lambda n, v: F.struct(n.alias("atn"), v.alias("atv"), F.lit(0).alias("k"))
    both = F.array_compact(F.array(F.when(ndc11("atv").isNotNull(), pair(F.lit("NDC11"), ndc11("atv"))), F.when((F.col("atn") == "NDC") & F.lit(emit_ndc), F.struct(F.lit("NDC").alias("atn"), F.col("atv").alias("atv"), F.lit(1).alias("k")))))
    rows = rows.withColumn("e", F.explode(F.when(code, both).otherwise(F.array(pair(F.col("atn"), F.col("atv"))))))
    rows = rows.select("rxcui", "e.atn", "e.atv", "sab", "suppress", F.struct("ord", "e.k").alias("ord"))
    if names:
        rows = rows.where(F.col("atn").isin(names))
    if distinct:
        rows = first_rows(rows, ["rxcui", "atn", "atv"] + ["sab"] * (distinct == "source"))
    return rows.drop("ord")


def link_keys(attributes: DataFrame) -> DataFrame:
    """Label ids and package codes of each drug, ordered by the drug's number."""
    code = F.col("atn").isin("NDC", "NDC11")
    out = attributes.groupBy("rxcui").agg(sorted_set(F.when(F.upper("atn") == "SPL_SET_ID", F.nullif(F.trim("atv"), F.lit("")))).alias("spl_set_ids"), sorted_set(F.when(code, ndc11("atv"))).alias("ndc11s"))
    return out.where((F.size("spl_set_ids") > 0) | (F.size("ndc11s") > 0)).orderBy(F.expr("try_cast(rxcui as bigint)").asc_nulls_last(), "rxcui")


def drug_meta(conso: DataFrame, keys: DataFrame) -> DataFrame:
    """Representative term type of each drug and whether it has package codes."""
    weight = F.coalesce(literal_map(K.REPRESENTATIVE_TYPE)[F.upper("TTY")], F.lit(0))
    types = conso.where((F.col("RXCUI") != "") & (F.col("TTY") != "")).groupBy(F.col("RXCUI").alias("rxcui")).agg(F.min_by(F.upper("TTY"), F.struct(-weight, F.col("ord"))).alias("tty"))
    has = keys.groupBy("rxcui").agg(F.max(F.size("ndc11s") > 0).alias("has_ndc"))
    return types.join(has, "rxcui", "left").select("rxcui", "tty", F.coalesce("has_ndc", F.lit(False)).alias("has_ndc"))


def attribute_arrays(attributes: DataFrame) -> DataFrame:
    """One row per drug with an array for each known kind of attribute; package codes are normalised."""
    kind = literal_map(K.ATTRIBUTE_ARRAYS)[F.upper("atn")]
    value = F.when(F.upper("atn") == "NDC", F.coalesce(ndc11("atv"), F.col("atv"))).otherwise(F.col("atv"))
    rows = attributes.select("rxcui", kind.alias("kind"), value.alias("value")).where("kind is not null and value <> ''")
    names = list(dict.fromkeys(K.ATTRIBUTE_ARRAYS.values()))
    return rows.groupBy("rxcui").pivot("kind", names).agg(sorted_set(F.col("value")))


def routes_in(name: Column) -> Column:
    """All routes that a name tells."""
    s = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return F.array_compact(F.array(*[F.when(any_of([s.contains(n) for n in needles]), F.lit(route)) for route, needles in K.ROUTE_NEEDLES.items()]))


def form_in(name: Column) -> Column:
    """The first dose form that a name tells, else the second of two words of which one is a form."""
    s = F.lower(name)
    plain = first_true([(any_of([s.contains(n) for n in needles]), F.lit(form)) for form, needles in K.FORM_NEEDLES.items()], F.lit(None).cast("string"))
    words = F.split(strip(name), r"\s+")
    pairs = F.slice(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    tail = F.filter(pairs, lambda p: any_of([F.lower(F.concat_ws(" ", p["a"], p["b"])).contains(f) for f in K.TAIL_FORMS]))
    word = F.get(tail, F.lit(0))["b"]
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(plain, F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1000)))))


#: Relations that are gathered of a drug, and what they are called.
RELATED = {"has_ingredient": "ingredients", "has_dose_form": "dose_forms", "has_tradename": "brand_names"}


def enrich(master: DataFrame, relations: DataFrame, arrays: DataFrame) -> DataFrame:
    """Drugs with their ingredients, forms and brands, attribute arrays, and routes and forms told by the name."""
    names = last_rows(master.withColumn("ord", F.lit(0)), ["rxcui"]).select(F.col("rxcui").alias("dst_rxcui"), F.col("preferred_term").alias("name"), "tty")
    rows = relations.where((F.upper("sab") == "RXNORM") & F.col("rela").isin(list(RELATED))).join(names, "dst_rxcui", "left")
    return enriched(master, rows, arrays)


def enriched(master: DataFrame, rows: DataFrame, arrays: DataFrame) -> DataFrame:
    """``enrich`` for relations that have the names of what they lead to."""
    related = rows.groupBy(F.col("src_rxcui").alias("rxcui")).pivot("rela", list(RELATED)).agg(sorted_set(F.struct(F.col("dst_rxcui").alias("rxcui"), "name", "tty")))
    for old, new in RELATED.items():
        related = related.withColumnRenamed(old, new)
    out = master.join(related, "rxcui", "left").join(arrays, "rxcui", "left")
    told = routes_in(F.col("preferred_term"))
    out = out.withColumn("routes", F.when(F.size("routes") > 0, F.col("routes")).when(F.size(told) > 0, told))
    return out.withColumn("dose_form", F.when(F.coalesce(F.size("rxn_dose_forms"), F.lit(0)) <= 0, form_in(F.col("preferred_term"))))


def fact_chunks(conso: DataFrame, meta: DataFrame, keys: DataFrame, links: DataFrame, resolved: bool = False, max_synonyms: int = 20, sample: int = 3) -> DataFrame:
    """What is known of each drug in one row.

    ``links`` has rxcui and spl_set_id: raw rows, which are counted, or resolved
    primary ones, of which labels are counted.
    """
    rows = conso.where((F.col("RXCUI") != "") & (F.trim("STR") != ""))
    names = rows.groupBy(F.col("RXCUI").alias("rxcui")).agg(F.min_by("STR", "ord").alias("preferred_name"), F.slice(ordered_list(F.col("STR"), F.col("ord")), 1, max_synonyms).alias("synonyms"), F.min_by(F.upper("TTY"), "ord").alias("tty_seen"))
    counts = keys.groupBy("rxcui").agg(F.sum(F.size("ndc11s")).alias("ndc_count"))
    per = links.where("spl_set_id is not null and spl_set_id <> ''").groupBy("rxcui", "spl_set_id").count()
    labels = per.groupBy("rxcui").agg((F.count("*") if resolved else F.sum("count")).alias("spl_count"))
    shown = top_rows(per, ["rxcui"], [F.desc("count"), F.asc("spl_set_id")], sample, "k").groupBy("rxcui").agg(ordered_list(F.col("spl_set_id"), F.col("k")).alias("sample_spl_set_ids"))
    low = F.lower("preferred_name")
    strength = r"(?i)\b(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|units?)\b"
    numbers, units = (F.regexp_extract_all("preferred_name", F.lit(strength), F.lit(k)) for k in (1, 2))
    out = names.join(meta, "rxcui", "left").join(counts, "rxcui", "left").join(labels, "rxcui", "left").join(shown, "rxcui", "left")
    return out.select(
        "rxcui", F.coalesce(F.nullif("tty", F.lit("")), "tty_seen", F.lit("")).alias("tty"), "preferred_name", "synonyms", F.coalesce("has_ndc", F.lit(False)).alias("has_ndc"), F.coalesce("ndc_count", F.lit(0)).alias("ndc_count"),
        first_true([(low.contains(w), F.lit(w)) for w in K.FACT_ROUTES], F.lit(None).cast("string")).alias("route"),
        first_true([(low.contains(w), F.lit(w)) for w in K.FACT_FORMS], F.lit(None).cast("string")).alias("dose_form"),
        F.zip_with(numbers, units, lambda a, b: F.concat_ws(" ", a, b)).alias("strengths"), F.coalesce("spl_count", F.lit(0)).alias("spl_count"), "sample_spl_set_ids",
    )


def coverage(enriched: DataFrame) -> DataFrame:
    """How many drugs have each of the gathered arrays."""
    names = [c for c, t in enriched.dtypes if t.startswith("array") and c not in ("synonyms", "sab_sources")]
    return enriched.agg(*[F.count_if(F.size(c) > 0).alias(c) for c in names])
