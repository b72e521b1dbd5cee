"""Payloads to cited summaries: bullets, citations, grouping and formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel import constants as K
from corbel.functions.text import col, literal_map, norm_space, strip
from corbel.operators.ordered import ordered_list

#: Bullets of a summary at least and at most.
LEAST, MOST = 3, 6


def clean_snippet(c: Column | str) -> Column:
    """Collapsed, without who made it, 160 characters at most."""
    x = F.trim(F.regexp_replace(norm_space(F.coalesce(col(c), F.lit(""))), r"(?i)(Manufactured by|Distributed by|Revised:).+$", ""))
    return F.when(F.length(x) > 160, F.concat(F.substring(x, 1, 157), F.lit("..."))).otherwise(x)


def bullet_text(term: Column, snip: Column, section: Column, intent: Column, label: Column | None = None) -> Column:
    """A short bullet: the condition's name, or the snippet; a quotation beside a name; a mark if it is boxed."""
    pt, s = F.coalesce(strip(term), F.lit("")), clean_snippet(snip)
    head = F.when(pt != "", pt).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20)))
    quoted = (s != "") & (pt != "") & (F.lower(s) != F.lower(pt)) & ((F.length(s) > 20) | s.rlike("[.;:!?]"))
    boxed = F.contains(F.lower(F.coalesce(section, F.lit(""))), F.lit("boxed"))
    if label is not None:
        boxed = boxed | F.coalesce(label == "serious_safety", F.lit(False))
    head = F.when(boxed, F.concat(F.lit("⚠️ "), head)).otherwise(head)
    head = F.when(intent == "indication", F.regexp_replace(head, r"(?i)\s*\((disorder|finding)\)\s*$", "")).otherwise(head)
    return F.trim(F.concat(head, F.when(quoted, F.concat(F.lit(' — "'), s, F.lit('"'))).otherwise("")))


def section_norm(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), " ", "_")


def citation_index(evidence: DataFrame) -> DataFrame:
    """qid, spl_set_id, section, number and url: evidence by label and section, numbered by first appearance.

    An address that several pieces of evidence share belongs to the last of
    them, as the reader of a list of addresses would find.
    """
    rows = evidence.select("qid", "rank", F.trim("spl_set_id").alias("spl_set_id"), section_norm("section").alias("section"), F.trim(F.col("links")["dailymed"]).alias("url")).where("spl_set_id <> '' and url <> ''")
    owner = rows.groupBy("qid", "url").agg(F.max_by(F.struct("spl_set_id", "section"), "rank").alias("m"), F.min("rank").alias("first"))
    keys = owner.groupBy("qid", "m.spl_set_id", "m.section").agg(F.min_by("url", "first").alias("url"), F.min("first").alias("first"))
    listed = keys.groupBy("qid").agg(ordered_list(F.struct("spl_set_id", "section", "url"), F.col("first"), distinct=False).alias("l"))
    return listed.select("qid", F.posexplode("l").alias("k", "c")).select("qid", "c.spl_set_id", "c.section", (F.col("k") + 1).alias("number"), "c.url")


def cite(evidence: DataFrame, index: DataFrame) -> DataFrame:
    """``evidence`` with the struct column citation: by label and section, else by label, else the general one."""
    lists = index.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("number", "spl_set_id", "section"))).alias("cites"))
    sec = section_norm("section")
    pick = lambda f: F.get(F.filter("cites", f), F.lit(0))["number"]
    found = F.coalesce(pick(lambda c: (c["spl_set_id"] == F.col("spl_set_id")) & (c["section"] == sec)), pick(lambda c: c["spl_set_id"] == F.col("spl_set_id")), pick(lambda c: (c["spl_set_id"] == "") & (c["section"] == "")))
    return evidence.join(lists, "qid", "left").withColumn("citation", found).drop("cites")


def head_of(text: Column) -> Column:
    return F.trim(F.split(text, "—", 2)[0])


def signature(head: Column) -> Column:
    """The last two words of a head, or its only one."""
    words = F.regexp_extract_all(F.lower(head), F.lit("([A-Za-z]+)"), F.lit(1))
    return F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ")


def group_bullets(bullets: DataFrame) -> DataFrame:
    """Bullets of a question with one signature as one: shortest head, qualifiers and citations of all.

    ``bullets`` has qid, pos, text, score and citation.  Bullets without a
    signature stay alone.  The order is that of each group's first bullet.
    """
    head = head_of(F.col("text"))
    rows = bullets.withColumn("head", head).withColumn("sig", signature(head))
    rows = rows.withColumn("key", F.when(F.col("sig") == "", F.concat(F.lit("\0"), F.col("pos").cast("string"))).otherwise(F.col("sig")))
    words = F.array_except(F.array_intersect(F.regexp_extract_all(F.lower("head"), F.lit("([A-Za-z]+)"), F.lit(1)), F.array(*[F.lit(q) for q in K.QUALIFIERS])), F.split("sig", " "))
    rows = rows.withColumn("quals", words)
    full = F.when(F.col("head") != "", F.col("head"))
    groups = rows.groupBy("qid", "key").agg(
        F.count("*").alias("n"), F.min_by("text", "pos").alias("only"), F.min_by(full, F.struct(F.length(full).isNull(), F.length(full), F.col("pos"))).alias("label"), F.array_distinct(F.flatten(ordered_list(F.col("quals"), F.col("pos"), distinct=False))).alias("quals"),
        F.filter(ordered_list(F.col("citation"), F.col("pos")), lambda c: c.isNotNull()).alias("citations"), F.min_by(F.col("score"), F.struct(-F.col("score"), F.col("pos"))).alias("score"), F.min("pos").alias("pos"),
    )
    merged = F.concat(F.coalesce("label", F.lit("")), F.when(F.size("quals") > 0, F.concat(F.lit(" — "), F.array_join("quals", "; "))).otherwise(""))
    return groups.select("qid", "pos", F.when(F.col("n") == 1, F.col("only")).otherwise(merged).alias("text"), "score", "citations")


def answer_line(intent: Column, name: Column, texts: Column) -> Column:
    """The first line of a summary, by intent."""
    heads = F.array_distinct(F.filter(F.transform(texts, lambda t: F.regexp_replace(head_of(F.regexp_replace(F.regexp_replace(t, r"^[•\- ]+", ""), r"^⚠️\s*", "")), r'^"+|"+$', "")), lambda h: h != ""))
    doses = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit("(?i)(" + K.SUMMARY_DOSE + ")"), F.lit(1))))
    doses = F.filter(doses, lambda d: F.trim(d) != "")
    low = F.transform(doses, lambda d: F.lower(F.trim(d)))
    doses = F.filter(F.transform(doses, lambda d, i: F.when(F.array_position(low, F.lower(F.trim(d))) == i + 1, F.trim(d))), lambda d: d.isNotNull())
    some = lambda xs, n: F.array_join(F.slice(xs, 1, n), "; ")
    any_head, first = F.size(heads) > 0, F.concat(F.get(heads, F.lit(0)), F.lit("."))
    return (
        F.when((intent == "dosage") & (F.size(doses) > 0), F.concat(F.lit("Usual dosing examples for "), name, F.lit(": "), some(doses, 2), F.lit(".")))
        .when(intent == "dosage", F.concat(F.lit("Dosing for "), name, F.lit(": see label details below.")))
        .when((intent == "indication") & any_head, F.concat(F.lit("Indicated uses for "), name, F.lit(": "), some(heads, 3), F.lit(".")))
        .when((intent == "adverse_effect") & any_head, F.concat(F.lit("Reported adverse effects include: "), some(heads, 3), F.lit(".")))
        .when(intent == "interaction", "Clinically significant interactions are noted below; review before co-administration.")
        .when((intent == "contraindication") & any_head, F.concat(F.lit("Contraindications include: "), some(heads, 3), F.lit(".")))
        .when(intent == "pregnancy", "See pregnancy/lactation guidance and risk discussion below.")
        .otherwise(F.coalesce(first, F.lit("")))
    )


def summarize(payloads: DataFrame, top: int = 6, grouped: bool = False, polish: Callable[[Column], Column] | None = None) -> DataFrame:
    """One summary per payload: title, answer, bullets, citations, disclaimer and counts.

    ``payloads`` is what ``plans.engine.ask`` gives.  ``polish`` may rewrite the
    array of bullet texts; one that changes their number is not used.
    """
    limit = max(LEAST, min(MOST, top or MOST))
    evidence = payloads.select("qid", "intent", F.posexplode("evidence").alias("pos", "e")).select("qid", "intent", (F.col("pos") + 1).alias("rank"), "e.*")
    index = citation_index(evidence)
    own = payloads.select("qid", F.coalesce(F.element_at("sources.entity_links", "dailymed"), F.lit("")).alias("u")).join(index.select("qid").distinct(), "qid", "left_anti").where("u <> ''")
    index = index.unionByName(own.select("qid", F.lit("").alias("spl_set_id"), F.lit("").alias("section"), F.lit(1).alias("number"), F.col("u").alias("url")))
    cited = cite(evidence.where(F.col("rank") <= limit), index)
    bullets = cited.select("qid", F.col("rank").alias("pos"), bullet_text(F.lit(None).cast("string"), F.col("snippet"), F.col("section"), F.col("intent")).alias("text"), F.col("score").cast("double").alias("score"), "citation")
    if grouped:
        bullets = group_bullets(bullets)
    else:
        bullets = bullets.select("qid", "pos", "text", "score", F.array_compact(F.array("citation")).alias("citations"))
    lists = bullets.groupBy("qid").agg(ordered_list(F.struct("text", "score", "citations"), F.col("pos"), distinct=False).alias("bullets"))
    if polish is not None:
        texts = F.transform("bullets", lambda b: b["text"])
        new = polish(texts)
        lists = lists.withColumn("bullets", F.when(F.size(new) == F.size("bullets"), F.zip_with("bullets", new, lambda b, t: F.struct(t.alias("text"), b["score"].alias("score"), b["citations"].alias("citations")))).otherwise(F.col("bullets")))
    label = F.when(F.col("spl_set_id") == "", F.lit("DailyMed (product overview)")).otherwise(F.concat(F.lit("DailyMed (SPL "), "spl_set_id", F.lit(")")))
    cites = index.groupBy("qid").agg(ordered_list(F.struct(label.alias("label"), "url"), F.col("number"), distinct=False).alias("cites"))
    rows = payloads.join(lists, "qid", "left").join(cites, "qid", "left")
    rx = F.nullif(F.trim("drug.rxcui"), F.lit(""))
    link = lambda text, url: F.when(url.isNotNull() & (url != ""), F.struct(F.lit(text).alias("label"), url.alias("url")))
    other = F.array_compact(F.array(link("RxNorm (UI)", F.concat(F.lit(K.DRUG_PAGE), rx)), link("RxNorm (REST)", F.concat(F.lit(K.DRUG_API), rx, F.lit(".json"))), link("RxNorm (drug record)", F.element_at("sources.entity_links", "rxnav")), link("SNOMED CT (concept)", F.element_at("sources.entity_links", "snomed"))))
    none = F.array().cast("array<struct<label:string,url:string>>")
    name = F.coalesce(F.nullif(F.trim("drug.matched_name"), F.lit("")), F.trim("drug.query_text"), F.lit(""))
    empty = F.array().cast("array<struct<text:string,score:double,citations:array<int>>>")
    shown = F.coalesce("bullets", empty)
    title = F.concat(F.when(name != "", name).otherwise("This product"), F.lit(" — "), F.coalesce(literal_map(K.INTENT_TITLES)[F.col("intent")], F.lit("Summary")))
    return rows.select(
        "qid", title.alias("title"), "intent", F.struct(name.alias("name"), F.coalesce("drug.rxcui", F.lit("")).alias("rxcui"), F.coalesce("drug.spl_set_id", F.lit("")).alias("spl_set_id")).alias("drug"),
        answer_line(F.col("intent"), name, F.transform(shown, lambda b: b["text"])).alias("answer"), shown.alias("bullets"), F.concat(F.coalesce("cites", none), other).alias("citations"), F.lit(K.DISCLAIMER).alias("disclaimer"),
        F.struct(F.size("evidence").alias("total_evidence"), F.least(F.size("evidence"), F.lit(limit)).alias("top_k")).alias("meta"),
    )


def _numbers(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit(" ["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))).otherwise("")


def format_cli(summaries: DataFrame) -> DataFrame:
    """(qid, output): summaries as plain text."""
    bullets = F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("• "), b["text"], _numbers(b["citations"]))), "\n")
    cites = F.array_join(F.transform("citations", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["label"], F.lit(": "), c["url"])), "\n")
    return summaries.select("qid", F.concat_ws("\n", "title", F.lit(""), F.when(F.col("answer") != "", F.concat("answer", F.lit("\n"))), F.when(F.size("bullets") > 0, bullets), F.lit(""), F.when(F.size("citations") > 0, F.concat(F.lit("Sources:\n"), cites, F.lit("\n"))), F.concat(F.lit("Note: "), "disclaimer")).alias("output"))


def format_markdown(summaries: DataFrame) -> DataFrame:
    """(qid, output): summaries as Markdown."""
    esc = lambda c: F.regexp_replace(c, r"([\\`*_{}\[\]()#+.!|-])", r"\\$1")
    bullets = F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("- "), esc(b["text"]), _numbers(b["citations"]))), "\n")
    cites = F.array_join(F.transform("citations", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". ["), esc(c["label"]), F.lit("]("), c["url"], F.lit(")"))), "\n")
    return summaries.select("qid", F.concat_ws("\n", F.concat(F.lit("# "), esc(F.col("title")), F.lit("\n")), F.when(F.col("answer") != "", F.concat(esc(F.col("answer")), F.lit("\n"))), F.when(F.size("bullets") > 0, bullets), F.lit(""), F.when(F.size("citations") > 0, F.concat(F.lit("## Sources\n"), cites, F.lit("\n"))), F.concat(F.lit("> "), "disclaimer")).alias("output"))


def format_json(summaries: DataFrame) -> DataFrame:
    return summaries.select("qid", F.to_json(F.struct(*[c for c in summaries.columns if c != "qid"])).alias("output"))


