"""Lexicons, and the resolution of drug and condition mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel import constants as K
from corbel.functions.keys import set_id
from corbel.functions.ranking import neighbour_confidence
from corbel.functions.text import drug_key, first_true, lexicon_key_ok, norm_lower, semantic_tag, strip_tag
from corbel.operators.likeness import similar
from corbel.operators.ordered import first_rows, top_rows


def drug_lexicon(master: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(key, spl_set_id): drug names by canonical key, the first label wins, the master before the metadata.

    Both have spl_set_id, ord and a map ``fields`` of their texts.
    """
    def named(df: DataFrame, source: int, wanted) -> DataFrame:
        fields = F.transform(F.filter(F.map_entries("fields"), lambda e: wanted(e["key"])), lambda e, k: F.struct(k.alias("k"), drug_key(e["value"]).alias("key")))
        return df.select("spl_set_id", "ord", F.explode(fields).alias("f")).select("f.key", "spl_set_id", F.struct(F.lit(source).alias("s"), F.col("ord").alias("o"), F.col("f.k").alias("k")).alias("ord"))

    rows = named(master.withColumn("spl_set_id", set_id("spl_set_id")), 0, lambda k: F.exists(F.array(*[F.lit(p) for p in K.NAME_KEY_PARTS]), lambda p: F.contains(F.lower(k), p)))
    if meta is not None:
        rows = rows.unionByName(named(meta, 1, lambda k: k.isin(K.NAME_KEYS)))
    return first_rows(rows.where("spl_set_id <> ''").where(lexicon_key_ok("key")), ["key"]).select("key", "spl_set_id")


def concept_names(docs: DataFrame) -> DataFrame:
    """(snomed_id, name, ord): all names of concepts: full name, preferred terms, synonyms."""
    default = F.col("terms.pt")["default"]["term"]
    every = F.array_compact(F.concat(F.array(F.col("terms.fsn.term"), default), F.transform(F.coalesce(F.map_values("terms.pt"), F.array().cast("array<struct<id:string,term:string>>")), lambda p: p["term"]), F.transform(F.coalesce("terms.synonyms", F.array().cast("array<struct<id:string,term:string,lang:string>>")), lambda s: s["term"])))
    rows = docs.select(F.col("conceptId").alias("snomed_id"), F.posexplode(F.filter(F.transform(every, lambda n: F.trim(n)), lambda n: n != "")).alias("k", "name"))
    return rows.select("snomed_id", "name", F.struct("snomed_id", "k").alias("ord"))


def condition_lexicon(*sources: DataFrame) -> DataFrame:
    """(key, snomed_id, name): first wins; the first source that has any name is the lexicon."""
    for names in sources:
        found = first_rows(names.select(norm_lower("name").alias("key"), "snomed_id", "name", "ord").where("key <> ''"), ["key"]).drop("ord")
        if not found.isEmpty():
            return found
    return found


def preferred_terms(docs: DataFrame) -> DataFrame:
    """(snomed_id, pt): the default preferred term, else the full name."""
    pt = F.coalesce(F.nullif(F.trim(F.col("terms.pt")["default"]["term"]), F.lit("")), F.nullif(F.trim("terms.fsn.term"), F.lit("")))
    return docs.select(F.col("conceptId").alias("snomed_id"), pt.alias("pt")).where("pt is not null").groupBy("snomed_id").agg(F.min("pt").alias("pt"))


def chunk_text_names(text: Column | str) -> tuple[Column, Column]:
    """(names, preferred) of a concept chunk's lines: full name, listed synonyms, preferred term."""
    t = F.col(text) if isinstance(text, str) else text
    fsn = F.nullif(F.regexp_extract(t, r"(?imd)^\s*FSN:\s*(.+?)\s*$", 1), F.lit(""))
    pt = F.nullif(F.regexp_extract(t, r"(?imd)^\s*PT:\s*(.+?)\s*$", 1), F.lit(""))
    block = F.regexp_extract(t, r"(?is)^.*?(?:^|\n)\s*Synonyms:\s*\n(.*)$", 1)
    listed = F.regexp_extract_all(block, F.lit(r"(?md)^\s*-\s*(.+?)\s*$"), F.lit(1))
    return F.array_distinct(F.array_compact(F.concat(F.array(fsn), listed, F.array(pt)))), F.coalesce(pt, fsn)


def tag_allowed(intent: Column, tag: Column) -> Column:
    """Whether an intent admits a semantic tag; without a tag only adverse effects do."""
    tag = F.nullif(F.lower(tag), F.lit(""))
    return first_true([(F.lower(intent) == i, F.when(tag.isNull(), F.lit(i == "adverse_effect")).otherwise(tag.isin(tags))) for i, tags in K.INTENT_TAGS.items()], F.lit(True))


def resolve_drugs(mentions: DataFrame, lexicon: DataFrame, drugs: DataFrame) -> DataFrame:
    """``mentions`` (qid, drug_text) with the struct ``drug``: by name as it is, else by canonical key."""
    q = F.trim("drug_text")
    one = lexicon.select(F.col("key").alias("k1"), F.col("spl_set_id").alias("s1"))
    two = lexicon.select(F.col("key").alias("k2"), F.col("spl_set_id").alias("s2"))
    rows = mentions.join(one, F.lower(q) == one.k1, "left").join(two, drug_key(F.lower(q)) == two.k2, "left").withColumn("sid", F.coalesce("s1", "s2"))
    rows = rows.join(drugs.select(F.col("spl_set_id").alias("k3"), "rxcui"), F.lower("sid") == F.col("k3"), "left")
    hit = F.col("sid").isNotNull()
    blank = F.coalesce(q, F.lit("")) == ""
    found = F.struct(F.when(blank, F.col("drug_text")).otherwise(q).alias("query_text"), F.when(hit, F.lower(q)).alias("matched_name"), F.col("sid").alias("spl_set_id"), F.col("rxcui").alias("rxcui"), F.when(hit, 1.0).otherwise(0.0).alias("confidence"), F.when(blank, "").when(hit, "lexicon").otherwise("no-hit").alias("note"))
    return rows.withColumn("drug", found).drop("k1", "s1", "k2", "s2", "k3", "sid", "rxcui")


def fuzzy(mentions: DataFrame, lexicon: DataFrame, cutoff: float = 88.0) -> DataFrame:
    """(qid, snomed_id, name, score): the likeliest lexicon name of each mention, the first of equals.

    Equal to holding every name against every mention, of any number of either;
    see ``likeness.similar`` for how pairs are found.  Mentions without words
    have none.
    """
    asked = mentions.select("qid", norm_lower("text").alias("q")).where("q <> ''")
    pairs = similar(asked.select(F.col("q").alias("text")), lexicon.select(F.col("key").alias("text")), cutoff)
    best = pairs.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("less"), "key")).alias("best")).select("q", "best.key", (-F.col("best.less")).alias("score"))
    first = lexicon.groupBy("key").agg(F.min(F.struct("snomed_id", "name")).alias("c")).select("key", "c.snomed_id", "c.name")
    return asked.distinct().join(best.join(first, "key"), "q").select("qid", "q", "snomed_id", "name", "score", "key").transform(lambda df: top_rows(df, ["qid"], [F.desc("score"), F.asc("key")])).select("qid", "snomed_id", "name", "score")


def resolve_conditions(mentions: DataFrame, lexicon: DataFrame, terms: DataFrame, hits: DataFrame | None = None, cutoff: float = 88.0, metric: str = "l2") -> DataFrame:
    """``mentions`` (qid, text, intent) with the struct ``condition``: exact name, else fuzzy, else nearest vectors.

    ``hits`` has qid, rank, distance, snomed_id, name and tag of each mention's
    neighbours; those whose tag the intent doesn't admit are left out.
    """
    def found(df: DataFrame, confidence: Column, note: Column) -> DataFrame:
        return df.join(terms, "snomed_id", "left").select("qid", F.struct("snomed_id", F.coalesce("pt", "name").alias("name"), confidence.alias("confidence"), note.alias("note")).alias("c"))

    asked = mentions.select("qid", "text", F.lower(F.trim(F.coalesce("intent", F.lit("")))).alias("intent"), norm_lower("text").alias("q")).where("q <> ''")
    exact = found(asked.join(lexicon, asked.q == lexicon.key), F.lit(0.92), F.lit("Lexicon-exact"))
    rest = asked.join(exact, "qid", "left_anti")
    near = found(fuzzy(rest, lexicon, cutoff), F.greatest(F.lit(0.85), F.col("score") / 100), F.lit("Lexicon-fuzzy"))
    every = exact.unionByName(near)
    if hits is not None:
        open_ = hits.join(rest.join(near, "qid", "left_anti").select("qid", "intent"), "qid").where(tag_allowed(F.col("intent"), F.col("tag")))
        open_ = open_.join(terms, "snomed_id", "left").withColumn("name", F.coalesce("pt", "name")).drop("pt")
        # Of a concept's names the longest so far counts, and of candidates the surest, then the longest name.
        best = top_rows(open_, ["qid"], [neighbour_confidence("distance", metric).desc(), F.length(F.coalesce("name", F.lit(""))).desc(), F.asc("rank")])
        note = F.when(F.coalesce("tag", F.lit("")) != "", F.concat(F.lit("Embedding ("), "tag", F.lit(")"))).otherwise("Embedding")
        every = every.unionByName(best.select("qid", F.struct("snomed_id", "name", neighbour_confidence("distance", metric).alias("confidence"), note.alias("note")).alias("c")))
    rows = mentions.join(every, "qid", "left")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    none = F.when(blank, "Empty query").when(F.coalesce(F.trim("intent"), F.lit("")) != "", "No tag-eligible hit").otherwise("No hit")
    struct = F.struct(F.col("text").alias("query_text"), F.col("c.snomed_id").alias("sctid"), F.col("c.name").alias("preferred_term"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("c.note", none).alias("note"))
    return rows.withColumn("condition", struct).drop("c")


def known_condition(text: Column | str) -> Column:
    """The struct ``condition`` of the few conditions that need no lexicon."""
    q = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    make = lambda i, p, c, n: F.struct(q.alias("query_text"), F.lit(i).cast("string").alias("sctid"), F.lit(p).cast("string").alias("preferred_term"), F.lit(c).alias("confidence"), F.lit(n).alias("note"))
    pairs = [(q == "", make(None, None, 0.0, "No condition provided"))] + [(F.lower(q) == k, make(i, p, c, "Lexicon-exact")) for k, (i, p, c) in K.KNOWN_CONDITIONS.items()]
    return first_true(pairs, make(None, None, 0.0, "Embedding"))


def filter_phrase(condition: str = "condition") -> Column:
    """What evidence is searched for: the preferred term if it is sure and holds the question's words, else those words."""
    q, pt = F.trim(F.coalesce(f"{condition}.query_text", F.lit(""))), F.trim(F.coalesce(f"{condition}.preferred_term", F.lit("")))
    return F.when((F.col(f"{condition}.confidence") >= 0.85) & (q != "") & F.contains(F.lower(pt), F.lower(q)), pt).otherwise(q)


def nearest_drugs(hits: DataFrame, drugs: DataFrame) -> DataFrame:
    """Per query the first neighbour whose label has a drug, else the first with a label, else none.

    ``hits`` has query_id, rank, spl_set_id and title; ``drugs`` spl_set_id, rxcui and tty.
    """
    rows = hits.withColumn("spl_set_id", F.lower("spl_set_id")).join(drugs, "spl_set_id", "left")
    order = F.struct(F.when(F.col("rxcui").isNotNull(), 0).when(F.coalesce("spl_set_id", F.lit("")) != "", 1).otherwise(2).alias("w"), F.col("rank"))
    best = rows.groupBy("query_id").agg(F.min_by(F.struct("spl_set_id", "title", "rxcui", "tty"), order).alias("b"), F.min_by(F.coalesce("spl_set_id", F.lit("")), "rank").alias("top_label"))
    mapped, labelled = F.col("b.rxcui").isNotNull(), F.col("top_label") != ""
    return best.select(
        "query_id", "b.rxcui", F.when(mapped, 0.85).when(labelled, 0.6).otherwise(0.0).alias("confidence"), F.when(mapped | labelled, F.col("b.spl_set_id")).alias("spl_set_id"), F.when(mapped | labelled, F.col("b.title")).alias("title"),
        F.when(mapped, F.concat(F.lit("NN→SPL→RxCUI (primary/fallback TTY="), F.coalesce("b.tty", F.lit("")), F.lit(")"))).when(labelled, "NN→SPL (no RxCUI map)").otherwise("No hit").alias("note"),
    )


def hit_names(rows: DataFrame) -> DataFrame:
    """(row_id, snomed_id, name, tag) of concept chunks as neighbours' metadata."""
    names, preferred = chunk_text_names("text")
    fsn = F.regexp_extract("text", r"(?imd)^\s*FSN:\s*(.+?)\s*$", 1)
    return rows.select("row_id", F.col("conceptId").alias("snomed_id"), F.coalesce(preferred, F.get(names, F.lit(0)), strip_tag(fsn)).alias("name"), semantic_tag(fsn).alias("tag"))


