"""The engine's operators over the driver's tables, each with its SQL.

The tables stand in for the engine's own: documents for label texts, orders and
customers for labels and drugs, line items for links, events for attributes.
Arrays come out as joined text, so that both engines print them alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel import constants as K
from corbel.functions import keys as keys_
from corbel.functions import ranking
from corbel.functions import text as text_
from corbel.operators import chunker, concepts, dictionary, drugs, links, names, resolve, semantic, vectors
from corbel.operators.cut import materialize, shared_dir, small_batches
from corbel.operators.ordered import first_rows, newest_rows, ordered_list, sorted_set, top_rows
from corbel.plans import answer, evidence, questions
from corbel.plans.engine import Engine
from corbel.sources import labels
from corbel.sources.relation_index import RelationIndex
from corbel.sources.vector_index import VectorIndex
from corbel.streaming import newest
from corbel.streaming.crosswalk import CrosswalkStore

Query = Callable[[SparkSession, str], DataFrame]

#: Terms of the small lexicon that documents are matched with.
TERMS = ["that", "with", "this", "from"]
TS = "2024-01-01T00:00:00+00:00"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _case(column: str, values: dict, other: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + f" ELSE {other} END"


# --- dictionary match -------------------------------------------------------

_SPANS_SQL = f"""
WITH d AS (SELECT doc_id, lower(text) AS low FROM documents),
m AS (SELECT doc_id, low, t.term, unnest(generate_series(1, length(low) - length(t.term) + 1)) AS p
      FROM d, (SELECT unnest({TERMS}) AS term) t WHERE contains(low, t.term)),
h AS (SELECT doc_id, low, term, p - 1 AS s, p - 1 + length(term) AS e FROM m WHERE substring(low, p, length(term)) = term),
w AS (SELECT *, substring(low, greatest(s - 80, 0) + 1, e + 80 - greatest(s - 80, 0)) AS around FROM h)
SELECT doc_id, term, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end,
  (contains(around, ' not ') OR contains(around, ' no ') OR contains(around, ' without ') OR contains(around, ' denies ')) AS negated,
  CAST(CASE WHEN length(term) < 4 THEN 0.6 WHEN length(term) < 8 THEN 0.78 ELSE 0.9 END AS DOUBLE) AS confidence FROM w
"""


def _spans(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "term", F.col("start").alias("char_start"), F.col("end").alias("char_end"), dictionary.negated("around").alias("negated"), ranking.surface_confidence("term").alias("confidence"))


@_query(_SPANS_SQL)
def dict_match_spans(s, d):
    docs = _t(s, d, "documents")
    lex = s.createDataFrame([(t,) for t in TERMS], "term string")
    return _spans(dictionary.spans(docs, lex, "doc_id"))


@_query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents)
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS hits FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN ({', '.join(f"'{t}'" for t in TERMS)}) GROUP BY ALL
""")
def dict_match_words(s, d):
    docs = _t(s, d, "documents")
    lex = s.createDataFrame([(t,) for t in TERMS], "term string")
    return dictionary.spans(docs, lex, "doc_id", words=True).groupBy("doc_id", "term").agg(F.count("*").alias("hits"))


@_query(r"""WITH l AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark))),
p AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS x FROM documents),
k AS (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS i FROM p),
m AS (SELECT doc_id, i, x[i] || ' ' || x[i + 2] AS term FROM k WHERE x[i + 1] = ' '),
h AS (SELECT m.doc_id, m.i, m.term FROM m JOIN l USING (term)),
r AS (SELECT *, i - 2 * row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY i) AS nth FROM r)
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS hits FROM o WHERE nth % 2 = 1 GROUP BY ALL""")
def dict_match_index(s, d):
    """Two-word terms, all that the benchmark's passages have, as whole words of the documents; the lexicon is joined."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(dictionary.WORD), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    terms = _t(s, d, "benchmark").select(F.explode(pairs).alias("term"))
    return dictionary.whole_words(_t(s, d, "documents"), terms, "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("hits"))


@_query(_SPANS_SQL.replace("SELECT doc_id, term, CAST(s", "SELECT doc_id, CAST(bool_and(negated) AS BOOLEAN) AS all_negated, CAST(count(*) AS BIGINT) AS hits FROM (SELECT doc_id, term, CAST(s") + ") GROUP BY doc_id")
def all_negated_flag(s, d):
    found = dict_match_spans(s, d).groupBy("doc_id").agg(F.collect_list(F.struct("negated")).alias("examples"))
    return found.select("doc_id", links.all_negated(F.col("examples")).alias("all_negated"), F.size("examples").cast("long").alias("hits"))


@_query("""SELECT b.item_id, CAST(count(*) AS BIGINT) AS docs, min(d.doc_id) AS first_doc
FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text)) GROUP BY b.item_id""")
def passage_contains(s, d):
    items = _t(s, d, "benchmark").select("item_id", F.lower("text").alias("term"))
    found = dictionary.spans(_t(s, d, "documents"), items, "doc_id").select("doc_id", "term").distinct().join(items, "term")
    return found.groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@_query("""WITH c AS (SELECT t.term, source, count(*) AS n, min(doc_id) AS o FROM documents d, (SELECT unnest(['that','with','this','from']) AS term) t WHERE contains(lower(text), term) GROUP BY ALL)
SELECT term, source, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, o) AS k FROM c) WHERE k = 1""")
def label_election(s, d):
    rows = _t(s, d, "documents").select(F.col("source").alias("spl_set_id"), F.col("doc_id").alias("ord"), "text")
    asked = s.createDataFrame([(t, t, "") for t in TERMS], "qid string, drug_name string, question_label string")
    won = evidence.elect_labels(asked, rows)
    counts = dictionary.holding(rows.select("spl_set_id", F.lower("text").alias("text")), asked.select(F.col("drug_name").alias("term"))).groupBy("term", "spl_set_id").agg(F.count("*").alias("n"))
    return won.join(counts, (won.qid == counts.term) & (won.elected == counts.spl_set_id)).select("term", F.col("elected").alias("source"), "n")


# --- vectors ----------------------------------------------------------------

_VECTORS_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, e.vec_id AS row_id, {score} AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {way}, row_id) AS k FROM p)
SELECT query_id, row_id, CAST(k AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE k <= 5
"""


def _vectors(s, d, run, metric):
    rows = _t(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    asked = rows.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("vec").alias("qvec"))
    return run(asked, rows, 5, metric).select("query_id", "row_id", "rank", F.round("score", 6).alias("score"))


@_query(_VECTORS_SQL.format(score="list_inner_product(a, e.embedding::DOUBLE[])", way="DESC"))
def vector_topk(s, d):
    return _vectors(s, d, vectors.search, "ip")


@_query(_VECTORS_SQL.format(score="list_distance(a, e.embedding::DOUBLE[]) * list_distance(a, e.embedding::DOUBLE[])", way="ASC"))
def vector_topk_l2(s, d):
    return _vectors(s, d, vectors.search, "l2")


@_query("""SELECT vec_id, label, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm,
round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / ((sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9) * (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9)), 5) AS self_cosine FROM embeddings""")
def vector_norms(s, d):
    return _t(s, d, "embeddings").select("vec_id", "label", F.round(ranking.norm("embedding"), 5).alias("norm"), F.round(ranking.cosine("embedding", "embedding"), 5).alias("self_cosine"))


@_query(_VECTORS_SQL.format(score="list_inner_product(a, e.embedding::DOUBLE[])", way="DESC").replace("SELECT query_id, row_id,", "SELECT query_id, row_id, (SELECT label FROM embeddings x WHERE x.vec_id = row_id) AS label,"))
def vector_meta_join(s, d):
    meta = _t(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return vectors.with_meta(vector_topk(s, d), meta).select("query_id", "row_id", "label", "rank", "score")


@_query(_VECTORS_SQL.format(score="list_inner_product(a, e.embedding::DOUBLE[])", way="DESC").replace("SELECT query_id, row_id,", "SELECT query_id, row_id, (SELECT label FROM embeddings x WHERE x.vec_id = row_id) AS label,"))
def vector_index(s, d):
    """An index of the even ids, the odd ones appended, opened again and searched; labels by ordinal."""
    rows = _t(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")
    path = f"{shared_dir(s)}/corbel/{s.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    VectorIndex.create(rows.where("row_id % 2 = 0"), path).append(rows.where("row_id % 2 <> 0"))
    index = VectorIndex.load(s, path)
    hits = index.search(rows.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("vec").alias("qvec")), 5)
    named = index.rows_at(hits).select("ordinal", "row.label")
    return hits.join(named, "ordinal").select("query_id", "row_id", "label", "rank", F.round("score", 6).alias("score"))


@_query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, e.vec_id AS row_id, label, list_inner_product(a, e.embedding::DOUBLE[]) AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS k FROM p),
h AS (SELECT query_id, k, 'l' || label AS spl FROM r WHERE k <= 5),
m AS (SELECT h.*, CASE WHEN l.quality = 1 THEN CAST(l.doc_id AS VARCHAR) END AS rx FROM h LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON h.spl = 'l' || l.doc_id AND l.quality = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rx IS NOT NULL THEN 0 ELSE 1 END, k) AS w FROM m)
SELECT query_id, rx AS rxcui, spl AS spl_set_id, CAST(CASE WHEN rx IS NOT NULL THEN 0.85 ELSE 0.6 END AS DOUBLE) AS confidence FROM b WHERE w = 1""")
def nearest_drug(s, d):
    hits = vector_meta_join(s, d).select("query_id", "rank", F.concat(F.lit("l"), F.col("label").cast("string")).alias("spl_set_id"), F.lit("t").alias("title"))
    known = _t(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select(F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("spl_set_id"), F.col("doc_id").cast("string").alias("rxcui"), F.lit("IN").alias("tty"))
    return resolve.nearest_drugs(hits, known).select("query_id", "rxcui", "spl_set_id", "confidence")


@_query()
def semantic_vectors(s, d):
    """Documents by the encoder that is fitted on all of them."""
    docs = _t(s, d, "documents").select("doc_id", "text")
    coded = vectors.encode(docs, "text", semantic.fit_semantic(docs), column="vec")
    return coded.select("doc_id", F.transform("vec", lambda x: F.round(x.cast("double"), 4)).alias("vec"))


# --- first, last, newest ----------------------------------------------------

@_query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY strftime(ts, '%Y%m%d%H%M%S') DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def newest_wins(s, d):
    rows = _t(s, d, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return newest_rows(rows, ["user_id", "event_type"], "date", "event_id").select("user_id", "event_type", "event_id", "value")


@_query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY strftime(ts, '%Y%m%d%H%M%S') DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def newest_by_state(s, d):
    """The same as a stream that keeps one row of each key as state; changes are logged batch by batch."""
    path = f"{shared_dir(s)}/corbel/{s.sparkContext.applicationId}/newest-{uuid.uuid4().hex}"
    whole = _t(s, d, "events")
    # As a pattern, for a stream's path may not be one file.
    rows = s.readStream.schema(whole.schema).parquet(f"{d}/events.parque[t]").withColumn("day", F.date_format("ts", "yyyyMMddHHmmss"))
    query = newest.log_newest(rows, f"{path}/log", ["user_id", "event_type"], "day", "event_id", f"{path}/checkpoint")
    query.awaitTermination()
    return newest.newest_table(s, f"{path}/log", rows.schema, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


@_query("SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def first_wins(s, d):
    rows = _t(s, d, "lineitem").withColumn("ord", F.struct("l_orderkey", "l_linenumber"))
    return first_rows(rows, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "l_orderkey")


# --- questions --------------------------------------------------------------

def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


_INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(q, '{_sql_text(p)}', 'i') THEN 'interaction'" for p in K.INTERACTION_QUESTIONS) + " " + " ".join(f"WHEN regexp_matches(lower(q), '{_sql_text(p)}') THEN '{i}'" for p, i in K.INTENT_QUESTIONS) + " ELSE 'overview' END"


@_query(f"SELECT conv_id, turn, {_INTENT_SQL} AS intent FROM (SELECT *, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS q FROM conversations)")
def intent_detect(s, d):
    return _t(s, d, "conversations").select("conv_id", "turn", questions.intent_of(F.col("text")).alias("intent"))


#: Questions of every form over two words of a part's name (a, b) and its brand.
_FORMS = [
    "Can I take {a} with {b}?", "what are the side effects of {a} {b}", "indications for {a} {b}?", "Is {b} contraindicated in {a} failure?", "tell me about {a} {b} for the elderly", "what is the dosage of {b} in Children.",
    "boxed warning {a}", "give me the info on {b} therapy with {c}", "What treats {a} in {c}", "uses of {a} {b} for {c}!", "use {c} with {d}", "adverse effects {b}", "breast feeding", "treatment of 5 {b} for 7 {a}", "Mechanism of action of {c}",
]


def _questions(s, d) -> DataFrame:
    """(qid, text): a question for each part."""
    words = F.split("p_name", " ")
    told = {"a": words[0], "b": F.get(words, F.lit(1)), "c": F.col("p_brand"), "d": F.initcap("p_type")}
    forms = [F.concat(*[told[x[1]] if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{.)\}", f) if x]) for f in _FORMS]
    return _t(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("qid"), F.get(F.array(*forms), (F.col("p_partkey") % len(forms)).cast("int")).alias("text"))


def _form_sql(form: str) -> str:
    told = {"a": "split_part(p_name, ' ', 1)", "b": "split_part(p_name, ' ', 2)", "c": "p_brand", "d": "upper(p_type[1]) || lower(p_type[2:])"}
    return " || ".join(told[x[1]] if x[:1] == "{" else f"'{_sql_text(x)}'" for x in re.split(r"(\{.)\}", form) if x)


_QUESTIONS_CTE = "qq AS (SELECT 'p' || p_partkey AS qid, CASE p_partkey % " + str(len(_FORMS)) + " " + " ".join(f"WHEN {k} THEN {_form_sql(f)}" for k, f in enumerate(_FORMS)) + " END AS text FROM part)"
_TURNS = " UNION ALL SELECT conv_id || '-' || turn, text FROM conversations)"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _first_sql(text: str, patterns: list[str], group: int = 1) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{_sql_text(p)}', {group}), '')" for p in patterns) + ")"


def _pairs_sql(group: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(q, '(?i){_sql_text(p)}') THEN trim(regexp_extract(q, '(?i){_sql_text(p)}', {group}), {_BLANK})" for p in K.INTERACTION_QUESTIONS) + " END"


_OPENING = _sql_text(r"(?i)^\s*" + "".join(f"(?:{p})?" for p in K.QUESTION_OPENINGS))
_PARSE_SQL = f"""WITH {_QUESTIONS_CTE[:-1] + _TURNS},
t AS (SELECT qid, coalesce(text, '') AS text, trim(coalesce(text, ''), {_BLANK}) AS q FROM qq),
i AS (SELECT *, {_INTENT_SQL} AS intent, trim(trim(regexp_replace(q, '{_OPENING}', ''), ' ?!.,;:'), {_BLANK}) AS about FROM t),
s AS (SELECT *, CASE WHEN intent = 'interaction' THEN {_pairs_sql(1)} END AS l, CASE WHEN intent = 'interaction' THEN {_pairs_sql(2)} END AS r,
  CASE intent WHEN 'adverse_effect' THEN trim(nullif(regexp_extract(about, '(?i){_sql_text(K.EFFECTS_OF)}', 1), ''), {_BLANK}) WHEN 'indication' THEN nullif(trim(nullif(regexp_extract(text, '(?i){_sql_text(K.INDICATIONS_FOR)}', 1), ''), ' ?!.,;:'), '') END AS span FROM i),
p AS (SELECT qid, 1 AS k, coalesce(l, span, about) AS x FROM s UNION ALL SELECT qid, 2, r FROM s WHERE r IS NOT NULL),
w AS (SELECT qid, k, regexp_extract_all(lower(x), '[a-z0-9][a-z0-9''-]*') AS w FROM p),
g AS (SELECT qid, k, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (SELECT unnest([1,2,3,4,5,6]) AS n) WHERE len(w) >= n),
lex AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_partkey % 2 = 0 UNION SELECT lower(split_part(p_name, ' ', 1)) FROM part WHERE p_partkey % 3 = 0 UNION SELECT unnest({TERMS})),
h AS (SELECT qid, k, key, row_number() OVER (PARTITION BY qid, k ORDER BY n DESC, i) AS z FROM g JOIN lex ON array_to_string(w[i:i + n - 1], ' ') = key WHERE len(list_filter(w[i:i + n - 1], lambda v: NOT list_contains([{", ".join("'" + _sql_text(w) + "'" for w in K.STOP_WORDS)}], v))) > 0),
m AS (SELECT qid, max(key) FILTER (k = 1) AS one, max(key) FILTER (k = 2) AS two FROM h WHERE z = 1 GROUP BY qid)
SELECT qid, intent, coalesce(one, CASE WHEN l IS NOT NULL THEN two END, l, span) AS drug_text,
  CASE WHEN l IS NOT NULL THEN CASE WHEN one IS NULL AND two IS NOT NULL THEN l ELSE coalesce(two, r) END WHEN intent = 'adverse_effect' OR span IS NOT NULL THEN NULL
  ELSE trim(regexp_replace(trim(nullif(regexp_extract(text, '(?i){_sql_text(K.CONDITION_AFTER)}', 1), ''), ' ?!.,;:''"'), '\\s+', ' ', 'g')) END AS condition_text
FROM s LEFT JOIN m USING (qid)"""


@_query(_PARSE_SQL)
def question_parse(s, d):
    part = _t(s, d, "part")
    lex = part.where("p_partkey % 2 = 0").select(F.lower("p_name").alias("key")).union(part.where("p_partkey % 3 = 0").select(F.lower(F.split("p_name", " ")[0]))).union(s.createDataFrame([(t,) for t in TERMS], "key string"))
    turns = _t(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")
    return questions.parse_questions(_questions(s, d).unionByName(turns), lex).drop("text")


@_query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]*') AS w FROM conversations),
g AS (SELECT conv_id, turn, n.n, unnest(generate_series(1, len(w) - n.n + 1)) AS i, w FROM w, (SELECT unnest([1,2,3,4,5,6]) AS n) n WHERE len(w) >= n.n),
k AS (SELECT DISTINCT lower(word) AS key FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) UNION SELECT unnest(['these','have','were','is it']) AS key),
m AS (SELECT conv_id, turn, n, i, array_to_string(w[i:i + n - 1], ' ') AS name, w[i:i + n - 1] AS ws FROM g),
h AS (SELECT m.* FROM m JOIN k ON m.name = k.key WHERE len(list_filter(ws, lambda x: NOT list_contains([""" + ", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS) + """], x))) > 0)
SELECT conv_id || '-' || turn AS qid, name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i) AS r FROM h) WHERE r = 1""")
def lexicon_ngram_match(s, d):
    rows = _t(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")
    lex = _t(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("key")).distinct().union(s.createDataFrame([(k,) for k in ("these", "have", "were", "is it")], "key string"))
    return questions.names_in_questions(rows, lex)


_ROUTES_SQL = f"""WITH {_QUESTIONS_CTE},
t AS (SELECT qid, text, CASE {" ".join(f"WHEN regexp_matches(lower(text), '{_sql_text(p)}') THEN '{r}'" for r, p in K.ROUTES)} END AS told,
  nullif(trim({_first_sql("text", K.ROUTE_DRUGS)}, ' ?.,'), '') AS drug, nullif(trim({_first_sql("text", K.ROUTE_CONDITIONS)}, ' ?.,'), '') AS cond, nullif(trim({_first_sql("text", [K.ROUTE_GUESS])}, ' ?.,'), '') AS guess FROM qq)
SELECT qid, coalesce(told, CASE WHEN drug IS NULL AND cond IS NOT NULL THEN 'condition' ELSE 'drug' END) AS route, CASE WHEN told IS NULL OR told = 'safety' THEN drug END AS drug_mention,
  CASE WHEN told = 'condition' THEN coalesce(cond, guess) WHEN told = 'safety' OR drug IS NULL THEN cond END AS condition_mention FROM t"""


@_query(_ROUTES_SQL)
def question_routes(s, d):
    return questions.route_questions(_questions(s, d)).drop("text")


# --- labels and drugs -------------------------------------------------------

@_query("""WITH by_id AS (SELECT DISTINCT o_orderkey, CAST(o_custkey AS VARCHAR) AS spl_set_id, CAST(c_nationkey AS VARCHAR) AS rxcui, 'spl_set_id' AS via FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'),
by_code AS (SELECT DISTINCT o_orderkey, CAST(o_custkey AS VARCHAR) AS spl_set_id, 's' || l_suppkey AS rxcui, 'ndc11' AS via FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE NOT EXISTS (SELECT 1 FROM by_id b WHERE b.o_orderkey = orders.o_orderkey))
SELECT spl_set_id, rxcui, via FROM by_id UNION ALL SELECT spl_set_id, rxcui, via FROM by_code""")
def link_fallback(s, d):
    orders, line = _t(s, d, "orders"), _t(s, d, "lineitem")
    labels = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("spl_set_id"), F.array(F.lpad(F.col("o_orderkey").cast("string"), 11, "0")).alias("ndcs"))
    none = F.array().cast("array<string>")
    by_id = _t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").cast("string").alias("rxcui"), F.array(F.col("c_custkey").cast("string")).alias("spl_set_ids"), none.alias("ndc11s"))
    by_code = line.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("rxcui"), none.alias("spl_set_ids"), F.array(F.lpad(F.col("l_orderkey").cast("string"), 11, "0")).alias("ndc11s"))
    return links.label_drug_links(labels, by_id.unionByName(by_code))


_PRIO_TYPE = {"1-URGENT": "SCD", "2-HIGH": "SBD", "3-MEDIUM": "BPCK", "4-NOT SPECIFIED": "IN", "5-LOW": "PSN"}


def _resolved(s, d):
    orders = _t(s, d, "orders")
    raw = orders.select(F.col("o_custkey").cast("string").alias("spl_set_id"), F.col("o_orderkey").cast("string").alias("rxcui"), F.when(F.col("o_orderstatus") == "F", "spl_set_id").otherwise("ndc11").alias("via"))
    meta = orders.select(F.col("o_orderkey").cast("string").alias("rxcui"), text_.literal_map(_PRIO_TYPE)[F.col("o_orderpriority")].alias("tty"), (F.col("o_totalprice") > 150000).alias("has_ndc"))
    return raw, links.resolve_links(raw, meta)


_RESOLVED_CTE = f"""r AS (SELECT CAST(o_custkey AS VARCHAR) AS spl_set_id, CAST(o_orderkey AS VARCHAR) AS rxcui, o_orderkey, {_case("o_orderpriority", _PRIO_TYPE, "''")} AS tty, o_totalprice > 150000 AS has_ndc, CASE WHEN o_orderstatus = 'F' THEN 'spl_set_id' ELSE 'ndc11' END AS via FROM orders),
sc AS (SELECT *, {_case("tty", K.LINK_TYPE_WEIGHT, "0")} + CASE WHEN has_ndc THEN 60 ELSE 0 END + CASE WHEN via = 'spl_set_id' THEN 5 ELSE 0 END AS score FROM r),
rk AS (SELECT *, row_number() OVER (PARTITION BY spl_set_id ORDER BY score DESC, o_orderkey) AS k FROM sc)"""


@_query(f"""WITH {_RESOLVED_CTE}
SELECT spl_set_id, max(rxcui) FILTER (k = 1) AS rxcui, max(tty) FILTER (k = 1) AS tty, CAST(max(score) FILTER (k = 1) AS INTEGER) AS score, CAST(count(*) - 1 AS BIGINT) AS others, coalesce(string_agg(rxcui, ',' ORDER BY k) FILTER (k > 1), '') AS secondary FROM rk GROUP BY 1""")
def resolve_primary(s, d):
    found = _resolved(s, d)[1]
    return found.select("spl_set_id", "primary.rxcui", "primary.tty", "primary.score", F.size("secondary").cast("long").alias("others"), F.array_join(F.transform("secondary", lambda x: x["rxcui"]), ",").alias("secondary"))


@_query(f"""WITH {_RESOLVED_CTE}, p AS (SELECT spl_set_id, tty, (SELECT count(*) FROM rk x WHERE x.spl_set_id = rk.spl_set_id) - 1 AS n FROM rk WHERE k = 1)
SELECT tty, CAST(count(*) AS BIGINT) AS labels, round(avg(n), 6) AS mean_secondary FROM p GROUP BY 1""")
def primary_type_histogram(s, d):
    return links.type_histogram(_resolved(s, d)[1]).withColumn("mean_secondary", F.round("mean_secondary", 6))


@_query("""WITH l AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS linked, CAST(count(*) FILTER (f) AS BIGINT) AS via_spl, CAST(count(*) FILTER (NOT f) AS BIGINT) AS via_ndc, CAST(count(*) FILTER (n > 1) AS BIGINT) AS conflicts FROM l""")
def link_report(s, d):
    return links.link_report(_resolved(s, d)[0])


@_query(f"""WITH {_RESOLVED_CTE} SELECT spl_set_id, rxcui, tty FROM rk WHERE k = 1""")
def label_to_drug(s, d):
    return links.label_to_drug(_resolved(s, d)[1])


_FALLBACK = {t: k for k, t in enumerate(K.FALLBACK_TYPES)}


@_query(f"""WITH {_RESOLVED_CTE}, f AS (SELECT spl_set_id, rxcui, tty, row_number() OVER (PARTITION BY spl_set_id ORDER BY {_case("tty", _FALLBACK, "99")}, k) AS z FROM rk WHERE k > 1)
SELECT spl_set_id, rxcui, tty FROM f WHERE z = 1""")
def label_to_drug_by_type(s, d):
    """The drugs of labels whose primary one is unknown, by the order of types."""
    lost = F.struct(F.lit("").alias("rxcui"), F.lit("").alias("tty"), F.lit(False).alias("has_ndc"), F.lit("").alias("via"), F.lit(0).alias("score"))
    return links.label_to_drug(_resolved(s, d)[1].withColumn("primary", lost), prefer_types=True)


_SEGMENT_TYPE = {"BUILDING": "SBD", "AUTOMOBILE": "SCD", "MACHINERY": "BN", "HOUSEHOLD": "IN", "FURNITURE": "DF"}


@_query(f"""WITH t AS (SELECT CAST(c_nationkey AS VARCHAR) AS rxcui, {_case("c_mktsegment", _SEGMENT_TYPE, "'XX'")} AS tty, c_custkey AS o FROM customer),
w AS (SELECT *, row_number() OVER (PARTITION BY rxcui ORDER BY {_case("tty", K.REPRESENTATIVE_TYPE, "0")} DESC, o) AS k FROM t),
h AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS rxcui FROM supplier WHERE s_acctbal > 0)
SELECT w.rxcui, tty, h.rxcui IS NOT NULL AS has_ndc FROM w LEFT JOIN h USING (rxcui) WHERE k = 1""")
def has_meta_default(s, d):
    conso = _t(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("RXCUI"), F.coalesce(text_.literal_map(_SEGMENT_TYPE)[F.col("c_mktsegment")], F.lit("XX")).alias("TTY"), F.col("c_custkey").alias("ord"))
    keys = _t(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("rxcui"), F.when(F.col("s_acctbal") > 0, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")).alias("ndc11s"))
    return drugs.drug_meta(conso, keys)


_WORD_TYPE = {"ECONOMY": "SCD", "STANDARD": "SBD", "PROMO": "IN", "SMALL": "BN", "MEDIUM": "SY", "LARGE": "DF"}


@_query(f"""WITH c AS (SELECT p_brand AS rxcui, p_name AS str, {_case("split_part(p_type, ' ', 1)", _WORD_TYPE, "'XX'")} AS tty, CASE WHEN p_size > 25 THEN 'RXNORM' ELSE 'MTHSPL' END AS sab, p_partkey AS o FROM part),
n AS (SELECT *, lower(trim(regexp_replace(str, '\\s+', ' ', 'g'))) AS norm FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY rxcui ORDER BY {_case("tty", K.PREFERRED_TYPE, "1")} DESC, length(str), o) AS k FROM n WHERE sab = 'RXNORM'),
y AS (SELECT rxcui, norm, min(o) AS o FROM n GROUP BY ALL), z AS (SELECT rxcui, count(*) AS synonyms FROM y GROUP BY 1),
q AS (SELECT rxcui, string_agg(DISTINCT sab, ',' ORDER BY sab) AS sabs FROM n GROUP BY 1)
SELECT rxcui, str AS preferred_term, tty, norm AS normalized_name, {_case("tty", {k: v[1] for k, v in K.TYPE_KIND.items()}, "NULL")} AS node_kind, CAST(synonyms AS BIGINT) AS synonyms, sabs FROM p JOIN z USING (rxcui) JOIN q USING (rxcui) WHERE k = 1""")
def preferred_term(s, d):
    word = text_.literal_map(_WORD_TYPE)[F.split("p_type", " ")[0]]
    conso = _t(s, d, "part").select(F.col("p_brand").alias("RXCUI"), F.col("p_name").alias("STR"), F.coalesce(word, F.lit("XX")).alias("TTY"), F.when(F.col("p_size") > 25, "RXNORM").otherwise("MTHSPL").alias("SAB"), F.lit("N").alias("ISPREF"), F.lit("N").alias("SUPPRESS"), F.col("p_partkey").alias("ord"))
    return drugs.drug_master(conso, TS).select("rxcui", "preferred_term", "tty", "normalized_name", "node_kind", F.size("synonyms").cast("long").alias("synonyms"), F.array_join("sab_sources", ",").alias("sabs"))


_EVENT_NAMES = ["NDC11", "ROUTE", "STRENGTH", "UNII", "SPL_SET_ID"]


def _attributes(s, d):
    kinds = _t(s, d, "events").select("event_type").distinct().orderBy("event_type").withColumn("k", F.lit(1))
    order = ordered_list(F.col("event_type"), F.col("event_type"))
    listed = kinds.groupBy("k").agg(order.alias("l"))
    rows = _t(s, d, "events").withColumn("k", F.lit(1)).join(F.broadcast(listed), "k")
    name = F.get(F.array(*[F.lit(n) for n in _EVENT_NAMES]), F.array_position("l", F.col("event_type")).cast("int") - 1)
    return rows.select(F.col("user_id").cast("string").alias("rxcui"), F.coalesce(name, F.lit("OTHER")).alias("atn"), F.floor(F.col("value") * 10).cast("string").alias("atv"), F.lit("RXNORM").alias("sab"), F.lit("N").alias("suppress"), F.col("event_id").alias("ord"))


_ATTR_CTE = f"""k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events)),
a AS (SELECT CAST(user_id AS VARCHAR) AS rxcui, coalesce({_EVENT_NAMES}[n], 'OTHER') AS atn, CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS atv, event_id FROM events JOIN k USING (event_type))"""


@_query(f"""WITH {_ATTR_CTE} SELECT rxcui, """ + ", ".join(f"coalesce(string_agg(DISTINCT atv, ',' ORDER BY atv) FILTER (atn = '{n}'), '') AS {c}" for n, c in (("NDC11", "ndc11s"), ("ROUTE", "routes"), ("STRENGTH", "strengths"), ("UNII", "unii"))) + """ FROM a WHERE atn <> 'OTHER' GROUP BY 1""")
def eav_to_arrays(s, d):
    found = drugs.attribute_arrays(_attributes(s, d))
    return found.select("rxcui", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("ndc11s", "routes", "strengths", "unii")])


@_query(f"""WITH {_ATTR_CTE} SELECT rxcui, string_agg(DISTINCT atv, ',' ORDER BY atv) AS spl_set_ids FROM a WHERE atn = 'SPL_SET_ID' GROUP BY 1""")
def link_key_inversion(s, d):
    return drugs.link_keys(_attributes(s, d)).where(F.size("spl_set_ids") > 0).select("rxcui", F.array_join("spl_set_ids", ",").alias("spl_set_ids"))


@_query(f"""WITH {_ATTR_CTE}, g AS (SELECT rxcui, atn, CASE WHEN atn = 'NDC11' THEN regexp_replace(atv, '[^0-9]', '', 'g') ELSE atv END AS atv FROM a WHERE atn <> 'OTHER')
SELECT DISTINCT rxcui, atn, atv, 'RXNORM' AS sab FROM g""")
def attribute_rows(s, d):
    raw = _attributes(s, d).select(F.col("rxcui").alias("RXCUI"), F.col("atn").alias("ATN"), F.col("atv").alias("ATV"), F.col("sab").alias("SAB"), F.col("suppress").alias("SUPPRESS"), "ord")
    return drugs.drug_attributes(raw, _EVENT_NAMES, normalize=True).select("rxcui", "atn", "atv", "sab")


@_query(f"""WITH {_ATTR_CTE}, g AS (SELECT rxcui, atn, atv FROM a WHERE atn NOT IN ('OTHER', 'NDC11') UNION SELECT rxcui, 'NDC11', CASE length(regexp_replace(atv, '[^0-9]', '', 'g')) WHEN 11 THEN regexp_replace(atv, '[^0-9]', '', 'g') WHEN 10 THEN '0' || regexp_replace(atv, '[^0-9]', '', 'g') END FROM a WHERE atn = 'NDC11')
SELECT DISTINCT rxcui, atn, atv FROM g WHERE atv IS NOT NULL""")
def attribute_rows_emitting(s, d):
    raw = _attributes(s, d).select(F.col("rxcui").alias("RXCUI"), F.col("atn").alias("ATN"), F.col("atv").alias("ATV"), F.col("sab").alias("SAB"), F.col("suppress").alias("SUPPRESS"), "ord")
    return drugs.drug_attributes_emitting(raw, _EVENT_NAMES, normalize=True, emit_ndc=True, distinct="all").select("rxcui", "atn", "atv")


@_query("""SELECT l_partkey, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders, CAST(count(*) AS BIGINT) AS rows_, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS suppliers FROM (SELECT l_partkey, l_orderkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem) GROUP BY 1""")
def inverted_index(s, d):
    return _t(s, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.count("*").alias("rows_"), F.array_join(sorted_set(F.col("l_suppkey").cast("string")), ",").alias("suppliers"))


_FLAG_RELATION = {"A": "HAS_INGREDIENT", "N": "INGREDIENT_OF", "R": "CONSTITUTES"}


@_query(f"""WITH e AS (SELECT CAST(l_partkey AS VARCHAR) AS p, CAST(l_suppkey AS VARCHAR) AS q, l_returnflag AS f FROM lineitem)
SELECT DISTINCT CASE WHEN f = 'A' THEN p ELSE q END AS src_rxcui, CASE WHEN f = 'R' THEN 'has_part' ELSE 'has_ingredient' END AS rela, CASE WHEN f = 'A' THEN q ELSE p END AS dst_rxcui, 'RXNORM' AS sab FROM e""")
def edge_canonicalise(s, d):
    c = lambda n: F.col(n).cast("string")
    rel = _t(s, d, "lineitem").select(c("l_partkey").alias("RXCUI1"), F.lit("CUI").alias("STYPE1"), c("l_suppkey").alias("RXCUI2"), F.lit("CUI").alias("STYPE2"), text_.literal_map(_FLAG_RELATION)[F.col("l_returnflag")].alias("RELA"), F.lit("RXNORM").alias("SAB"), F.lit("N").alias("SUPPRESS"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return drugs.drug_relations(rel)


@_query("""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS rxcui, CAST(n_nationkey AS VARCHAR) AS nk, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT rxcui, string_agg(n_name, ',' ORDER BY nk) AS ingredients, max(c.c_name) AS preferred_term FROM x JOIN customer c ON x.rxcui = CAST(c.c_custkey AS VARCHAR) GROUP BY 1""")
def one_hop_names(s, d):
    cust, nation = _t(s, d, "customer"), _t(s, d, "nation")
    master = cust.select(F.col("c_custkey").cast("string").alias("rxcui"), F.col("c_name").alias("preferred_term"), F.lit("SCD").alias("tty"))
    master = master.unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("rxcui"), F.col("n_name").alias("preferred_term"), F.lit("IN").alias("tty")))
    rel = cust.select(F.col("c_custkey").cast("string").alias("src_rxcui"), F.lit("has_ingredient").alias("rela"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst_rxcui"), F.lit("RXNORM").alias("sab"))
    arrays = drugs.attribute_arrays(s.createDataFrame([], "rxcui string, atn string, atv string"))
    out = drugs.enrich(master, rel, arrays).where(F.size("ingredients") > 0)
    return out.select("rxcui", F.array_join(F.transform("ingredients", lambda x: x["name"]), ",").alias("ingredients"), "preferred_term")


@_query("""WITH e AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS rxcui, 's' || l_suppkey AS dst FROM lineitem),
i AS (SELECT rxcui, string_agg(dst || '=' || coalesce(s_name, ''), ',' ORDER BY dst) AS ingredients, CAST(count(*) AS INTEGER) AS n FROM e LEFT JOIN supplier ON dst = 's' || s_suppkey GROUP BY rxcui)
SELECT CAST(p_partkey AS VARCHAR) AS rxcui, p_name AS preferred_term, ingredients, coalesce(n, 0) AS n, p_brand AS brand FROM part LEFT JOIN i ON CAST(p_partkey AS VARCHAR) = rxcui""")
def one_hop_indexed(s, d):
    """All parts as drugs, their suppliers as ingredients and brands as codes, looked up in an index that is written and opened again."""
    key = lambda c, p="": F.concat(F.lit(p), F.col(c).cast("string"))
    part, supplier = _t(s, d, "part"), _t(s, d, "supplier")
    rel = _t(s, d, "lineitem").select(key("l_partkey").alias("src_rxcui"), F.lit("has_ingredient").alias("rela"), key("l_suppkey", "s").alias("dst_rxcui"), F.lit("RXNORM").alias("sab"))
    names = supplier.select(key("s_suppkey", "s").alias("rxcui"), F.col("s_name").alias("preferred_term"), F.lit("IN").alias("tty"))
    codes = part.select(key("p_partkey").alias("rxcui"), F.lit("UNII").alias("atn"), F.col("p_brand").alias("atv"))
    path = f"{shared_dir(s)}/corbel/{s.sparkContext.applicationId}/relations-{uuid.uuid4().hex}"
    RelationIndex.build(path, rel, names, codes).forget()
    out = RelationIndex.load(s, path).enrich(part.select(key("p_partkey").alias("rxcui"), F.col("p_name").alias("preferred_term")))
    shown = F.array_join(F.transform("ingredients", lambda x: F.concat(x["rxcui"], F.lit("="), F.coalesce(x["name"], F.lit("")))), ",")
    return out.select("rxcui", "preferred_term", F.when(F.size("ingredients") > 0, shown).alias("ingredients"), F.greatest(F.coalesce(F.size("ingredients"), F.lit(0)), F.lit(0)).alias("n"), F.get("unii", F.lit(0)).alias("brand"))


@_query("""SELECT CAST(count(*) AS BIGINT) AS rows_, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS active, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS defined FROM orders""")
def concept_counters(s, d):
    rf2 = _t(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyyMMdd").alias("effectiveTime"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("active"), F.lit("m").alias("moduleId"), F.when(F.col("o_orderpriority") == "1-URGENT", K.DEFINED).otherwise(K.PRIMITIVE).alias("definitionStatusId"), F.col("o_orderkey").alias("ord"))
    return concepts.counts(concepts.concept_rows(rf2, TS)).select(F.col("rows").alias("rows_"), "active", "defined")


@_query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y%m%d') DESC, o_orderkey DESC) AS k FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS snomed_id, strftime(o_orderdate, '%Y-%m-%d') AS effective_time, CAST(o_orderkey AS VARCHAR) AS module_id FROM w WHERE k = 1 AND o_orderstatus = 'F'""")
def latest_concepts(s, d):
    rf2 = _t(s, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyyMMdd").alias("effectiveTime"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("active"), F.col("o_orderkey").cast("string").alias("moduleId"), F.lit(K.DEFINED).alias("definitionStatusId"), F.col("o_orderkey").alias("ord"))
    return concepts.latest_concepts(concepts.concept_rows(rf2, TS)).select("snomed_id", "effective_time", "module_id")


@_query("""WITH x AS (SELECT CAST(n_nationkey AS VARCHAR) AS c, CAST(r_regionkey AS VARCHAR) AS p, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT c AS conceptId, string_agg('- ' || p || ': ' || r_name, '|' ORDER BY p) AS parent_lines FROM x GROUP BY 1""")
def parents_names_selfjoin(s, d):
    nation, region = _t(s, d, "nation"), _t(s, d, "region")
    rel = nation.select(F.col("n_nationkey").cast("string").alias("sourceId"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("destinationId"), F.lit("2024-01-01").alias("effective_time"), F.lit("m").alias("module_id"), F.lit(True).alias("active"), F.lit(K.IS_A).alias("typeId"), F.lit(True).alias("is_a"), F.lit(K.INFERRED).alias("characteristicTypeId"), F.col("n_nationkey").alias("ord"))
    up = concepts.parents(rel)
    term = "struct<id:string,term:string,lang:string>"
    docs = nation.select(F.col("n_nationkey").cast("string").alias("conceptId"), "n_name").unionByName(region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("conceptId"), F.col("r_name").alias("n_name")))
    docs = docs.join(up, "conceptId", "left").select("conceptId", F.lit(True).alias("is_fully_defined"), F.struct(F.struct(F.lit("").alias("id"), F.col("n_name").alias("term"), F.lit("en").alias("lang")).alias("fsn"), F.lit(None).cast("map<string,struct<id:string,term:string>>").alias("pt"), F.array().cast(f"array<{term}>").alias("synonyms")).alias("terms"), F.struct("parent_ids").alias("hierarchy"))
    core = concepts.concept_chunks(docs, TS).where("section = 'core' and contains(text, 'Parents:')")
    lines = F.regexp_replace(F.trim(F.split("text", "Parents:\n")[1]), "- r", "- ")
    return core.select("conceptId", F.regexp_replace(F.regexp_replace(lines, "\n$", ""), "\n", "|").alias("parent_lines"))


@_query("""SELECT p_partkey, lower(p_type) AS tag, p_name AS bare FROM part WHERE lower(p_type) IN ('economy', 'promo')""")
def semantic_tag_filter(s, d):
    rows = _t(s, d, "part").withColumn("fsn", F.concat("p_name", F.lit(" ("), F.col("p_type"), F.lit(")")))
    rows = rows.withColumn("tag", text_.semantic_tag("fsn")).where(F.col("tag").isin("economy", "promo"))
    return rows.select("p_partkey", "tag", text_.strip_tag("fsn").alias("bare"))


_TAGS = {"ECONOMY": "disorder", "STANDARD": "finding", "PROMO": "situation with explicit context", "SMALL": "substance", "MEDIUM": ""}


@_query(f"""WITH t AS (SELECT p_partkey, {_case("p_type", _TAGS, "NULL")} AS tag FROM part), i AS (SELECT unnest(['indication', 'Adverse_Effect', 'dosage']) AS intent)
SELECT p_partkey, intent, CASE lower(intent) WHEN 'indication' THEN coalesce(tag, '') IN ('disorder', 'situation with explicit context') WHEN 'adverse_effect' THEN coalesce(tag, '') IN ('', 'disorder', 'finding') ELSE true END AS allowed FROM t, i""")
def tag_gate(s, d):
    rows = _t(s, d, "part").select("p_partkey", text_.literal_map(_TAGS)[F.col("p_type")].alias("tag"), F.explode(F.array(F.lit("indication"), F.lit("Adverse_Effect"), F.lit("dosage"))).alias("intent"))
    return rows.select("p_partkey", "intent", resolve.tag_allowed(F.col("intent"), F.col("tag")).alias("allowed"))


def _concepts(s, d) -> DataFrame:
    """Parts as concepts: the brand is the concept's id, the name its full name, the container its synonym."""
    term = lambda c: F.struct(F.lit("").alias("id"), c.alias("term"), F.lit("en").alias("lang"))
    tag = F.coalesce(text_.literal_map(_TAGS)[F.col("p_type")], F.lit("event"))
    names = F.struct(term(F.concat("p_name", F.lit(" ("), tag, F.lit(")"))).alias("fsn"), F.lit(None).cast("map<string,struct<id:string,term:string>>").alias("pt"), F.array(term(F.upper("p_name")), term(F.concat(F.lit(" "), "p_brand"))).alias("synonyms"))
    return _t(s, d, "part").select(F.col("p_partkey").cast("string").alias("conceptId"), names.alias("terms"))


_CONCEPT_TAG = _case("p_type", _TAGS, "'event'")


@_query(f"""WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS snomed_id, p_name, p_brand, {_CONCEPT_TAG} AS tag FROM part)
SELECT snomed_id, term, surface FROM (SELECT snomed_id, lower(p_name) AS term, p_name AS surface FROM c WHERE tag IN ('disorder', 'finding', 'event') UNION ALL SELECT snomed_id, lower(p_brand), p_brand FROM c WHERE tag IN ('disorder', 'finding', 'event'))""")
def concept_lexicon(s, d):
    return dictionary.lexicon(_concepts(s, d)).select("snomed_id", "term", "surface")


@_query(f"""WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, p_brand, {_CONCEPT_TAG} AS tag FROM part),
n AS (SELECT id, 0 AS k, trim(p_name || ' (' || tag || ')') AS name FROM c UNION ALL SELECT id, 1, upper(p_name) FROM c UNION ALL SELECT id, 2, trim(p_brand) FROM c)
SELECT lower(name) AS key, arg_min(id, id || '-' || k) AS snomed_id, arg_min(name, id || '-' || k) AS name FROM n GROUP BY 1""")
def condition_lexicon(s, d):
    return resolve.condition_lexicon(resolve.concept_names(_concepts(s, d)))


@_query(f"""SELECT CAST(p_partkey AS VARCHAR) AS snomed_id, p_name || ' (' || {_CONCEPT_TAG} || ')' AS pt FROM part""")
def preferred_concept_terms(s, d):
    return resolve.preferred_terms(_concepts(s, d))


@_query("""WITH r AS (SELECT '00000000-0000-0000-0000-' || lpad(CAST(p_size AS VARCHAR), 12, '0') AS sid, p_partkey AS o, 0 AS src, unnest([{'k': 'brand_name', 'v': p_brand || ' Tablets'}, {'k': 'title', 'v': p_name || ' (HCl), 5 mg'}]) AS f FROM part UNION ALL SELECT 'm' || p_size, p_partkey, 1, {'k': 'display_name', 'v': p_type} FROM part),
k AS (SELECT sid, o, src, f.k AS k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(f.v), '\\b(hcl|tablets)\\b', ' ', 'g'), '\\b(?:mg|mcg|g|ml)\\b', ' ', 'g'), '[()\\[\\],.;:]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM r)
SELECT key, arg_min(sid, {'a': src, 'b': o, 'c': k}) AS spl_set_id FROM k GROUP BY 1""")
def drug_lexicon(s, d):
    part = _t(s, d, "part")
    rows = part.select(F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("p_size").cast("string"), 12, "0")).alias("spl_set_id"), F.create_map(F.lit("brand_name"), F.concat("p_brand", F.lit(" Tablets")), F.lit("title"), F.concat("p_name", F.lit(" (HCl), 5 mg")), F.lit("other"), F.lit("nothing")).alias("fields"), F.col("p_partkey").alias("ord"))
    meta = part.select(F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("spl_set_id"), F.create_map(F.lit("display_name"), F.col("p_type")).alias("fields"), F.col("p_partkey").alias("ord"))
    return resolve.drug_lexicon(rows, meta)


# --- crosswalk and graph ----------------------------------------------------

def _mentions(s, d):
    line = _t(s, d, "lineitem")
    mentions = line.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("chunk_id"), F.col("l_orderkey").cast("string").alias("spl_set_id"), F.col("l_suppkey").cast("string").alias("snomed_id"), F.col("l_returnflag").alias("link_type"), F.col("l_linestatus").alias("section"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_linenumber").cast("string").alias("match_text"), F.struct((F.col("l_quantity") > 25).alias("negated")).alias("qualifiers"), F.struct("l_orderkey", "l_linenumber").alias("ord"),
    )
    one = lambda c: F.struct(c.cast("string").alias("rxcui"), F.lit("SCD").alias("tty"), F.lit(True).alias("has_ndc"), F.lit("spl_set_id").alias("via"), F.lit(165).alias("score"))
    resolved = _t(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("spl_set_id"), one(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("primary"), F.array(one(F.substring("o_orderpriority", 1, 1))).alias("secondary"))
    return mentions, resolved


def _crosswalk(s, d):
    return links.crosswalk(*_mentions(s, d), 0.92)


_CROSS_CTE = """m AS (SELECT l_orderkey || '-' || l_partkey AS chunk_id, l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS spl_set_id, CAST(l_suppkey AS VARCHAR) AS snomed_id, l_returnflag AS link_type, l_linestatus AS section, round(1 - l_discount, 2) AS confidence, l_quantity > 25 AS negated FROM lineitem WHERE round(1 - l_discount, 2) >= 0.92),
x AS (SELECT o_orderkey, 0 AS pos, 'c' || o_custkey AS rxcui FROM orders UNION ALL SELECT o_orderkey, 1, substring(o_orderpriority, 1, 1) FROM orders),
j AS (SELECT m.*, pos, rxcui FROM m JOIN x ON l_orderkey = o_orderkey),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, rxcui, snomed_id, link_type ORDER BY l_orderkey, l_linenumber, pos) AS k FROM j) WHERE k = 1),
ru AS (SELECT rxcui, snomed_id, link_type, string_agg(DISTINCT section, ',' ORDER BY section) AS sections, count(DISTINCT spl_set_id) AS spl_count, count(*) AS chunk_count, round(max(confidence), 3) AS max_confidence, array_to_string(list_sort(list_distinct(list(spl_set_id)))[1:50], ',') AS spl_set_ids, array_to_string(list(spl_set_id ORDER BY l_orderkey, l_linenumber, pos)[1:5], ',') AS examples, bool_and(negated) AS neg FROM c GROUP BY ALL)"""


@_query(f"WITH {_CROSS_CTE} SELECT chunk_id, rxcui, snomed_id, link_type, confidence, CAST(l_linenumber AS VARCHAR) AS match_text FROM c")
def crosswalk_join(s, d):
    return _crosswalk(s, d).select("chunk_id", "rxcui", "snomed_id", "link_type", "confidence", "match_text")


_ROLLUP_SQL = f"WITH {_CROSS_CTE} SELECT rxcui, snomed_id, link_type, sections, CAST(spl_count AS BIGINT) AS spl_count, CAST(chunk_count AS BIGINT) AS chunk_count, max_confidence, spl_set_ids, examples FROM ru"


def _shown(found):
    return found.select("rxcui", "snomed_id", "link_type", F.array_join("sections", ",").alias("sections"), "spl_count", "chunk_count", "max_confidence", F.array_join("spl_set_ids", ",").alias("spl_set_ids"), F.array_join("examples.spl_set_id", ",").alias("examples"))


@_query(_ROLLUP_SQL)
def crosswalk_rollup(s, d):
    return _shown(links.rollup(_crosswalk(s, d), TS))


@_query(_ROLLUP_SQL)
def crosswalk_batches(s, d):
    """The roll-up of a store that took the mentions in three batches, the first two compacted, the second one twice."""
    mentions, resolved = _mentions(s, d)
    path = f"{shared_dir(s)}/corbel/{s.sparkContext.applicationId}/crosswalk-{uuid.uuid4().hex}"
    store = CrosswalkStore(s, f"{path}/store")
    # Mentions are dealt to the batches once, by as many open files, so that they needn't be sorted.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = s.conf.get(writers)
    s.conf.set(writers, 3)
    try:
        mentions.withColumn("batch", F.pmod(F.crc32("chunk_id"), F.lit(3))).write.partitionBy("batch").parquet(f"{path}/mentions")
    finally:
        s.conf.set(writers, before)
    part = lambda k: s.read.schema(mentions.schema).parquet(f"{path}/mentions/batch={k}")
    store.append(part(0), resolved, min_conf=0.92)
    store.append(part(1), resolved, min_conf=0.92)
    store.compact()
    store.append(part(1).unionByName(part(2)), resolved, min_conf=0.92)
    return _shown(store.edges(TS))


_EDGE_SQL = f"""WITH {_CROSS_CTE}, ex AS (SELECT rxcui, snomed_id, link_type, list(negated ORDER BY l_orderkey, l_linenumber, pos)[1:5] AS n FROM c GROUP BY ALL),
e AS (SELECT ru.*, 0.6 * max_confidence + 0.4 * ln(1 + spl_count) AS score FROM ru JOIN ex USING (rxcui, snomed_id, link_type) WHERE NOT list_aggregate(n, 'bool_and') AND max_confidence >= 0.8 AND spl_count >= {{least}} AND snomed_id NOT IN ('1', '2')),
r AS (SELECT *, row_number() OVER (PARTITION BY {{by}} ORDER BY score DESC, {{other}}, link_type) AS k FROM e)
SELECT rxcui, snomed_id, link_type, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 10"""


def _edges(s, d, by, least):
    graph = links.edges(links.rollup(_crosswalk(s, d), TS))
    block = s.createDataFrame([("1",), ("2",)], "id string")
    return links.strongest(graph, by, min_labels=least, blocklist=block).select("rxcui", "snomed_id", "link_type", F.round("score", 6).alias("score"), "rank")


@_query(_EDGE_SQL.format(by="rxcui", other="snomed_id", least=1))
def edge_rank_topn(s, d):
    return _edges(s, d, "rxcui", 1)


@_query(_EDGE_SQL.format(by="snomed_id", other="rxcui", least=2))
def edge_rank_by_condition(s, d):
    return _edges(s, d, "snomed_id", 2)


@_query(f"""WITH {_CROSS_CTE}, n AS (SELECT rxcui, snomed_id, link_type, max_confidence, CAST(spl_count AS BIGINT) AS spl_count, 0.6 * max_confidence + 0.4 * ln(1 + spl_count) AS score FROM ru)
SELECT rxcui, snomed_id, link_type, max_confidence, spl_count, round(score, 6) AS score FROM (SELECT * FROM n UNION ALL SELECT * FROM n WHERE spl_count > 1)""")
def nested_edges(s, d):
    """Edges of a table by drug and of one by condition, which has only those of more than one label."""
    rolled = materialize(links.rollup(_crosswalk(s, d), TS).select(*links.EDGE, "max_confidence", "spl_count"), "edges")
    nested = lambda df, by, other, name: df.groupBy(by).agg(F.collect_list(F.struct(other, "link_type", "max_confidence", "spl_count")).alias(name))
    found = links.nested_edges(nested(rolled, "rxcui", "snomed_id", "conditions"), nested(rolled.where("spl_count > 1"), "snomed_id", "rxcui", "drugs"))
    return found.select("rxcui", "snomed_id", "link_type", "max_confidence", "spl_count", F.round("score", 6).alias("score"))


_STATS_SQL = f"""WITH {_CROSS_CTE}, g AS (SELECT snomed_id, count(DISTINCT rxcui) AS degree_rx, count(*) AS edge_count, round(avg(max_confidence), 6) AS mean_max_conf, round(avg(spl_count), 6) AS mean_spl_count FROM ru GROUP BY 1),
t AS (SELECT snomed_id, lower(link_type) AS t, count(*) AS n FROM ru GROUP BY ALL), tk AS (SELECT *, row_number() OVER (PARTITION BY snomed_id ORDER BY n DESC, t) AS k FROM t),
tt AS (SELECT snomed_id, string_agg(t || ':' || n, ',' ORDER BY k) FILTER (k <= 3) AS top_link_types FROM tk GROUP BY 1)
SELECT snomed_id, CAST(degree_rx AS BIGINT) AS degree_rx, CAST(edge_count AS BIGINT) AS edge_count, mean_max_conf, mean_spl_count, top_link_types FROM g JOIN tt USING (snomed_id)"""


@_query(_STATS_SQL)
def generic_stats(s, d):
    found = links.generic_statistics(links.rollup(_crosswalk(s, d), TS))
    return found.select("snomed_id", "degree_rx", "edge_count", F.round("mean_max_conf", 6).alias("mean_max_conf"), F.round("mean_spl_count", 6).alias("mean_spl_count"), "top_link_types")


@_query(f"SELECT snomed_id FROM ({_STATS_SQL}) ORDER BY degree_rx DESC, edge_count DESC, mean_spl_count DESC, snomed_id LIMIT 5")
def suggested_blocklist(s, d):
    return links.suggested_blocklist(links.generic_statistics(links.rollup(_crosswalk(s, d), TS)), 5)


# --- names, text and keys ---------------------------------------------------

@_query("""WITH n AS (SELECT DISTINCT doc_id, lang AS spl, kind, lower(name) AS name FROM (SELECT doc_id, lang, 'brand' AS kind, source AS name FROM documents UNION ALL SELECT doc_id, lang, 'generic', lang FROM documents)),
h AS (SELECT name, count(*) AS hits FROM n GROUP BY 1), u AS (SELECT name, count(*) AS spls FROM (SELECT DISTINCT spl, kind, name FROM n) GROUP BY 1)
SELECT name AS name_norm, 'mixed' AS name_type, CAST(hits AS BIGINT) AS total_chunk_hits, CAST(spls AS BIGINT) AS unique_spl_count FROM h JOIN u USING (name)""")
def name_inventory(s, d):
    chunks = _t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("spl_set_id"), F.array("source").alias("brand_names"), F.array("lang").alias("generic_names"))
    return names.name_inventory(names.chunk_names(chunks))


@_query("""SELECT lang AS spl_set_id, string_agg(DISTINCT lower(source), ',' ORDER BY lower(source)) AS brands, lang AS generics FROM documents GROUP BY lang""")
def label_names(s, d):
    chunks = _t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("spl_set_id"), F.array("source").alias("brand_names"), F.array("lang").alias("generic_names"))
    found = names.label_names(names.chunk_names(chunks))
    return found.select("spl_set_id", F.array_join("brand_names_norm", ",").alias("brands"), F.array_join("generic_names_norm", ",").alias("generics"))


@_query("""WITH t AS (SELECT p_partkey, p_name || ' Tablets (' || p_brand || ')' AS title FROM part)
SELECT kind AS name_type, name AS name_norm, CAST(count(*) AS BIGINT) AS unique_spl_count FROM (
SELECT 'brand' AS kind, lower(trim(regexp_replace(regexp_replace(regexp_replace(split_part(title, ' (', 1), '(?i)\\b(tablets?|capsules?|injection|oral|solution|cream|ointment|gel|suspension|spray|for .*|usp|rx only)\\b', ' ', 'g'), '[^\\w\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))) AS name FROM t
UNION ALL SELECT 'generic', lower(trim(regexp_replace(regexp_replace(regexp_extract(title, '\\(([^)]+)\\)', 1), '[^\\w\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))) FROM t) GROUP BY ALL""")
def title_names(s, d):
    labels = _t(s, d, "part").select(F.col("p_partkey").cast("string").alias("spl_set_id"), F.concat("p_name", F.lit(" Tablets ("), "p_brand", F.lit(")")).alias("title"), F.lit(None).cast("string").alias("description"))
    return names.name_counts(names.master_names(labels))


@_query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS spaced, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS letters,
CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) AS tokens, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents""")
def text_normalise(s, d):
    return _t(s, d, "documents").select("doc_id", text_.norm_space("text").alias("spaced"), F.length(text_.letters("text")).cast("long").alias("letters"), text_.tokens_estimate("text").alias("tokens"), text_.digits("text").alias("digits"))


@_query("""WITH k AS (SELECT p_partkey, lower(p_type || ' / ' || p_brand || ' & Co') AS x FROM part)
SELECT p_partkey, replace(regexp_replace(regexp_replace(replace(x, '&', ' and '), '[/-]', ' ', 'g'), '\\s+', ' ', 'g'), ' ', '_') AS section_key FROM k""")
def section_keys(s, d):
    return _t(s, d, "part").select("p_partkey", text_.section_key(F.concat("p_type", F.lit(" / "), "p_brand", F.lit(" & Co"))).alias("section_key"))


@_query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' HCl Tablets, 5 mg or (' || p_brand || ')'),
'\\b(usp|hcl|hydrochloride|tablet[s]?|capsule[s]?|injection|syrup|oral|solution|suspension|extended\\s*release|immediate\\s*release)\\b', ' ', 'g'), '\\b(?:mg|mcg|g|ml)\\b', ' ', 'g'), '\\bor\\b', ' ', 'g'), '[()\\[\\],.;:]+', ' ', 'g'), '\\s+', ' ', 'g')) AS drug_key FROM part""")
def drug_keys(s, d):
    return _t(s, d, "part").select("p_partkey", text_.drug_key(F.concat("p_name", F.lit(" HCl Tablets, 5 mg or ("), "p_brand", F.lit(")"))).alias("drug_key"))


@_query("""SELECT doc_id, sha1(text) AS sha1, left(sha256(text), 16) AS sha256, left(sha1(CAST(doc_id AS VARCHAR) || '|' || lang), 16) AS short FROM documents""")
def stable_ids(s, d):
    return _t(s, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), keys_.short_sha256("text").alias("sha256"), keys_.short_sha1("doc_id", "lang").alias("short"))


@_query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(lang || '/' || doc_id)) AS h FROM documents)
SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || ['8','9','a','b'][CAST(('0x' || substring(h, 17, 1)) AS INTEGER) % 4 + 1] || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS uuid FROM h""")
def uuid5_ids(s, d):
    return _t(s, d, "documents").select("doc_id", keys_.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat_ws("/", "lang", F.col("doc_id").cast("string"))).alias("uuid"))


_NDC_SQL = """WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '7') AS n FROM orders),
c AS (SELECT o_orderkey, CASE CAST(substring(n, 10, 1) AS INTEGER) % 4 WHEN 0 THEN substring(n, 1, 4) || '-' || substring(n, 5, 4) || '-' || substring(n, 9, 2) WHEN 1 THEN substring(n, 1, 5) || '-' || substring(n, 6, 3) || '-' || substring(n, 9, 2) WHEN 2 THEN substring(n, 1, 5) || '-' || substring(n, 6, 4) || '-' || substring(n, 10, 1) ELSE n END AS code FROM k)
SELECT o_orderkey, '0' || regexp_replace(code, '[^0-9]', '', 'g') AS plain,
CASE WHEN contains(code, '-') THEN lpad(split_part(code, '-', 1), 5, '0') || lpad(split_part(code, '-', 2), 4, '0') || lpad(split_part(code, '-', 3), 2, '0') ELSE code END AS by_segment,
CASE WHEN contains(code, '-') THEN lpad(split_part(code, '-', 1), 5, '0') || '-' || lpad(split_part(code, '-', 2), 4, '0') || '-00' ELSE '' END AS products FROM c"""


@_query(_NDC_SQL)
def ndc_normalise(s, d):
    n = F.lpad(F.col("o_orderkey").cast("string"), 10, "7")
    cut = lambda *sizes: F.concat_ws("-", *[F.substring(n, 1 + sum(sizes[:k]), z) for k, z in enumerate(sizes)])
    last = F.substring(n, 10, 1).cast("int") % 4
    code = F.when(last == 0, cut(4, 4, 2)).when(last == 1, cut(5, 3, 2)).when(last == 2, cut(5, 4, 1)).otherwise(n)
    rows = _t(s, d, "orders").select("o_orderkey", code.alias("code"))
    return rows.select("o_orderkey", keys_.ndc11("code").alias("plain"), keys_.ndc11_by_segment("code").alias("by_segment"), F.array_join(keys_.label_packages("code")[0], ",").alias("products"))


@_query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, 'x' || strftime(o_orderdate, '%Y%m%d') AS kept FROM orders""")
def iso_dates(s, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return _t(s, d, "orders").select("o_orderkey", keys_.iso_date(day, check=True).alias("iso"), keys_.iso_date(F.concat(F.lit("x"), day)).alias("kept"))


@_query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS alias FROM events""")
def json_alias_coalesce(s, d):
    v = F.try_parse_json("props")
    return _t(s, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), keys_.first_given(F.try_variant_get(v, "$.missing", "string"), F.try_variant_get(v, "$.k", "string")).alias("alias"))


@_query(f"""SELECT p_partkey, '{K.DRUG_PAGE}' || p_partkey AS rxnav, '{K.CONCEPT_PAGE}' || p_size AS snomed FROM part""")
def record_addresses(s, d):
    found = keys_.record_links(F.lit(None).cast("string"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    return _t(s, d, "part").select("p_partkey", found["rxnav"].alias("rxnav"), found["snomed"].alias("snomed"))


# --- summary ----------------------------------------------------------------

@_query("""WITH e AS (SELECT conv_id AS qid, turn AS rank, role AS spl_set_id, 's' || (turn % 2) AS section, 'http://x/' || role || '/' || (turn % 2) AS url FROM conversations),
f AS (SELECT qid, spl_set_id, section, url, min(rank) AS first FROM e GROUP BY ALL)
SELECT qid, spl_set_id, section, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) AS INTEGER) AS number, url FROM f""")
def citation_index(s, d):
    half = (F.col("turn") % 2).cast("string")
    rows = _t(s, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.col("role").alias("spl_set_id"), F.concat(F.lit("s"), half).alias("section"), F.create_map(F.lit("dailymed"), F.concat_ws("/", F.lit("http://x"), "role", half)).alias("links"))
    return answer.citation_index(rows)


@_query("""WITH b AS (SELECT conv_id AS qid, turn AS pos, trim(split_part(text, '—', 1)) AS head, text FROM conversations),
s AS (SELECT *, regexp_extract_all(lower(head), '[A-Za-z]+') AS w FROM b), k AS (SELECT *, array_to_string(w[greatest(len(w) - 1, 1):], ' ') AS sig FROM s),
g AS (SELECT *, CASE WHEN sig = '' THEN chr(1) || pos ELSE sig END AS key FROM k)
SELECT qid, min(pos) AS pos, CAST(count(*) AS BIGINT) AS members FROM g GROUP BY qid, key""")
def bullet_group(s, d):
    rows = _t(s, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), "text", F.lit(1.0).alias("score"), F.col("turn").cast("int").alias("citation"))
    return answer.group_bullets(rows).select("qid", "pos", F.size("citations").cast("long").alias("members"))


@_query()
def answer_lines(s, d):
    rows = _t(s, d, "conversations").groupBy("conv_id").agg(ordered_list(F.col("text"), F.col("turn")).alias("t"))
    return rows.select("conv_id", *[answer.answer_line(F.lit(i), F.lit("zorvex"), F.col("t")).alias(i) for i in ("dosage", "indication", "overview")])


# --- sets and plain relational forms ----------------------------------------

@_query("""SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) THEN 'allowed' ELSE 'rest' END AS side FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def label_quality_semi(s, d):
    docs, labels = _t(s, d, "documents").select("doc_id"), _t(s, d, "labels")
    good, bad = labels.where("quality = 1").select("doc_id").distinct(), labels.where("toxic = 1").select("doc_id")
    left = docs.join(bad, "doc_id", "left_anti")
    return left.join(good, "doc_id", "left_semi").withColumn("side", F.lit("allowed")).unionByName(left.join(good, "doc_id", "left_anti").withColumn("side", F.lit("rest")))


@_query("""SELECT 'both' AS side, CAST(k AS BIGINT) AS k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', CAST(k AS BIGINT) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', CAST(k AS BIGINT) FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_operations(s, d):
    a, b = _t(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")), _t(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    tag = lambda df, t: df.select(F.lit(t).alias("side"), "k")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "customers")).unionByName(tag(a.union(b).distinct(), "any"))


@_query("""SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_totals(s, d):
    found = _t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return found.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@_query("""SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(s, d):
    from corbel.streaming.tables import windowed_counts as run

    return run(_t(s, d, "events")).select("start", "event_type", "events", F.round("total", 4).alias("total"))


@_query("""SELECT doc_id, CAST(s AS INTEGER) AS char_start, substring(text, s + 1, 1100) AS chunk_text FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 940)) AS s FROM documents WHERE length(text) > 0)""")
def fixed_windows(s, d):
    return chunker.fixed_windows(_t(s, d, "documents"), "doc_id", "text", 1100, 160)


@_query("SELECT s_suppkey, s_name, CAST(k AS INTEGER) AS rank FROM (SELECT s_suppkey, s_name, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k <= 3")
def topk_per_group(s, d):
    return top_rows(_t(s, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 3, "rank").select("s_suppkey", "s_name", "rank")


# --- texts and retrieval, without SQL ---------------------------------------

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@_query(rf"""WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS row_id, trim(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), {_BLANK}) AS t FROM documents),
n AS (SELECT row_id, 0 AS start, 0 AS stop, '' AS body, 0 AS next, true AS more FROM d WHERE t <> ''
  UNION ALL SELECT row_id, next, stop, body, least(greatest(CASE WHEN stop - 160 > next THEN stop - 160 ELSE stop END, next + 1), size), body <> '' AND least(greatest(CASE WHEN stop - 160 > next THEN stop - 160 ELSE stop END, next + 1), size) < size FROM (
    SELECT row_id, next, stop, size, trim(substring(t, next + 1, stop - next), {_BLANK}) AS body FROM (
      SELECT row_id, next, t, size, CASE WHEN contains(marked, chr(57344)) THEN low + length(replace(regexp_replace(marked, chr(57344) || '[^' || chr(57344) || ']*$', ''), chr(57344), '')) ELSE until END AS stop FROM (
        SELECT row_id, next, t, size, low, until, CASE WHEN until < size THEN regexp_replace(substring(t, low + 1, until - low), '([.!?][)\]"'']?\s|\n\n)', '\1' || chr(57344), 'g') ELSE '' END AS marked FROM (
          SELECT n.row_id, n.next, t, length(t) AS size, least(n.next + 1100, length(t)) AS until, greatest(n.next, least(n.next + 1100, length(t)) - 240) AS low FROM n JOIN d USING (row_id) WHERE n.more))))),
w AS (SELECT row_id, start, stop, body, regexp_replace(body, '\s+', ' ', 'g') AS plain FROM n WHERE body <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY row_id, lower(plain) ORDER BY start) AS seen FROM w),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY start) - 1 AS INTEGER) AS chunk_index FROM f WHERE seen = 1),
h AS (SELECT k.*, id, sha1(unhex('{chunker.NAMESPACE.hex}') || encode(id || '|body|' || start || '|' || stop || '|' || left(sha1(plain), 8))) AS h FROM k JOIN d USING (row_id))
SELECT id AS spl_set_id, 'body' AS section, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || ['8','9','a','b'][CAST(('0x' || substring(h, 17, 1)) AS INTEGER) % 4 + 1] || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS chunk_id,
CAST(start AS INTEGER) AS char_start, CAST(stop AS INTEGER) AS char_end, chunk_index, CAST(CASE WHEN chunk_index > 0 THEN 160 ELSE 0 END AS INTEGER) AS overlap_chars, CAST(greatest(1, round_even(length(body) / 4, 0)) AS INTEGER) AS token_count, body AS chunk_text FROM h""")
def chunk_windows(s, d):
    rows = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("spl_set_id"), F.lit("body").alias("section"), "text")
    return chunker.chunk_sections(rows)


def _snippet_sql(text: str) -> str:
    clean = text
    for p in K.SNIPPET_NOISE:
        clean = f"regexp_replace({clean}, '{_sql_text(p)}', ' ', 'g')"
    return clean


_SENTENCES_SQL = "string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))"
_WORDY = "list_filter({x}, lambda v: len(regexp_extract_all(v, '[A-Za-z0-9''-]+')) >= 6)"


@_query(f"""WITH p AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS plain FROM documents),
c AS (SELECT doc_id, plain, trim(regexp_replace({_snippet_sql("plain")}, '\\s+', ' ', 'g')) AS clean FROM p),
g AS (SELECT *, {_WORDY.format(x=_SENTENCES_SQL.format(x="clean"))} AS good FROM c),
o AS (SELECT *, CASE WHEN len(good) = 0 THEN clean WHEN length(array_to_string(good[1:2], ' ')) < 200 THEN array_to_string(good[1:3], ' ') ELSE array_to_string(good[1:2], ' ') END AS out FROM g)
SELECT doc_id, CASE WHEN len(good) = 0 OR length(out) <= 600 THEN out WHEN contains(out[1:600], ' ') THEN regexp_replace(out[1:600], ' [^ ]*$', '') || '…' ELSE out[1:600] || '…' END AS snippet,
CAST(CASE WHEN plain = '' THEN 0 ELSE len({_SENTENCES_SQL.format(x="plain")}) END AS INTEGER) AS sentences FROM o""")
def snippets(s, d):
    facts = _t(s, d, "documents").select("doc_id", evidence.snippet_facts(F.lit("adverse_effect"), F.col("text")).alias("f"))
    return facts.select("doc_id", "f.snippet", "f.sentences")


@_query()
def cued_snippets(s, d):
    small_batches(s)
    docs = _t(s, d, "documents").withColumn("text", F.concat_ws(" ", "text", F.lit("Most common were nausea in 5 % of all treated patients. It is given at 10 mg once daily.")))
    return docs.select("doc_id", *[evidence.intent_snippet(F.lit(i), F.col("text")).alias(i) for i in ("adverse_effect", "dosage", "indication")])


#: Likeness of two lists of distinct words as the resolver takes it: ``lcs`` steps through one text and keeps, for each
#: beginning of the other, the length of the longest common subsequence.
_LIKENESS = """
x AS (SELECT q, key, string_split(q, ' ') AS qw, string_split(key, ' ') AS kw FROM pairs),
y AS (SELECT q, key, list_sort(list_distinct(list_filter(qw, lambda w: list_contains(kw, w)))) AS same, list_sort(list_distinct(list_filter(qw, lambda w: NOT list_contains(kw, w)))) AS mine, list_sort(list_distinct(list_filter(kw, lambda w: NOT list_contains(qw, w)))) AS yours FROM x),
z AS (SELECT *, array_to_string(same, ' ') AS base, array_to_string(list_concat(same, mine), ' ') AS one, array_to_string(list_concat(same, yours), ' ') AS two FROM y),
l AS (SELECT *, list_last(list_reduce(list_prepend(list_transform(range(length(one) + 1), lambda i: 0), list_transform(range(length(two)), lambda j: [unicode(two[j + 1])])),
  lambda r, c: list_transform(range(length(one) + 1), lambda i: greatest(r[i + 1], coalesce(list_max(list_transform(list_filter(range(1, i + 1), lambda k: unicode(one[k]) = c[1]), lambda k: r[k] + 1)), 0))))) AS common FROM z),
scored AS (SELECT q, key, CASE WHEN len(same) > 0 AND (len(mine) = 0 OR len(yours) = 0) THEN 100.0 ELSE greatest(200.0 * common / (length(one) + length(two)), CASE WHEN len(same) > 0 THEN 200.0 * length(base) / (length(base) + least(length(one), length(two))) ELSE 0 END) END AS score FROM l)
"""


@_query(f"""
WITH lex AS (SELECT lower(n_name) AS key, CAST(n_nationkey AS VARCHAR) AS snomed_id, n_name AS name FROM nation),
asked AS (SELECT s_suppkey AS qid, lower(n_name) || ' old' AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey),
pairs AS (SELECT DISTINCT q, key FROM asked, lex), {_LIKENESS}
SELECT qid, snomed_id, name, CAST(score AS DOUBLE) AS score FROM asked JOIN scored USING (q) JOIN lex USING (key) WHERE score >= 88 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) = 1
""")
def fuzzy_names(s, d):
    lex = _t(s, d, "nation").select(F.lower("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("snomed_id"), F.col("n_name").alias("name"))
    asked = _t(s, d, "supplier").join(_t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("qid"), F.concat("n_name", F.lit(" old")).alias("text"))
    return resolve.fuzzy(asked, lex)


#: Openings of four words, and for every 50th document its own with the words turned round and the third letter left out.
_OPENINGS = "SELECT doc_id, array_to_string(w[1:4], ' ') AS opening, w[1:4] AS w FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL) WHERE w[1] <> ''"


@_query(f"""
WITH o AS ({_OPENINGS}),
lex AS (SELECT opening AS key, min(CAST(doc_id AS VARCHAR)) AS first_id FROM o GROUP BY 1),
turned AS (SELECT doc_id AS qid, array_to_string(list_reverse(w), ' ') AS t FROM o WHERE doc_id % 50 = 0),
asked AS (SELECT qid, trim(regexp_replace(left(t, 2) || substring(t, 4), ' +', ' ', 'g')) AS q FROM turned),
pairs AS (SELECT DISTINCT q, key FROM asked, lex WHERE q <> '' AND least(length(q), length(key)) > 0), {_LIKENESS}
SELECT qid, first_id, key, CAST(score AS DOUBLE) AS score FROM asked JOIN scored USING (q) JOIN lex USING (key) WHERE score >= 88 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) = 1
""")
def fuzzy_openings(s, d):
    # Four words need no pass over what follows them; they are read once for both sides.
    opening = F.regexp_extract("text", r"(?U)^\s*+(?:\S++\s++){0,3}\S*+", 0)
    words = F.slice(F.split(text_.norm_lower(opening), " "), 1, 4)
    docs = materialize(_t(s, d, "documents").where("text is not null").select("doc_id", words.alias("w")).where("w[0] <> ''"), "openings")
    lex = docs.groupBy(F.array_join("w", " ").alias("key")).agg(F.min(F.col("doc_id").cast("string")).alias("snomed_id")).select("key", "snomed_id", F.col("key").alias("name"))
    turned = F.array_join(F.reverse("w"), " ")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.concat(F.left(turned, F.lit(2)), F.expr("substring(array_join(reverse(w), ' '), 4)")).alias("text"))
    return resolve.fuzzy(asked, lex).select("qid", F.col("snomed_id").alias("first_id"), F.col("name").alias("key"), "score")


@_query(f"""WITH RECURSIVE b AS (SELECT CAST(item_id AS VARCHAR) AS c, string_split(text, ' ') AS w FROM benchmark),
s AS (SELECT c, list_transform(list_sort(list_transform(list_distinct(list_filter(w, lambda x: x <> '')), lambda x: {{'l': lower(x), 'v': x}})), lambda x: '- ' || x.v || chr(10)) AS t FROM b),
p AS (SELECT c, 1 AS i, 1 AS k, 10 + length(t[1]) AS n FROM s WHERE len(t) > 0
  UNION ALL SELECT c, i + 1, CASE WHEN n + length(t[i + 1]) > 240 THEN k + 1 ELSE k END, CASE WHEN n + length(t[i + 1]) > 240 THEN 10 ELSE n END + length(t[i + 1]) FROM p JOIN s USING (c) WHERE i < len(t)),
o AS (SELECT c, 'core' AS section, 'core' AS key, CAST(0 AS INTEGER) AS "order", trim(w[1] || chr(10) || 'SNOMED CT conceptId: ' || c || chr(10) || 'Definition status: fully_defined' || chr(10) || 'FSN: ' || w[1] || ' (disorder)') || chr(10) AS text FROM b
  UNION ALL SELECT c, 'synonyms', 'syn|' || k, CAST(k AS INTEGER), 'Synonyms:' || chr(10) || string_agg(t[i], '' ORDER BY i) FROM p JOIN s USING (c) GROUP BY c, k)
SELECT 'snomed:chunk:' || c || ':' || left(sha1(c || '|' || key), 16) AS chunk_id, 'snomed:concept:' || c AS doc_id, c AS "conceptId", section, text, CAST(greatest(1, ceil(length(text) / 4)) AS INTEGER) AS token_estimate, "order", 'snomed_ct' AS source, '{TS}' AS last_updated FROM o""")
def synonym_packs(s, d):
    rows = _t(s, d, "benchmark").select(F.col("item_id").cast("string").alias("conceptId"), F.split("text", " ").alias("w"))
    term = F.transform("w", lambda x: F.struct(F.lit("").alias("id"), x.alias("term"), F.lit("en").alias("lang")))
    docs = rows.select("conceptId", F.lit(True).alias("is_fully_defined"), F.struct(F.struct(F.lit("").alias("id"), F.concat(F.get("w", F.lit(0)), F.lit(" (disorder)")).alias("term"), F.lit("en").alias("lang")).alias("fsn"), F.lit(None).cast("map<string,struct<id:string,term:string>>").alias("pt"), term.alias("synonyms")).alias("terms"), F.struct(F.array().cast("array<string>").alias("parent_ids")).alias("hierarchy"))
    return concepts.concept_chunks(docs, TS, 60)


_XML = ["<document xmlns='urn:hl7-org:v3'><setId root='s", "'/><title>T</title><component><structuredBody><component><section><code code='1' codeSystemName='LOINC' displayName='CONTRAINDICATIONS SECTION'/><text><paragraph>", "</paragraph><title>Warnings &amp; Risks/Use</title><paragraph>", "</paragraph><paragraph>Pregnancy: ", "</paragraph></text><component><section><code code='9' codeSystemName='X'/><title>Part ", "</title><text><list><item>a</item><item>", "</item></list></text></section></component></section></component></structuredBody></component></document>"]


@_query("""WITH d AS (SELECT doc_id, lang, source, trim(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10)) AS body FROM documents)
SELECT doc_id, 'section' AS kind, 'contraindications' AS key, body FROM d UNION ALL SELECT doc_id, 'section', 'warnings_and_risks_or_use', lang FROM d UNION ALL SELECT doc_id, 'section', 'pregnancy', source FROM d UNION ALL SELECT doc_id, 'loose', 'Part ' || lang, 'a' || chr(10) || chr(10) || source FROM d""")
def xml_walk(s, d):
    """Label documents made of texts, parsed and walked; each section is a row."""
    esc = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    told = [F.col("doc_id").cast("string"), esc, F.col("lang"), F.col("source"), F.col("lang"), F.col("source")]
    xml = F.concat(F.lit(_XML[0]), *[x for c, part in zip(told, _XML[1:]) for x in (c, F.lit(part))])
    files = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), xml.cast("binary").alias("content"))
    found = labels.parse_labels(files).withColumn("doc_id", F.substring("set_id", 2, 30).cast("long"))
    rows = lambda kind, c: found.select("doc_id", F.lit(kind).alias("kind"), F.explode(c).alias("key", "body"))
    return rows("section", "sections").unionByName(rows("loose", "unclassified"))


#: Sentences that are added to texts, so that every stage of evidence has rows; by the row's number.
_TOLD = [
    "", "It is contraindicated in severe renal impairment. Do not use.", "Serious risks: seizure and neutropenia were seen.", "The most common adverse reactions were nausea and headache in 12 % of all.", "Concomitant use with src1 may raise the risk of bleeding.",
    "It is indicated for the treatment of pain.", "Table 5 of findings", "Drug interactions with warfarin are known.", "Use in pregnancy is not advised.",
]
_HEADS = ["contraindications", "warnings and precautions", "", "adverse reactions", "Oral Tablets", "description", "drug interactions"]
_ASKED = [("contraindication", "renal"), ("warning", ""), ("adverse_effect", "nausea"), ("interaction", "interaction"), ("indication", "pain relief"), ("mechanism", ""), ("pregnancy", "zorvex")]


def _any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{_sql_text(w)}')" for w in words) + ")"


def _cue_sql(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '(?i){_sql_text(p)}')" for p in patterns) + ")"


def _fits_sql(names: list[str]) -> str:
    plain = [re.sub("[^a-z]", "", n) for n in names]
    return "(section <> '' AND (" + " OR ".join(f"contains(sl, '{n}') OR contains('{n}', sl)" for n in plain) + "))"


_CASCADE_SQL = f"""WITH r AS (SELECT source AS spl, doc_id AS ord, lower({_HEADS}[doc_id % {len(_HEADS)} + 1]) AS sec, trim(regexp_replace(CASE WHEN doc_id % {len(_TOLD)} = 6 THEN 'Table 5 ' || coalesce(text, '') ELSE coalesce(text, '') || ' ' || [{", ".join(f"'{x}'" for x in _TOLD)}][doc_id % {len(_TOLD)} + 1] END, '\\s+', ' ', 'g')) AS text FROM documents),
l AS (SELECT *, lower(text) AS low FROM r WHERE text <> ''),
x AS (SELECT spl, ord, text, low, CASE WHEN sec = '' OR regexp_matches(sec, '(?i){_sql_text(K.GENERIC_HEADING)}') THEN CASE {" ".join(f"WHEN {_any_sql('low', v)} THEN '{n}'" for n, v in K.INFERRED_HEADINGS)} ELSE sec END ELSE sec END AS section FROM l),
q AS (SELECT s.source || '-' || i.intent AS qid, s.source AS label, i.intent, i.phrase FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest([{", ".join(f"{{'intent': '{i}', 'phrase': '{p}'}}" for i, p in _ASKED)}], recursive := true)) i),
p AS (SELECT q.*, x.*, spl = label AS same, regexp_replace(section, '[^a-z]', '', 'g') AS sl FROM q JOIN x ON spl = label OR (intent = 'interaction' AND contains(low, lower(label)))),
f AS (SELECT *, CASE intent {" ".join(f"WHEN '{i}' THEN {_fits_sql(v)}" for i, v in K.INTENT_SECTIONS.items())} ELSE true END AS sec_ok, CASE intent {" ".join(f"WHEN '{i}' THEN {_cue_sql('text', v)}" for i, v in K.INTENT_CUES.items())} ELSE true END AS cue,
  phrase = '' OR (phrase = 'interaction' AND {_any_sql('low', K.PHRASE_SYNONYMS['interaction'])}) OR len(list_filter(string_split(phrase, ' '), lambda w: length(w) > 2 AND contains(low, w))) > 0 AS phit, starts_with(low, 'table ') AS tabular FROM p),
g AS (SELECT *, (NOT tabular OR (intent IN ('warning', 'adverse_effect') AND sec_ok)) AS plain, (NOT tabular OR (intent IN ('warning', 'adverse_effect') AND sec_ok)) AND sec_ok AND section <> '' AND NOT regexp_matches(section, '(?i){_sql_text(K.GENERIC_HEADING)}') AND (intent NOT IN ({", ".join(f"'{i}'" for i in K.INTENT_CUES)}) OR cue) AS strict FROM f),
s AS (SELECT *, unnest(list_filter([CASE WHEN same AND strict AND phit THEN 1 END, CASE WHEN same AND strict THEN 2 END, CASE WHEN same AND intent = 'warning' AND regexp_matches(text, '(?i){_sql_text(K.HARD_WARNING)}') THEN 24 END,
  CASE WHEN same AND intent = 'adverse_effect' AND regexp_matches(text, '(?i){_sql_text(K.ADVERSE_HINT)}') THEN 23 END, CASE WHEN same AND intent = 'interaction' AND cue THEN 22 END,
  CASE WHEN intent = 'interaction' AND contains(low, lower(label)) AND {_cue_sql('low', K.INTENT_CUES['interaction'])} THEN 21 END, CASE WHEN same AND plain THEN 3 END], lambda v: v IS NOT NULL)) AS stage FROM g),
o AS (SELECT *, CASE WHEN stage > 20 THEN 2 ELSE [0, 1, 3][stage] END AS prio, CASE stage WHEN 24 THEN 0.45 WHEN 23 THEN 0.5 WHEN 22 THEN 0.35 + CASE WHEN starts_with(sl, 'druginteractions') THEN 0.25 ELSE 0 END WHEN 21 THEN 0.33
  ELSE CASE WHEN sec_ok THEN 0.38 ELSE 0 END + CASE WHEN phit THEN 0.12 ELSE 0 END + 0.07 + CASE WHEN cue AND intent IN ({", ".join(f"'{i}'" for i in K.INTENT_CUES)}) THEN 0.3 ELSE 0 END END AS score FROM s),
w AS (SELECT *, min(prio) OVER (PARTITION BY qid) AS first FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ord, stage DESC) AS rank FROM w WHERE prio = first)
SELECT qid, spl AS spl_set_id, CAST(stage AS INTEGER) AS stage, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank,
  CASE WHEN stage > 20 THEN coalesce(nullif(section, ''), [ 'drug interactions', 'drug interactions', 'adverse reactions', 'warnings and precautions'][stage - 20]) ELSE section END AS section FROM k WHERE rank <= 6"""


@_query(_CASCADE_SQL)
def evidence_stage_cascade(s, d):
    """Evidence for questions of seven intents about every source, from all texts, without similarities."""
    small_batches(s)
    number = lambda n: (F.col("doc_id") % n).cast("int")
    told = F.get(F.array(*[F.lit(x) for x in _TOLD]), number(len(_TOLD)))
    text = F.when(number(len(_TOLD)) == 6, F.concat(F.lit("Table 5 "), F.coalesce("text", F.lit("")))).otherwise(F.concat_ws(" ", F.coalesce("text", F.lit("")), told))
    docs = _t(s, d, "documents")
    rows = evidence.label_rows(docs.select(F.col("source").alias("spl_set_id"), F.get(F.array(*[F.lit(x) for x in _HEADS]), number(len(_HEADS))).alias("section"), text.alias("text"), F.col("doc_id").alias("ord")))
    rows = materialize(rows, "label-rows")
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("intent"), F.lit(p).alias("phrase")) for i, p in _ASKED]))
    asked = docs.select("source").distinct().select("source", kinds.alias("k")).select(F.concat_ws("-", "source", "k.intent").alias("qid"), F.lit("").alias("text"), "k.intent", "k.phrase", F.col("source").alias("drug_name"), F.col("source").alias("question_label"))
    found = evidence.collect_evidence(asked, rows)
    return found.select("qid", "spl_set_id", "stage", F.round("score", 6).alias("score"), "rank", "section")


def engine(s: SparkSession, d: str) -> Engine:
    """An engine over documents: sources are labels, languages their sections."""
    small_batches(s)
    docs = _t(s, d, "documents")
    rows = evidence.label_rows(docs.select(F.col("source").alias("spl_set_id"), F.concat(F.lit("contraindications "), "lang").alias("section"), "text", F.col("doc_id").alias("ord")))
    rows = materialize(rows, "label-rows")
    sources = docs.select("source").distinct()
    lex = sources.select(F.lower("source").alias("key"), F.col("source").alias("spl_set_id"))
    drugs_ = sources.select(F.lower("source").alias("spl_set_id"), F.regexp_replace("source", "[^0-9]", "").alias("rxcui"))
    return Engine(rows, lex, drugs_, encoder=vectors.hashing_encoder())


def asked(s: SparkSession, d: str) -> DataFrame:
    """One question for each source."""
    docs = _t(s, d, "documents").select("source").distinct()
    return docs.select(F.col("source").alias("qid"), F.concat(F.lit("tell me about "), "source", F.lit(" for the")).alias("text"))


@_query()
def engine_ask(s, d):
    found = engine(s, d).ask(asked(s, d))
    return found.select("qid", "intent", "drug.spl_set_id", "drug.rxcui", F.size("evidence").alias("n"), F.to_json("evidence").alias("evidence"))


@_query()
def engine_answer(s, d):
    return answer.format_cli(engine(s, d).answer(asked(s, d), grouped=True))
