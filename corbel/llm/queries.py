"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corbel.llm.chunks import op1_chunks
from corbel.llm.codes import op11_codes
from corbel.llm.common import small_batches, table
from corbel.llm.imatch import op7_imatch
from corbel.llm.mixing import op10_mixing
from corbel.llm.pages import op13_html
from corbel.llm.pieces import op6_pieces
from corbel.llm.quality import op9_quality
from corbel.llm.simhash import op4_simhash
from corbel.llm.spelling import op12_spelling
from corbel.llm.suffixes import op2_suffixes
from corbel.llm.tokens import op3_tokens
from corbel.llm.toxicity import op5_toxicity
from corbel.llm.vectors import op8_neighbours

#: The vocabulary file of the token queries, among the public tokenizers.
PIECES = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Where the machine keeps a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, to be read in small batches, as texts may be very long: a setting of the session."""
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages, to be read in small batches as the documents are."""
    small_batches(spark)
    return table(spark, sf_dir, "pages")


def queries() -> dict[str, Query]:
    """The query of each operator over its whole table."""
    return {
        "op1_chunks": lambda s, d: op1_chunks(documents(s, d)),
        "op2_suffixes": lambda s, d: op2_suffixes(documents(s, d)),
        "op3_tokens": lambda s, d: op3_tokens(documents(s, d), tokenizer(PIECES)),
        "op4_simhash": lambda s, d: op4_simhash(documents(s, d)),
        "op5_toxicity": lambda s, d: op5_toxicity(documents(s, d), table(s, d, "labels")),
        "op6_pieces": lambda s, d: op6_pieces(documents(s, d), tokenizer(PIECES)),
        "op7_imatch": lambda s, d: op7_imatch(documents(s, d)),
        "op8_neighbours": lambda s, d: op8_neighbours(table(s, d, "embeddings")),
        "op9_quality": lambda s, d: op9_quality(documents(s, d), table(s, d, "labels")),
        "op10_mixing": lambda s, d: op10_mixing(documents(s, d)),
        "op11_codes": lambda s, d: op11_codes(table(s, d, "embeddings")),
        "op12_spelling": lambda s, d: op12_spelling(documents(s, d)),
        "op13_html": lambda s, d: op13_html(pages(s, d)),
    }


#: Every string of 50 bytes as hexadecimal text, and what is left of each document without the later ones.
_SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, base, substring(h, 2 * base + 1, 898) AS x FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50, 400)) AS base FROM d WHERE length(h) >= 100)),
w AS (SELECT doc_id, base + j AS i, substring(x, 2 * j + 1, 100) AS s FROM (SELECT doc_id, base, x, unnest(generate_series(0, least(399, length(x) // 2 - 50))) AS j FROM b)),
m AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT w.doc_id, i FROM w JOIN m USING (s) WHERE f < w.doc_id),
g AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM c),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM g),
p AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY ALL),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM p),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_spans, max(b) AS last FROM q GROUP BY 1),
k AS (SELECT q.doc_id, string_agg(substring(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS pre FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(pre, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Parts as integers, then each round's nearest entries and their means, rounded down.
_CODES = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, part, list_slice(v, part * (len(v) // 8) + 1, (part + 1) * (len(v) // 8)) AS x FROM k, range(8) AS t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 16)
{"".join(f""",
d{i} AS (SELECT r, p.part, entry, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{i} USING (part)),
a{i} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS m FROM d{i} GROUP BY r, part)""" + (f""",
s{i} AS (SELECT part, m.entry AS entry, generate_subscripts(x, 1) AS pos, unnest(x) AS y FROM a{i}),
n{i} AS (SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM (SELECT part, entry, pos, sum(y)::BIGINT AS total, count(*) AS n FROM s{i} GROUP BY ALL) GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (part, entry))""" if i < 6 else "") for i in range(7))},
e AS (SELECT vec_id, label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a6 JOIN k USING (r) GROUP BY r, vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h
"""

#: crc32 by its polynomial, eight steps a byte; words without one code point bring near words together.
_SPELLING = """
WITH t AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
y AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM u),
c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda j: (instr('0123456789ABCDEF', x[2 * j + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * j + 2]) - 1)), lambda a, b: xor(t[CAST(xor(a, b) & 255 AS INT) + 1], a >> 8)), 4294967295) AS h FROM y, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM c),
k AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT DISTINCT word, i, left(word, i) || substring(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM k)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, k.word FROM d JOIN k ON d.less = k.word UNION SELECT k.word, d.word FROM d JOIN k ON d.less = k.word),
f AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(less := -k.n, b := b)) AS m FROM p JOIN k ON k.word = b GROUP BY a),
g AS MATERIALIZED (SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 5 * k.n THEN m.b END AS form, CASE WHEN -m.less >= 5 * k.n THEN -m.less END AS form_n FROM k LEFT JOIN f USING (word)),
o AS (WITH RECURSIVE o(word, now, form) AS (SELECT word, word, form FROM g UNION ALL SELECT o.word, g.word, g.form FROM o JOIN g ON g.word = o.form) SELECT word, now AS root FROM o WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM g JOIN o USING (word)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same: models, hashes of 64 bits and random draws have none."""
    return {"op2_suffixes": _SUFFIXES, "op11_codes": _CODES, "op12_spelling": _SPELLING}
