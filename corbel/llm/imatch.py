"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Terms are 64-bit hashes of words, whose documents are counted exactly.  The
lexicon holds the terms of a band of inverse document frequencies, as bits of a
filter of fixed size.  Each text's distinct lexicon terms are sorted and hashed
over many randomised subsets of the lexicon: chains that halve it again and
again, so that texts of every length meet subsets of which they hold a few terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel.llm.common import materialize, text_of

#: Bits of the lexicon's filter, a power of two, and how many of them each term sets.
FILTER, PROBES = 1 << 21, 3
#: The band: terms in at least and at most this share of the documents.
RAREST, COMMONEST = 0.001, 0.1
#: Random chains of subsets, and how often each chain halves the lexicon.
CHAINS, HALVINGS = 12, 11
#: Documents in a bucket of neighbours on the average, buckets at most, and rows sampled for the bound of each.
IDS, BUCKETS, SAMPLED = 1024, 16_384, 16


def terms_of(text: Column) -> Column:
    """The sorted distinct term hashes of a text; empty for texts without words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _bit(term: Column, probe: int) -> Column:
    """Which bit of the filter a term sets for a probe."""
    first, step = term.bitwiseAND(F.lit(FILTER - 1)), F.call_function("shiftrightunsigned", term, F.lit(32))
    return (first + step * F.lit(probe)).bitwiseAND(F.lit(FILTER - 1))


def lexicon(docs: DataFrame, text_column: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> Column:
    """The terms of the band as a literal of FILTER / 64 numbers.

    A term is in the band if at least two documents and at least ``rarest`` of
    all hold it, and at most ``commonest``.  All documents and all terms are
    counted.  A band has at most the mean number of distinct terms of a
    document, divided by ``rarest``, members; of 150,000 members the filter lets
    through less than one other term in a hundred, the same in every text.
    """
    n = docs.count()
    found = docs.select(F.explode(terms_of(text_of(text_column))).alias("t")).groupBy("t").count()
    band = found.where((F.col("count") >= max(2.0, rarest * n)) & (F.col("count") <= max(2.0, commonest * n)))
    places = band.select(F.explode(F.array(*[_bit(F.col("t"), k) for k in range(PROBES)])).alias("p"))
    bits = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS INT))")).alias("bits"))
    words = [0] * (FILTER // 64)
    for row in bits.collect():  # as many rows as the filter has numbers at most
        words[row["w"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def in_lexicon(term: Column, lex: Column) -> Column:
    """Whether all bits of a term are set."""
    out = F.lit(True)
    for k in range(PROBES):
        p = _bit(term, k)
        word = F.get(lex, F.shiftright(p, 6).cast("int"))
        out = out & (F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def with_signatures(df: DataFrame, terms: str, lex: Column, column: str, chains: int = CHAINS, halvings: int = HALVINGS) -> DataFrame:
    """``df`` with an array of signatures from a column of terms.

    First the hash of all terms, then of those in the lexicon, then of every
    chain's halves; null for a subset of which the text holds no term.
    """

    def signed(a: Column) -> Column:
        return F.when(F.size(a) > 0, F.xxhash64(a))

    kept = F.filter(F.col(terms), lambda t: in_lexicon(t, lex))
    df = df.withColumn("__kept", kept)
    df = df.withColumn(column, F.array(F.xxhash64(terms), signed(F.col("__kept")))).withColumn("__subs", F.array_repeat("__kept", chains)).drop("__kept")
    for level in range(halvings):
        # Bit `level` of a hash that belongs to the chain says which terms stay.
        halved = F.transform("__subs", lambda a, r: F.filter(a, lambda t: F.xxhash64(t, r).bitwiseAND(F.lit(1 << level)) == 0))
        df = df.withColumn("__subs", halved)
        df = df.withColumn(column, F.concat(column, F.transform("__subs", signed)))
    return df.drop("__subs")


def likeness(a: str, b: str) -> Column:
    """Equal signatures, of those of which either text has one; 1 for texts without words."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(either > 0, same / either).otherwise(F.lit(1.0))


def printable(signatures: str) -> Column:
    """Signatures as text: eight hexadecimal digits each, - where there is none."""
    return F.concat_ws("", F.transform(signatures, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("-"))))


def range_of(rows: DataFrame, per_range: int, most: int) -> Column:
    """The number of a row's range of (id, h), null ids first: ranges hold about as many rows, wherever the ids lie.

    Bounds are quantiles of a sample by hash of about SAMPLED rows a range; a
    row looks its range up by halving.  Ids are compared and never subtracted.
    """
    n = rows.count()
    ranges = min(most, -(-n // per_range) or 1)
    some = rows.where(F.pmod(F.xxhash64("id", "h"), F.lit(max(1, n // (SAMPLED * ranges)))) == 0).select("id", "h").distinct()
    found = sorted(((r["id"] is not None, r["id"] or 0, r["h"]) for r in some.collect()))
    bounds = sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []
    if not bounds:
        return F.lit(0)
    there, ids, hashes = (F.split(F.lit(",".join(str(int(x)) for x in column)), ",").cast("array<bigint>") for column in zip(*bounds))
    f, i, h = F.col("id").isNotNull().cast("long"), F.coalesce("id", F.lit(0).cast("long")), F.col("h")

    def passed(k: Column) -> Column:
        a, b, c = F.get(there, k), F.get(ids, k), F.get(hashes, k)
        return (a < f) | ((a == f) & ((b < i) | ((b == i) & (c <= h))))

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(passed(at + step - 1), at + step).otherwise(at))


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, h, next_text, bucket, ghost): every text with that of the next document, by descending id.

    The first document follows the last.  Null ids come last; rows that share an
    id, or have none, are ordered by a hash of their texts.  Neighbours are
    found in ranges of that order; the first document of each range goes as a
    ghost to the end of the range before, so one shuffle of the texts is enough.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("bucket", range_of(rows, IDS, BUCKETS))
    heads = materialize(rows.groupBy("bucket").agg(F.max(F.struct("id", "h", "text")).alias("head")), "heads")
    # One row per bucket, at most BUCKETS.
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    after = heads.select("bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy(F.lit(0)))).alias("to"))
    ghosts = heads.join(after, "bucket").select("head.id", "head.text", "head.h", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    every = rows.select("id", "text", "h", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts)
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("id"), F.desc("h"))
    return every.withColumn("next_text", F.lead("text").over(w))


def fingerprint_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness; see ``op7_imatch``.

    Null texts count as empty, which have one fingerprint; equal texts have
    equal ones.  Of rows that repeat each is the next of another.  Other columns
    play no part; an empty table gives no rows.
    """
    lex = lexicon(docs, text_column, rarest, commonest)
    half = F.floor(F.length("text") / 2).cast("int")
    df = with_next(docs, id_column, text_column).withColumn("half", half)
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - half)"), F.expr("substring(coalesce(next_text, ''), 1, half)"))
    df = df.select("id", "bucket", "ghost", "h", F.length("text").cast("long").alias("n_chars"), terms_of(F.col("text")).alias("terms"), edited.alias("edited"))
    df = df.select("id", "bucket", "ghost", "h", "n_chars", "terms", F.sha2("edited", 256).alias("edited_sha256"), terms_of(F.col("edited")).alias("edited_terms"))
    df = with_signatures(df, "terms", lex, "sig").drop("terms")
    df = with_signatures(df, "edited_terms", lex, "edited_sig").drop("edited_terms")
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("id"), F.desc("h"))
    df = df.withColumn("next_sig", F.lead("sig").over(w)).where(~F.col("ghost"))
    return df.select("id", "n_chars", "edited_sha256", printable("sig").alias("fingerprint"), printable("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))


def op7_imatch(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every document."""
    return fingerprint_pairs(docs).withColumnRenamed("id", "doc_id")
