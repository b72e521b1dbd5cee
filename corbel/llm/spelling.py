"""Spelling variants: words of a corpus that are one edit apart, and the form that each belongs to.

One edit leaves a half of a word intact.  So two dictionaries, one of the words
and one of the words read backwards, have both words of a near pair in one
block: the range of words of a length that share the first half, or the last.
Spark deals both by block, sorts them and scans the ranges against each other.
A block that holds many words is subdivided: what its words don't share is
again left intact in one half by the edit, until one code point is left, when a
block has no more words than the alphabet has letters.  A pair is verified in
one block alone, the one that the place of its edit names, so none comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel.llm.common import discard, materialize, own, text_of

#: A run of letters, and the letters that are lower-cased.
RUN, UPPER, LOWER = r"[A-Za-z\u00C0-\u00FF]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a block, above which it is subdivided.
BLOCK = 32


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n) for all words of at least ``least_length`` code points and ``least_count`` occurrences.

    A run whose hash (crc32 of id, colon and run) ``every`` divides loses one
    code point, so that corpora without misspellings have some; ``every=0``
    leaves the runs alone.  Null texts have no runs, and a null id is empty.
    """
    runs = docs.select(F.coalesce(own(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(text_column), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.expr("left(word, cast(h % length(word) as int))"), F.substring("word", at + 2, F.length("word")))
        runs = runs.select("word", h.alias("h")).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of a block twice: in the block of a longer shared beginning, and of a longer shared end.

    A pair whose words share the longer beginning is verified there, so the
    other block asks for pairs that differ before ``until``.
    """
    half = F.floor((F.col("short") - F.col("pre") - F.col("suf")) / 2).cast("int")
    rest = (F.col("short") - F.col("pre") - F.col("suf") - half).cast("int")
    first = F.struct((F.col("pre") + half).alias("pre"), F.col("suf"), F.col("until"))
    last = F.struct(F.col("pre"), (F.col("suf") + rest).alias("suf"), (F.col("pre") + half).alias("until"))
    return rows.select("word", "short", F.explode(F.array(first, last)).alias("b")).select("word", "short", "b.pre", "b.suf", "b.until")


def _keyed(rows: DataFrame) -> DataFrame:
    """With the block's name, by which both dictionaries are dealt and sorted."""
    return rows.withColumn("block", F.concat_ws(" ", "short", "pre", "suf", "until", F.expr("left(word, pre)"), F.expr("right(word, suf)")))


def _blocks(words: DataFrame, most: int) -> DataFrame:
    """(word, short, until, block): rows of blocks of ``most`` words or fewer, or of one open code point.

    ``short`` is the length of a pair's shorter word: a word stands in the
    blocks of its own length and in those of words that are one shorter.
    """
    size = F.length("word").cast("int")
    start = words.select("word", F.explode(F.array(size, size - 1)).alias("short")).where("short > 0")
    rows = _halves(start.select("word", "short", F.lit(0).alias("pre"), F.lit(0).alias("suf"), F.lit(None).cast("int").alias("until")))
    done, spent = None, []
    while True:
        now = materialize(_keyed(rows), "blocks")
        spent.append(now)
        large = now.where("short - pre - suf > 1").groupBy(F.col("block").alias("of")).agg(F.count("*").alias("size")).where(F.col("size") > most).select("of")
        large = materialize(large, "large")
        spent.append(large)
        if large.isEmpty():
            small = now
        else:
            small = now.join(large, now["block"] == large["of"], "left_anti")
            rows = _halves(now.join(large, now["block"] == large["of"], "left_semi"))
        done = small if done is None else done.unionByName(small)
        if small is now:
            out = materialize(done.select("word", "short", "until", "block"), "dictionary")
            for table in spent:
                discard(table)
            return out


def _differ(a: Column, b: Column, until: Column) -> Column:
    return until.isNull() | (F.left(a, until) != F.left(b, until))


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(a, b) once for every two distinct words of ``word`` that differ by one inserted, deleted or replaced code point.

    Null words are dropped and repeated ones count once.  Each block is at most
    ``most`` words or an alphabet, so the work grows with the words.
    """
    rows = _blocks(words.select("word").where("word is not null").distinct(), most)
    left = rows.where(F.length("word") == F.col("short")).select("block", "until", F.col("word").alias("a"))
    right = rows.select("block", F.col("word").alias("b"), (F.length("word") > F.col("short")).alias("longer"))
    pair = (F.col("longer") | (F.col("a") < F.col("b"))) & _differ(F.col("a"), F.col("b"), F.col("until")) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right.withColumnRenamed("block", "of"), (F.col("block") == F.col("of")) & pair).select("a", "b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word that has a form: each round doubles the steps that are taken at once."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        moved = materialize(now.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(now)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")
        now._corbel_path = moved._corbel_path


def variants(words: DataFrame, ratio: int = 5, most: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of (word, n), whose words are distinct and not null.

    form is the near word of the largest n, of equal ones the smallest in
    code-point order, if that n is at least ``ratio`` times the word's own.
    Forms have larger n, so no circle arises and following them ends.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could go round")
    pairs = materialize(near_words(words, most), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    mine = F.col("n_near").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(mine, F.col("best.b")).alias("form"), F.when(mine, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the documents.

    Whole texts are read; null texts and empty ones have no words, repeated
    rows and ids count each time, other columns are not looked at, and an empty
    table gives no rows.
    """
    words = materialize(word_counts(docs), "words")
    return variants(words)
