"""Similarity join of names by ``token_set_ratio``, without holding every name against every other.

A pair can reach the cutoff in two ways.  Either the shared words make up most
of one side, so that one of this side's rarest words, as many as can't be
spared, is a word of the other.  Or both sides, written with the shared words
first, have a long common subsequence; then many of their character grams are
shared, whatever the order of the words, and shared grams are counted.  Rare
words are join keys, grams are looked up in an index of some of the asked
texts at a time; what meets is verified.  Nothing is left out and no side is
bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corbel.functions.ranking import token_set_ratio_udf
from corbel.operators.cut import materialize

#: White space as the likeness splits words.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Room for rounding in bounds on lengths.
_LITTLE = 1e-6
#: Asked texts whose grams go to every task at once, and pairs that a task gives at once.
ASKED, PAIRS = 10_000, 50_000


def _named(texts: DataFrame) -> DataFrame:
    """(text, words, size): distinct texts that have words; size is that of the distinct words with one blank between."""
    words = F.array_distinct(F.filter(F.split("text", _BLANK), lambda w: w != ""))
    rows = texts.select("text").where("text is not null").distinct().select("text", words.alias("words"))
    return rows.where(F.size("words") > 0).select("text", "words", F.length(F.array_join("words", " ")).alias("size"))


def _grams(words: list[str], q: int) -> list[str]:
    """The grams of words with a blank at either end, so that none spans two words, repeats numbered; for single characters the blanks between words."""
    if q == 1:
        found = list(" ".join(words))
    else:
        found = [w[at : at + q] for w in (f" {w} " for w in words) for at in range(len(w) - q + 1)]
    seen: dict[str, int] = {}
    out = []
    for g in found:
        n = seen[g] = seen.get(g, -1) + 1
        out.append(f"{g}{n}" if n else g)
    return out


def _needed(q: int, cutoff: float) -> Column:
    """Grams that a text shares at least with any that reaches the cutoff by its characters.

    Of two texts of ``both`` characters, at least cutoff / 200 of these are in
    the common subsequence; every character left out costs q grams on its own
    side at most, and q - 1 on the other.
    """
    both = F.col("size") * 200.0 / (200.0 - cutoff)
    share = cutoff / 200.0
    if q == 1:
        return both * share
    gain = (2 * q - 1) * share - (q - 1)
    lost = F.size("words") - 1 if q == 3 else F.lit(-1)
    return both * gain - lost if gain > 0 else F.lit(0.0)


def _kinds(names: DataFrame, cutoff: float) -> DataFrame:
    """With ``q``, the longest grams of which more than one must be shared."""
    return names.withColumn("q", F.when(_needed(3, cutoff) > 1, 3).when(_needed(2, cutoff) > 1, 2).otherwise(1))


def _rarest(rows: DataFrame, item: str, counts: DataFrame, last: Column) -> DataFrame:
    """Of each text's rows (text, size, ``item``, ...) those that stand before ``last``, a condition on its rarer ones."""
    ranked = rows.join(counts, item, "left")
    listed = ranked.groupBy("text").agg(F.first("size").alias("size"), F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col(item).alias("item")))).alias("items"))
    return listed.select("text", "size", F.explode(F.slice("items", 1, F.greatest(F.lit(1), last))).alias("i")).select("text", "size", F.col("i.item").alias(item))


def _by_words(asked: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(q, key): pairs where a rare word of one side is a word of the other.

    An asked text of one word scores 100 with every name that has it, of which
    the first in order stands for all.
    """
    exploded = lambda df: df.select("text", "size", F.size("words").alias("room"), F.explode("words").alias("word"))
    mine, yours = exploded(asked), exploded(names)
    counts = materialize(yours.groupBy("word").agg(F.count("*").alias("n"), F.min("text").alias("first")), "words")
    # What stands after the prefix would be too short to be all that is shared.
    least = F.col("size") * (cutoff / (200.0 - cutoff)) - _LITTLE
    tail = lambda at: F.aggregate(F.slice("items", at + 1, F.size("items")), F.lit(-1), lambda n, i: n + F.length(i["item"]) + 1)
    enough = F.filter(F.sequence(F.lit(1), F.size("items")), lambda at: tail(at) < least)
    last = F.coalesce(F.get(enough, F.lit(0)), F.size("items"))
    rare = lambda df: _rarest(df, "word", counts.select("word", "n"), last).select("text", "word")
    one = mine.where("room = 1").join(counts.select("word", "first"), "word").select(F.col("text").alias("q"), F.col("first").alias("key"))
    from_asked = rare(mine.where("room > 1")).withColumnRenamed("text", "q").join(yours.select("word", F.col("text").alias("key")), "word").select("q", "key")
    from_names = mine.where("room > 1").select("word", F.col("text").alias("q")).join(rare(yours).withColumnRenamed("text", "key"), "word").select("q", "key")
    return one.unionByName(from_asked).unionByName(from_names)


def _shares(q: int, cutoff: float) -> tuple[float, bool]:
    """``_needed`` for both sizes known: grams shared for each character of the two, and whether each blank within costs one."""
    share = cutoff / 200.0
    return (share, False) if q == 1 else ((2 * q - 1) * share - (q - 1), q == 3)


def _by_grams(asked: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(q, key): pairs of like sizes that share as many grams as they must; ASKED texts at a time meet all names."""
    n = asked.count() // ASKED + 1
    parts = [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64("text"), F.lit(n + 1)) == k) for k in range(n + 1)]  # hashed parts are uneven
    out = None
    for part in parts:
        pairs = _by_grams_of(part, names, cutoff)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _by_grams_of(asked: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    shared = asked.sparkSession.sparkContext.broadcast([(r["text"], r["words"], r["size"], r["q"]) for r in asked.select("text", "words", "size", "q").collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = []
        for q in sorted({r[3] for r in shared.value}):
            mine = [r for r in shared.value if r[3] == q]
            index: dict[str, list[int]] = {}
            for k, r in enumerate(mine):
                for g in _grams(r[1], q):
                    index.setdefault(g, []).append(k)
            size = np.array([r[2] for r in mine], float)
            gain, blanks = _shares(q, cutoff)
            lost = np.array([len(r[1]) - 1 if blanks else -1 if q == 2 else 0 for r in mine], float)
            kinds.append((q, [r[0] for r in mine], {g: np.array(x, np.int32) for g, x in index.items()}, size, gain, lost))
        asks, keys = [], []
        for b in batches:
            for key, words, other in zip(b["text"], b["words"], b["size"]):
                for q, texts, index, size, gain, lost in kinds:
                    held = [x for g in _grams(list(words), q) if (x := index.get(g)) is not None]
                    if not held:
                        continue
                    n = np.bincount(np.concatenate(held), minlength=len(texts))
                    alike = np.minimum(size, other) * (200.0 - cutoff) >= np.maximum(size, other) * cutoff - _LITTLE
                    for k in np.flatnonzero(alike & (n > 0) & (n >= gain * (size + other) - lost - _LITTLE)):
                        asks.append(texts[k])
                        keys.append(key)
                    if len(keys) >= PAIRS:
                        yield pd.DataFrame({"q": asks, "key": keys})
                        asks, keys = [], []
        yield pd.DataFrame({"q": asks, "key": keys}, dtype=object)

    return names.select("text", "words", "size").mapInPandas(run, "q string, key string")


def similar(asked: DataFrame, names: DataFrame, cutoff: float = 88.0) -> DataFrame:
    """(q, key, score): the texts of ``asked`` and the names whose ``token_set_ratio`` is ``cutoff`` or more.

    Both have a column ``text``.  Repeated texts count once; null texts and those
    without words match nothing.  Of the names that hold an asked text of one
    word, all of score 100, only the first in order is listed.
    """
    if not 0 < cutoff <= 100:
        raise ValueError("cutoff must be above 0 and 100 at most")
    asked, names = materialize(_kinds(_named(asked), cutoff), "asked"), materialize(_named(names), "names")
    # Few files hold many names, and each of them is held against all asked texts.
    spread = names.repartition(names.sparkSession.sparkContext.defaultParallelism, "text")
    pairs = materialize(_by_words(asked, names, cutoff).unionByName(_by_grams(asked, spread, cutoff)).distinct(), "pairs")
    return pairs.withColumn("score", token_set_ratio_udf("q", "key")).where(F.col("score") >= cutoff)
