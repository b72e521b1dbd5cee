"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due the same ratio of copies, a whole part and a
fractional one.  Fractional parts are settled in pairs: mass moves at random
from one document to the other, keeping the pair's words and each one's
expectation, until one of the two is whole.  Each task settles a bounded chunk
of a source and leaves one residual at most; residuals meet in a reduction tree
until one per source is left, which is rounded by itself.  Large documents
are paired first, so that residuals are small.  Rows that are equal throughout
are one group, whose members are numbered and dealt to chunks by their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corbel.llm.common import WORD, materialize, packed, row_hash, text_of, unpacked

#: Documents of a source that one task settles at most, on the average, and residuals that meet in a node of the tree.
CHUNK = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total_ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, ratio) for every source of (source, size).

    Sources take the weights in turn, by code point and null last, and share
    ``total_ratio`` of all sizes.  What a source can't take beyond ``most`` times
    its size is shared again by weight: sources by the share at which each is
    full, those are full whose own share lies under the level that the others
    then reach.  One task orders the sources, of which it gets one row each.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(listed, place % len(weights))).withColumn("limit", F.col("source_size") * most)
    per = per.withColumn("full_at", F.col("limit") / F.col("weight"))
    before = Window.orderBy("full_at", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = total_ratio * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    # The first source that isn't full tells the level of all that aren't.
    reached = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]
    target = F.least("limit", F.coalesce(reached * F.col("weight"), F.col("limit")))
    return per.select("source", "source_size", target.alias("target")).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _draw(key: bytes, other: bytes, seed: int) -> float:
    """A number in [0, 1) that belongs to a pair of rows."""
    return (xxhash.xxh64_intdigest(key + b"/" + other, seed) >> 11) / 2**53


def settle(keys: list[bytes], sizes: np.ndarray, parts: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round fractional parts in pairs; returns the parts and the row still open, or -1.

    Rows come in the order in which they shall meet.
    """
    p, open_ = parts.astype(float).tolist(), -1
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        if open_ < 0:
            open_ = k
            continue
        i, j, a, b = open_, k, float(sizes[open_]), float(sizes[k])
        # Words that may move from j to i, and from i to j, until one part is 0 or 1.
        up, down = min((1 - p[i]) * a, p[j] * b), min(p[i] * a, (1 - p[j]) * b)
        if _draw(keys[i], keys[j], seed) < down / (up + down):
            i_whole = (1 - p[i]) * a <= p[j] * b
            p[i], p[j] = (1.0, p[j] - up / b) if i_whole else (p[i] + up / a, 0.0)
        else:
            i_whole = p[i] * a <= (1 - p[j]) * b
            p[i], p[j] = (0.0, p[j] + down / b) if i_whole else (p[i] - down / a, 1.0)
        p[j] = min(max(p[j], 0.0), 1.0)
        p[i] = min(max(p[i], 0.0), 1.0)
        still = [x for x in (i, j) if 1e-12 < p[x] < 1 - 1e-12]
        for x in (i, j):
            if x not in still:
                p[x] = round(p[x])
        open_ = still[0] if still else -1
    return np.array(p), open_


def _settled(seed: int):
    """Over rows sorted by node and size: the settled rows and each node's residual."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def close(rows: pd.DataFrame) -> pd.DataFrame:
            p, still = settle([f"{a}:{b}".encode() for a, b in zip(rows["row_key"], rows["size"])], rows["size"].to_numpy(), rows["part"].to_numpy(float), seed)
            rows = rows.assign(part=p, open=False)
            if still >= 0:
                rows.iloc[still, rows.columns.get_loc("open")] = True
            return rows

        node = None
        for b in batches:
            for key, rows in b.groupby(["__source", "__node"], sort=False, dropna=False):
                if key != node and held:
                    yield close(pd.concat(held, ignore_index=True))
                    held = []
                node = key
                held.append(rows)
        if held:
            yield close(pd.concat(held, ignore_index=True))

    return run


def _mixed(rows: DataFrame, weights: tuple[int, ...], total_ratio: float, most: float, chunk: int, seed: int) -> DataFrame:
    """``rows`` (id, source, size, place) with source_size, target and copies for each; place tells rows of one id apart."""
    spark = rows.sparkSession
    groups = materialize(rows.groupBy("id", "source", "size", "place").agg(F.count("*").alias("n")), "sizes")
    # Spark broadcasts the shares if they are few: one row for each source.
    shares = targets(groups.select("source", (F.col("size") * F.col("n")).alias("size")), weights, total_ratio, most)
    shares = materialize(shares.withColumn("__source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source"), "shares")
    rows = groups.withColumn("__source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).join(shares, "__source")
    # Numbers in two steps, so that no array grows with a group.
    rows = rows.withColumn("base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1 << 16).cast("long"))))
    rows = rows.withColumn("number", F.explode(F.sequence(F.col("base"), F.least(F.col("base") + (1 << 16), F.col("n")) - 1))).drop("base")
    rows = rows.withColumn("row_key", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("place").cast("string"), F.col("number").cast("string")))
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor("ratio")).otherwise(0).cast("double"))
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.col("ratio") - F.col("whole")).otherwise(0.0))
    count, sources = groups.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n"), F.count("*")).first()
    nodes = -(-(count or 0) // chunk) or 1
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes * sources))
    rows = rows.withColumn("open", F.lit(True)).withColumn("__node", F.pmod(F.xxhash64("row_key"), F.lit(nodes)))
    done = None
    while True:
        order = rows.repartition(parts, "__source", "__node").sortWithinPartitions("__source", "__node", F.desc("size"), F.xxhash64("row_key"), "row_key")
        level = materialize(order.mapInPandas(_settled(seed), rows.schema), "mix")
        closed = level if nodes == 1 else level.where("not open")
        done = closed if done is None else done.unionByName(closed)
        if nodes == 1:
            break
        nodes = -(-nodes // chunk)
        rows = level.where("open").withColumn("__node", F.pmod(F.col("__node"), F.lit(nodes)))
    # A source's last residual is rounded alone.
    last = F.when(F.col("open") & (F.col("part") > 0) & (F.col("part") < 1), (F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("part")).cast("double")).otherwise(F.round("part"))
    copies = (F.col("whole") + last).cast("long")
    return done.select("id", "size", "source", "source_size", "target", copies.alias("copies"), "place")


def words_in(text_column: str = "text") -> Column:
    """How many words a text has; none if it is null."""
    return F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (3, 1, 2), total_ratio: float = 1.5, most: float = 2.0, chunk: int = CHUNK, seed: int = 20_26) -> DataFrame:
    """id, size, source, source_size, target, copies and taken for every row.

    size counts words; taken is size times copies.  Documents without words
    take nothing, null texts have none.  Null sources are one source, null and
    repeated ids are allowed: each row is rounded by itself, and neither an id
    nor equal rows end up in one chunk.  The draws depend on the ids, texts and
    sizes that meet, so reruns agree.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), words_in(text_column).alias("size"), F.xxhash64(text_of(text_column)).alias("place"))
    found = _mixed(rows, weights, total_ratio, most, chunk, seed)
    return found.select("id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document."""
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def take_mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.

    Texts without words are kept once.  Rows of one id, source and text are dealt
    their copies in turn, by a hash of the whole row.  Nulls and repeated ids: see ``mix``.  Texts are
    shuffled once, to meet their counts.
    """
    rows = packed(docs, id=F.col("doc_id"), source=F.col("source").cast("string"), size=words_in(), place=F.xxhash64(text_of()), other=row_hash(docs))
    found = _mixed(rows.select("id", "source", "size", "place"), (3, 1, 2), 1.5, 2.0, CHUNK, 20_26)
    copies = F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).cast("long")
    per = found.groupBy(F.col("place").alias("of"), F.col("id").alias("of_id"), F.col("source").alias("of_source")).agg(copies.alias("copies"), F.count("*").alias("n")).where("copies > 0")
    same = (F.col("place") == F.col("of")) & F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source"))
    taken = rows.select("row", "id", "source", "place", "other").join(per, same)
    turn = F.row_number().over(Window.partitionBy("place", "id", "source").orderBy("other"))
    times = (F.floor(F.col("copies") / F.col("n")) + F.when(turn <= F.col("copies") % F.col("n"), 1).otherwise(0)).cast("int")
    taken = taken.select("row", times.alias("times")).where("times > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))), docs.columns)
