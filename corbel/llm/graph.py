"""Connected components on DataFrames, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.common import discard, materialize


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node that it reaches.

    Each round points the larger neighbours of a node, then the smaller ones,
    at the smallest neighbour, until nothing moves; edges never multiply and the
    number of rounds is logarithmic in practice.  Every round's edges are written
    to the shared folder, and the round before is deleted.  A node of very many edges is first aggregated on the map side; its
    least neighbour is written, so that the join back meets plain shuffles, of
    which Spark can split a large key.  Null ends and loops are dropped.
    """

    used: list[DataFrame] = []

    def kept(table: DataFrame, name: str) -> DataFrame:
        used.append(materialize(table, name))
        return used[-1]

    def star(e: DataFrame, both: bool) -> DataFrame:
        # Neighbours of each node: all of them, or only the smaller ones.
        pairs = e.select("u", "v")
        if both:
            pairs = pairs.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        joined = pairs.join(least, "u")
        moved = joined.where("v > u" if both else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not both:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(f"{u} is not null and {v} is not null and u <> v").distinct()
    e, before, now = kept(e, "edges"), None, ()
    while now != before:
        before = now
        # Large star keeps (larger, least); small star works on edges from larger to smaller.
        large = star(e, True)
        small = star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), False)
        e = kept(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for old in used[:-1]:
            discard(old)
        del used[:-1]
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
