"""Approximate nearest neighbours by balanced posting lists.

Vectors get one more number, so that the largest inner product is the smallest
distance.  Centroids are fitted on a bounded sample, in two levels so that lists
are about as long, and searched by a graph in memory.  A vector near the border
of its list joins the next ones too.  A query reads the lists within a distance
ratio, the one by which the true neighbours of some queries are found.  Long
lists are split into parts of bounded size, and so are a list's queries; within
a part scores are exact.  A query first reads the nearest of its lists, whose
best bound what the others need return.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corbel.llm.common import materialize

#: Lists at most, which bounds the graph that is broadcast; up to that, a list has the root of the vectors' number, and this at least.
LISTS, LIST = 16_384, 64
#: Vectors of the sample for each list, numbers in the sample at most, and further vectors that tell where borders are.
SAMPLE, NUMBERS, FURTHER = 8, 1 << 25, 2000
#: Lists that a vector joins at most, and the share of vectors, those nearest to a border, that join more than one.
REPLICAS, BOUNDARY = 4, 0.25
#: Vectors of a list's part, and queries that meet it, on the average at most.
PART = 4096
#: Queries whose true neighbours tell the ratio, and the share of them that it must find.
ASKED, RECALL = 200, 0.93


@dataclass(frozen=True)
class Graph:
    """Centroids, and for each the nearest others and a few far ones."""

    centroids: np.ndarray
    links: np.ndarray

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and distances, nearest first, that a best-first walk with this beam reaches for each row."""
        c, n, k = self.centroids, len(x), len(self.centroids)
        beam = min(beam, k)
        squares, own = (c**2).sum(1), (x**2).sum(1)
        start = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
        best = np.tile(start, (n, 1))
        dist = own[:, None] + squares[best] - 2 * np.einsum("nd,nbd->nb", x, c[best])
        met = np.zeros((n, k), bool)
        met[:, start] = True
        done = np.zeros(best.shape, bool)
        rows = np.arange(n)[:, None]
        while not done.all():
            # The best open centroids of each row, a few at a time.
            rank = np.where(done, np.inf, dist)
            pick = np.argsort(rank, axis=1, kind="stable")[:, :4]
            live = np.isfinite(np.take_along_axis(rank, pick, 1))
            np.put_along_axis(done, pick, True, 1)
            near = np.where(live[:, :, None], self.links[np.take_along_axis(best, pick, 1)], -1).reshape(n, -1)
            fresh = (near >= 0) & ~met[rows, np.maximum(near, 0)]
            # The same centroid may come by two ways: keep its first.
            order = np.argsort(near, axis=1, kind="stable")
            sorted_ = np.take_along_axis(near, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            fresh &= ~twice
            at, col = np.nonzero(fresh)
            met[at, near[at, col]] = True
            safe = np.maximum(near, 0)
            d = np.where(fresh, own[:, None] + squares[safe] - 2 * np.einsum("nd,nbd->nb", x, c[safe]), np.inf)
            best, dist, done = np.concatenate([best, safe], 1), np.concatenate([dist, d], 1), np.concatenate([done, ~fresh], 1)
            keep = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            best, dist, done = (np.take_along_axis(a, keep, 1) for a in (best, dist, done))
        return best, np.sqrt(np.maximum(dist, 0))

    def all_distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0))

    def within(self, x: np.ndarray, ratio: float, most: int | None = None) -> list[np.ndarray]:
        """For each row the centroids within ``ratio`` times the nearest distance, nearest first, ``most`` at most.

        The beam widens until it reaches past the ratio; a row that needs a
        large share of all centroids is compared with each of them.
        """
        out: list[np.ndarray] = [np.zeros(0, int)] * len(x)
        k = len(self.centroids)
        rows, beam = np.arange(len(x)), 4 * most if most else 64
        while len(rows):
            if beam * 4 >= k:
                d = self.all_distances(x[rows])
                best = np.argsort(d, axis=1, kind="stable")
                dist, whole = np.take_along_axis(d, best, 1), np.ones(len(rows), bool)
            else:
                best, dist = self.nearest(x[rows], beam)
                whole = np.full(len(rows), most is not None) | (dist[:, -1] > dist[:, 0] * ratio + 1e-6)
            good = np.isfinite(dist) & (dist <= np.maximum(dist[:, :1] * ratio, dist[:, :1] + 1e-6))
            for i in np.flatnonzero(whole):
                out[rows[i]] = best[i][good[i]][:most]
            rows, beam = rows[~whole], beam * 4
        return out


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` centroids by k-means and each row's; a centroid without rows starts anew at a far one."""
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    c = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    a, far = np.zeros(len(x), int), np.zeros(len(x))

    def assign() -> None:
        for at in range(0, len(x), 4096):
            d = (c**2).sum(1) - 2 * x[at : at + 4096] @ c.T
            a[at : at + 4096], far[at : at + 4096] = d.argmin(1), d.min(1) + (x[at : at + 4096] ** 2).sum(1)

    for _ in range(rounds):
        assign()
        n = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    assign()
    return c, a


def fit_graph(sample: np.ndarray, lists: int, rounds: int = 8, degree: int = 24, seed: int = 5) -> Graph:
    """Centroids in two levels: coarse ones, and within each as many as its share of the sample calls for."""
    rng = np.random.default_rng(seed)
    _, top = _means(sample, int(np.sqrt(lists)) if lists > 64 else 1, rounds, rng)
    parts = [sample[top == k] for k in range(top.max() + 1)]
    c = np.concatenate([_means(p, max(1, round(lists * len(p) / len(sample))), rounds, rng)[0] for p in parts if len(p)])
    lists = len(c)
    links = np.full((lists, min(lists - 1, degree) + 4), -1)
    for k in range(lists):
        d = ((c - c[k]) ** 2).sum(1)
        d[k] = np.inf
        links[k, : min(lists - 1, degree)] = np.argsort(d, kind="stable")[: min(lists - 1, degree)]
    links[:, -4:] = rng.integers(0, lists, (lists, 4))
    links[:, -1] = (np.arange(lists) + 1) % lists  # a ring: every centroid can be reached
    return Graph(c, links)


def border(graph: Graph, sample: np.ndarray, share: float = BOUNDARY) -> float:
    """The distance ratio of the second centroid to the first within which that share of the vectors lies."""
    if len(graph.centroids) < 2:
        return 1.0
    d = np.sort(np.concatenate([np.partition(graph.all_distances(sample[k : k + 4096]), 1, axis=1)[:, :2] for k in range(0, len(sample), 4096)]), axis=1)
    return float(np.quantile(d[:, 1] / np.maximum(d[:, 0], 1e-12), share))


def calibrate(graph: Graph, asked: np.ndarray, neighbours: list[np.ndarray], near: float, wanted: float = RECALL) -> float:
    """The smallest ratio by which that share of the queries' true neighbours lies in a list that is read."""
    needed = []
    for q, x in zip(graph.all_distances(asked), neighbours):
        if len(x):
            needed += [q[some].min() / max(q.min(), 1e-12) for some in graph.within(x, near, REPLICAS)]
    if not needed:
        return 1.0
    return float(np.quantile(needed, wanted, method="higher")) * (1 + 1e-9)


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _best(q_uid: np.ndarray, q: np.ndarray, v_uid: np.ndarray, v_id: np.ndarray, v: np.ndarray, top: int, bound: np.ndarray | None = None) -> tuple[list, list, list]:
    """Each query's best of some vectors, none below its bound, in exact double precision; ties to the smaller id."""
    queries, places, scores = [], [], []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ v.T
        k = min(top + 1, s.shape[1])  # one more: the query itself may be among them
        least = np.partition(s, -k, axis=1)[:, -k]
        if bound is not None:
            least = np.maximum(least, bound[at : at + 256])
        for i in range(len(s)):
            some = np.flatnonzero((s[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]))) & (v_uid != q_uid[at + i]))
            exact = (q[at + i] * v[some]).sum(1)
            order = np.lexsort((v_uid[some], v_id[some], -exact))[:top]
            queries += [q_uid[at + i]] * len(order)
            places += some[order].tolist()
            scores += exact[order].tolist()
    return queries, places, scores


_ROW = "uid long, id long, v binary"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(uid, id, size, v) of the vectors that take part, written once; v are the numbers' bytes."""
    v = F.col("v")
    ok = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(ok)

    @F.pandas_udf("binary")
    def packed(some: pd.Series) -> pd.Series:
        return some.map(lambda x: np.asarray(x, np.float64).tobytes())

    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.size("v").alias("size"), packed("v").alias("v"), F.array_max(F.transform("v", F.abs)).alias("most"))
    return materialize(rows, "vectors")


def _truth(rows: DataFrame, asked: pd.DataFrame, top: int) -> list[np.ndarray]:
    """The true neighbours of a few queries, by one pass over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((asked["uid"].to_numpy(), _matrix(asked["v"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uids, q = shared.value
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(held) > 8192:
                held = cut(uids, q, held)
        if held is not None:
            found, k, score = best(uids, q, held)
            yield pd.DataFrame({"query": found, "score": score, "uid": held["uid"].to_numpy()[k], "v": held["v"].to_numpy()[k]})

    def best(uids, q, held):
        found, k, score = _best(uids, q, held["uid"].to_numpy(), held["id"].to_numpy(), _matrix(held["v"]), top)
        return found, np.array(k, int), score

    def cut(uids, q, held):
        return held.iloc[np.unique(best(uids, q, held)[1])].reset_index(drop=True)

    found = rows.select("uid", "id", "v").mapInPandas(scan, "query long, score double, uid long, v binary")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "uid"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= top).toPandas()  # `top` rows for each of the few queries
    by = {q: _matrix(part["v"].tolist()) for q, part in found.groupby("query")}
    return [by.get(u, np.zeros((0, 1))) for u in asked["uid"]]


def nearest(vectors: DataFrame, top: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", part: int = PART, sample: int = SAMPLE, wanted: float = RECALL, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` largest inner products with each query.

    Queries are the rows whose id ``every`` divides.  Vectors that are null or
    zero, or hold null or non-finite numbers, and rows without an id, take no
    part.  Vectors of another length than a query's aren't its candidates; each
    length has an index of its own.  Rows that share an id, or are equal, are
    queries and candidates of their own.  ``told`` gets lists, replicas a vector
    and the share of lists that a query reads, of the last length.
    """
    rows = usable(vectors, id_column, vector_column)
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.max("most").alias("most")).orderBy("size").collect():
        found = found.unionByName(_nearest(rows.where(F.col("size") == r["size"]).select("uid", "id", "v"), r["n"], r["size"], r["most"], top, every, part, sample, wanted, {} if told is None else told))
    return found


def _nearest(rows: DataFrame, n: int, size: int, most: float, top: int, every: int, part: int, sample: int, wanted: float, told: dict) -> DataFrame:
    spark = rows.sparkSession

    # Distances are of vectors divided by the largest number, so that no square overflows.
    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"m": [((_matrix(b["v"].tolist()) / most) ** 2).sum(1).max()] if len(b) else []})

    longest = float(rows.select("v").mapInPandas(squares, "m double").agg(F.max("m")).first()[0])

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / most
        return np.column_stack([x, np.sqrt(np.maximum(0, longest - (x**2).sum(1)))])

    def flat(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / most, np.zeros(len(x))])

    lists = max(1, min(LISTS, n // max(LIST, int(np.sqrt(n)))))
    fitted = max(1, min(lists * sample, NUMBERS // size))
    points = rows.select("uid", "v").orderBy(F.xxhash64("uid"), "uid").limit(fitted + FURTHER).toPandas()
    points = lifted(_matrix(points["v"].tolist()))
    graph = fit_graph(points[:fitted], lists)
    # Vectors that the centroids were fitted on lie deeper in their lists than others.
    near = border(graph, points[fitted:] if len(points) > fitted else points)
    is_query = F.col("id") % every == 0
    few = rows.where(is_query).orderBy(F.xxhash64("uid", F.lit(1)), "uid").limit(ASKED).toPandas()
    ratio = calibrate(graph, flat(_matrix(few["v"].tolist())), [lifted(x) for x in _truth(rows, few, top)], near, wanted) if len(few) else 1.0
    shared = spark.sparkContext.broadcast(graph)

    def listed(reach: float, at_most: int | None, place, sizes: np.ndarray | None = None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 256):
                    block = b.iloc[at : at + 256]
                    x = place(_matrix(block["v"].tolist()))
                    lists = shared.value.within(x, reach, at_most)
                    if sizes is not None:
                        lists = [enough(shared.value, y, row, sizes) for y, row in zip(lists, x)]
                    counts = [len(y) for y in lists]
                    out = pd.DataFrame({"list": np.concatenate(lists).astype("int32"), "uid": np.repeat(block["uid"].to_numpy(), counts), "id": np.repeat(block["id"].to_numpy(), counts), "v": np.repeat(block["v"].to_numpy(), counts)})
                    yield out if sizes is None else out.assign(home=np.concatenate([np.arange(len(y)) < homes(y, sizes) for y in lists]))

        return run

    # A vector is in REPLICAS lists at most, so lists of so many rows hold `top` others.
    full = REPLICAS * (top + 1)

    def enough(graph: Graph, lists: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        # Lists stay nearest first.
        if sizes[lists].sum() >= full:
            return lists
        order = np.argsort(((graph.centroids - x) ** 2).sum(1), kind="stable")
        short = order[: np.searchsorted(sizes[order].cumsum(), full) + 1]
        return np.concatenate([lists, short[~np.isin(short, lists)]])

    def homes(lists: np.ndarray, sizes: np.ndarray) -> int:
        # With the root of their number both readings return about as many rows.
        return max(int(np.ceil(np.sqrt(len(lists)))), int(np.searchsorted(sizes[lists].cumsum(), full)) + 1)

    member = materialize(rows.mapInPandas(listed(near, REPLICAS, lifted), f"list int, {_ROW}"), "lists")
    sizes_of = np.zeros(len(graph.centroids), int)
    for r in member.groupBy("list").count().collect():  # as many rows as there are lists, at most LISTS
        sizes_of[r["list"]] = r["count"]
    asked = materialize(rows.where(is_query).mapInPandas(listed(ratio, None, flat, sizes_of), f"list int, {_ROW}, home boolean"), "asked")
    # As many rows as there are lists.
    held = member.groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    told.update(lists=len(graph.centroids), replicas=sizes_of.sum() / n, ratio=ratio, asked=asked)

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "uid": [], "id": [], "score": []})
        q, at, s = _best(a["uid"].to_numpy(), _matrix(a["v"].tolist()), b["uid"].to_numpy(), b["id"].to_numpy(), _matrix(b["v"].tolist()), top, a["bound"].to_numpy(float))
        return pd.DataFrame({"query": q, "uid": b["uid"].to_numpy()[at], "id": b["id"].to_numpy()[at], "score": s})

    def scored(some: DataFrame) -> DataFrame:
        wants = some.groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias("q_parts"))
        plan = F.broadcast(held.join(wants, "list"))
        left = some.join(plan, "list").select("list", F.pmod(F.xxhash64("uid"), F.col("q_parts")).cast("int").alias("q_part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "uid", "v", "bound")
        right = member.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_part"), F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"), "uid", "id", "v")
        keys = ["list", "q_part", "part"]
        return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(met, "query long, uid long, id long, score double")

    least = F.lit(float("-inf"))
    near_rows = materialize(scored(asked.where("home").withColumn("bound", least)).groupBy("query", "uid").agg(F.max("score").alias("score"), F.min("id").alias("id")), "near")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    bounds = near_rows.select("query", F.col("score").alias("bound"), place.alias("place")).where(F.col("place") == top).drop("place")
    rest = asked.where("not home").join(bounds, F.col("uid") == F.col("query"), "left").select("list", "uid", "v", F.coalesce("bound", least).alias("bound"))
    found = near_rows.unionByName(scored(materialize(rest, "rest")).groupBy("query", "uid").agg(F.max("score").alias("score"), F.min("id").alias("id"))).groupBy("query", "uid").agg(F.max("score").alias("score"), F.min("id").alias("id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "uid"))
    best = found.select("query", rank.alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= top)
    ids = rows.where(is_query).select(F.col("uid").alias("query"), F.col("id").alias("query_id"))
    return best.join(ids, "query").select("query_id", "rank", "vec_id", "score")


def op8_neighbours(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score: the 20 nearest found of every 20th vector."""
    return nearest(vectors)
