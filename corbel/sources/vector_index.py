"""A vector index on disk: shards of lists in Parquet, a manifest, and rows by ordinal.

Below the index's folder lie ``centroids``, one folder of ``shards`` for each
save or append, and ``manifest``, which names the shards that count.  A shard
has its vectors by list (``rows``), its metadata in the order of the ids
(``meta``) and what each list holds (``lists``).  An append writes its shard
first and its manifest entry last, so a shard whose writer was lost is never
read, and two writers that race end with an error for the later one.

A row's place ``at`` is its file's number and its number therein; the manifest
has where each file's ordinals begin, so a row is found by the row groups'
least and greatest places.  Searches are exact: a list is left out only when
its radius says that nothing in it can be among a query's best.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators.ordered import top_rows
from corbel.operators.vectors import every_block, query_blocks

#: Lists of an index at most, rows of a list on the average, and rows for each list in the sample that centroids are fitted on.
LISTS, LIST, SAMPLE = 1024, 1000, 64
#: Rows by ordinal that are asked of the files one by one; more are joined.
LOOKUPS = 200
#: Scores that a search holds at once in a task.
SCORES = 1 << 18
_FILE = 1 << 33


def _centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Means of the sample's rows, started from rows far from each other."""
    found = [sample[0]]
    least = ((sample - found[0]) ** 2).sum(1)
    while len(found) < lists and least.max() > 0:
        found.append(sample[least.argmax()])
        least = np.minimum(least, ((sample - found[-1]) ** 2).sum(1))
    c = np.array(found)
    for _ in range(rounds):
        near = _nearest(sample, c)[0]
        for k in np.unique(near):
            c[k] = sample[near == k].mean(0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in vectors])


@dataclass
class VectorIndex:
    """An index that ``create`` wrote or ``load`` opened; ``append`` gives the index with the new shard."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    shards: list[dict] = field(default_factory=list)

    # --- writing

    @classmethod
    def create(cls, rows: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """Write ``rows`` (row_id, vec and any metadata) as a new index.

        Rows whose vector is null, of another length than the first ones' or
        not finite have metadata and an ordinal, but no search finds them.
        Repeated ids are rows of their own.  Centroids are fitted on a bounded
        sample, the rows whose ids hash lowest.
        """
        n = rows.count()
        lists = max(1, min(LISTS, lists or -(-n // LIST)))
        usable = rows.where(_finite("vec"))
        sample = usable.select("vec", F.xxhash64(F.col("row_id").cast("string")).alias("h")).orderBy("h", "vec").limit(SAMPLE * lists).collect()
        wide = len(sample[0]["vec"]) if sample else 0
        c = _centroids(np.array([r["vec"] for r in sample if len(r["vec"]) == wide], float), lists) if wide else np.zeros((1, 1))
        table = rows.sparkSession.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "list int, centroid array<double>")
        table.coalesce(1).write.mode("error").parquet(f"{path}/centroids")
        return cls(rows.sparkSession, path, c).append(rows)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        """Open an index as its manifest has it now."""
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        entries = spark.read.schema("entry string, version int").parquet(f"{path}/manifest").orderBy("version").collect()
        return cls(spark, path, np.array([r["centroid"] for r in found], float), [json.loads(r["entry"]) for r in entries])

    def append(self, rows: DataFrame) -> VectorIndex:
        """Add rows as a new shard; their ordinals follow those of the shards before, in the order of their ids."""
        shard = uuid.uuid4().hex
        base = f"{self.path}/shards/{shard}"
        extra = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns if c not in ("row_id", "vec")]
        packed = rows.select("row_id", "vec", (F.struct(*extra) if extra else F.lit(None).cast("string")).alias("row"))
        placed = packed.repartitionByRange("row_id").sortWithinPartitions("row_id", F.xxhash64("vec")).withColumn("at", F.monotonically_increasing_id())
        placed.write.parquet(f"{base}/meta")
        meta = self.spark.read.parquet(f"{base}/meta")
        files = [(r["file"], r["n"]) for r in meta.groupBy((F.col("at") / _FILE).cast("long").alias("file")).agg(F.count("*").alias("n")).orderBy("file").collect()]
        usable = meta.where(_finite("vec") & (F.size("vec") == self.centroids.shape[1])).select("at", "row_id", "vec")
        kind = usable.schema
        listed = usable.mapInPandas(self._assign(), f"at long, row_id {kind['row_id'].dataType.simpleString()}, vec {kind['vec'].dataType.simpleString()}, list int, far double")
        listed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{base}/rows")
        if not usable.isEmpty():
            held = self.spark.read.parquet(f"{base}/rows").groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
            held.coalesce(1).write.parquet(f"{base}/lists")
        entry = {"shard": shard, "start": self.rows, "rows": sum(n for _, n in files), "files": files, "searched": not usable.isEmpty()}
        self.spark.createDataFrame([(json.dumps(entry),)], "entry string").coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={len(self.shards)}")
        return VectorIndex(self.spark, self.path, self.centroids, [*self.shards, entry])

    def _assign(self):
        c = self.centroids

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near, far = _nearest(_matrix(b["vec"]), c)
                    yield b.assign(list=near.astype(np.int32), far=far)

        return run

    # --- reading

    @property
    def rows(self) -> int:
        return sum(e["rows"] for e in self.shards)

    def _each(self, part: str) -> DataFrame | None:
        """One of the shards' tables, all shards together, with ``shard``, their number."""
        out = None
        for k, e in enumerate(self.shards):
            if part == "meta" or e["searched"]:
                one = self.spark.read.parquet(f"{self.path}/shards/{e['shard']}/{part}").withColumn("shard", F.lit(k))
                out = one if out is None else out.unionByName(one)
        return out

    def _ordinal(self) -> Column:
        """The ordinal of a row of (shard, at)."""
        starts = [(F.lit(f"{k}/{f}"), F.lit(s).cast("long")) for k, f, s in self._starts()]
        if not starts:
            return F.lit(None).cast("long")
        place = F.concat_ws("/", "shard", F.shiftright("at", 33).cast("string"))
        return F.create_map(*[x for pair in starts for x in pair])[place] + F.col("at").bitwiseAND(_FILE - 1)

    def _starts(self) -> list[tuple[int, int, int]]:
        """(shard, file, first ordinal) of every file."""
        out = []
        for k, e in enumerate(self.shards):
            at = e["start"]
            for f, n in e["files"]:
                out.append((k, f, at))
                at += n
        return out

    def table(self) -> DataFrame:
        """(ordinal, row_id, vec, row) of all rows, ``row`` being the metadata; None for an index without shards."""
        return self._each("meta").select(self._ordinal().alias("ordinal"), "row_id", "vec", "row")

    def rows_at(self, wanted: DataFrame) -> DataFrame:
        """(ordinal, row_id, vec, row) for each distinct ordinal of ``wanted``; those out of range give none.

        Few ordinals become filters on places, which row groups are skipped by.
        """
        asked = wanted.select(F.col("ordinal").cast("long").alias("ordinal")).where("ordinal is not null").distinct()
        few = [r["ordinal"] for r in asked.limit(LOOKUPS + 1).collect()]
        if len(few) > LOOKUPS:
            return self.table().join(asked, "ordinal")
        starts = self._starts()
        firsts = np.array([s for _, _, s in starts], np.int64)
        out = None
        by_shard: dict[int, list[int]] = {}
        for o in few:
            if 0 <= o < self.rows:
                k, f, s = starts[int(np.searchsorted(firsts, o, "right")) - 1]
                by_shard.setdefault(k, []).append(f * _FILE + o - s)
        for k, places in sorted(by_shard.items()):
            hit = F.lit(False)
            for at in sorted(places):
                hit = hit | (F.col("at") == at)
            one = self.spark.read.parquet(f"{self.path}/shards/{self.shards[k]['shard']}/meta").where(hit).withColumn("shard", F.lit(k))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.table().where("false")
        return out.select(self._ordinal().alias("ordinal"), "row_id", "vec", "row")

    def search(self, queries: DataFrame, top: int = 5, metric: str = "ip") -> DataFrame:
        """query_id, row_id, ordinal, rank and score: exact neighbours, as ``vectors.search`` over all rows gives them.

        ``queries`` has query_id and qvec; they go to every task in bounded
        blocks.  A query first reads the lists that promise most, until these
        hold ``top`` rows; its best so far then say which others it must read.
        """
        found = every_block([self._search_block(block, top, metric) for block in query_blocks(queries)])
        order = F.desc("score") if metric == "ip" else F.asc("score")
        ranked = top_rows(found, ["query_id"], [order, F.asc("row_id"), F.asc("shard"), F.asc("at")], top, "rank")
        return ranked.select("query_id", "row_id", self._ordinal().alias("ordinal"), "rank", "score")

    def _search_block(self, queries: DataFrame, top: int, metric: str) -> DataFrame:
        asked = queries.where(_finite("qvec") & (F.size("qvec") == self.centroids.shape[1])).collect()
        rows, lists = self._each("rows"), self._each("lists")
        kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["row_id"].dataType.simpleString() if rows else "long"
        schema = f"query_id {kinds[0]}, row_id {kinds[1]}, shard int, at long, score double"
        if not asked or rows is None:
            return self.spark.createDataFrame([], schema)
        q = np.array([r["qvec"] for r in asked], float)
        ids = [r["query_id"] for r in asked]
        held = lists.groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).orderBy("list").collect()
        number, n, radius = (np.array([r[k] for r in held], t) for k, t in (("list", int), ("n", float), ("radius", float)))
        c, size = self.centroids[number], np.sqrt((q**2).sum(1))
        if metric == "ip":
            most = q @ c.T + size[:, None] * radius
        else:
            away = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (c**2).sum(1) - 2 * q @ c.T, 0))
            most = -(np.maximum(away - radius, 0) ** 2)
        # Room for rounding, in the bounds and in the scores that are held against them.
        most = most + 1e-9 * (1 + size[:, None] + np.sqrt((c**2).sum(1)) + radius) ** 2
        order = np.argsort(-most, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(most.shape, bool)
        np.put_along_axis(first, order, before < top, 1)
        one = self._scan(rows, q, ids, first, number, top, metric, schema)
        sign = 1 if metric == "ip" else -1
        ranked = top_rows(one.withColumn("s", F.col("score") * sign), ["query_id"], [F.desc("s"), F.asc("row_id")], top, "k")
        least = {r["query_id"]: r["least"] for r in ranked.groupBy("query_id").agg(F.min("s").alias("least"), F.count("*").alias("n")).where(F.col("n") >= top).collect()}
        rest = (most >= np.array([least.get(i, -np.inf) for i in ids])[:, None]) & ~first
        return one.unionByName(self._scan(rows, q, ids, rest, number, top, metric, schema)) if rest.any() else one

    def _scan(self, rows: DataFrame, q: np.ndarray, ids: list, asked: np.ndarray, number: np.ndarray, top: int, metric: str, schema: str) -> DataFrame:
        """Each task's best rows of every query, among the lists that it asks for."""
        wanted = {int(k): np.flatnonzero(asked[:, j]) for j, k in enumerate(number) if asked[:, j].any()}
        shared = self.spark.sparkContext.broadcast((q, ids, wanted))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, ids, wanted = shared.value
            least, best = np.full(len(q), -np.inf), pd.DataFrame({"k": [], "row_id": [], "shard": [], "at": [], "s": []})
            for b in batches:
                new = [best]
                for k, part in b.groupby("list", sort=False):
                    of = wanted[int(k)]
                    # A bounded number of scores at a time, of which only each query's best go on.
                    step = max(1, SCORES // len(of))
                    for at in range(0, len(part), step):
                        some = part.iloc[at : at + step]
                        v = _matrix(some["vec"])
                        near = q[of] @ v.T if metric == "ip" else 2 * q[of] @ v.T - (q[of] ** 2).sum(1)[:, None] - (v**2).sum(1)
                        floor = least[of] if len(v) <= top else np.maximum(least[of], np.partition(near, -top, axis=1)[:, -top])
                        i, j = np.nonzero(near >= (floor - 1e-9 * (1 + np.abs(near).max()))[:, None])
                        exact = (q[of[i]] * v[j]).sum(1) if metric == "ip" else -((q[of[i]] - v[j]) ** 2).sum(1)
                        hit = some.iloc[j]
                        new.append(pd.DataFrame({"k": of[i], "row_id": hit["row_id"].to_numpy(), "shard": hit["shard"].to_numpy(), "at": hit["at"].to_numpy(), "s": exact}))
                best = pd.concat([x for x in new if len(x)] or [best]).sort_values(["k", "s", "row_id", "shard", "at"], ascending=[True, False, True, True, True]).groupby("k").head(top)
                full = best.groupby("k")["s"].agg(["min", "size"])
                full = full[full["size"] >= top]
                least[full.index.to_numpy(int)] = full["min"].to_numpy()
            if len(best):
                yield pd.DataFrame({"query_id": [ids[int(k)] for k in best["k"]], "row_id": best["row_id"].to_numpy(), "shard": best["shard"].to_numpy(int), "at": best["at"].to_numpy(np.int64), "score": best["s"].to_numpy() * (1 if metric == "ip" else -1)})

        return rows.where(F.col("list").isin(list(wanted))).select("row_id", "shard", "at", "vec", "list").mapInPandas(run, schema)


def _finite(column: str) -> Column:
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(whole, F.lit(False))
