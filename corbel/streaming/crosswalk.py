"""The crosswalk kept up batch by batch: each append writes what it adds, and reading adds it up.

Below the folder, ``v<n>`` is what batch n added and ``c<n>`` what all batches
up to n added together.  Each has the labels' ``support``, their first mentions
of each condition with the drugs that they had then, and the ``chunks`` it
knows; chunks are written last, so a version without them isn't there, and a
batch that failed may run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corbel.operators.cut import discard, materialize
from corbel.operators.links import composed, drug_support, edge_support, merged_support
from corbel.streaming.tables import _folder


@dataclass
class CrosswalkStore:
    """Edges of drugs and conditions under ``path``, for any number of batches of mentions.

    A chunk comes whole, in one batch; a chunk that an earlier batch brought is
    left out, so a batch may come twice; mentions without a chunk count with
    every batch that brings them.  Of each edge ``examples`` examples are
    kept and ``labels`` labels are listed.  One writer at a time.
    """

    spark: SparkSession
    path: str
    examples: int = 5
    labels: int = 50

    def _versions(self, letter: str) -> list[int]:
        root, fs = _folder(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[:1] == letter and n[1:].isdigit() and fs.exists(_folder(self.spark, f"{self.path}/{n}/chunks/_SUCCESS")[0]))

    def _parts(self, before: int | None = None) -> list[str]:
        """The finished versions that together hold all batches, or those before one."""
        fits = lambda n: before is None or n < before
        base = [n for n in self._versions("c") if fits(n)][-1:]
        return [f"c{n}" for n in base] + [f"v{n}" for n in self._versions("v") if fits(n) and (not base or n > base[0])]

    def _each(self, parts: list[str], table: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{p}/{table}" for p in parts])

    def append(self, mentions: DataFrame, resolved: DataFrame, batch: int | None = None, min_conf: float = 0.0) -> None:
        """Add a batch of mentions; without a number it is the next one.  A number at or below that of a compacted batch has been added."""
        base = self._versions("c")[-1:]
        batch = max([*base, *self._versions("v"), -1]) + 1 if batch is None else batch
        if base and batch <= base[0]:
            return
        own = f"{self.path}/v{batch}"
        chunks = materialize(mentions.select("chunk_id").where("chunk_id is not null").distinct(), "chunks")
        fresh = mentions
        if parts := self._parts(batch):
            # Few chunks of a batch are known; the many known ones are scanned, not shuffled, if the batch is small.
            known = self._each(parts, "chunks").join(chunks, "chunk_id", "left_semi")
            fresh = materialize(mentions.where(F.col("confidence") >= min_conf).join(known, "chunk_id", "left_anti"), "mentions")
        drug_support(fresh, resolved, min_conf, self.examples).write.mode("overwrite").parquet(f"{own}/support")
        chunks.write.mode("overwrite").parquet(f"{own}/chunks")
        discard(chunks)
        if parts:
            discard(fresh)

    def compact(self) -> None:
        """Add all batches up in one version; those it holds are deleted after it is written."""
        parts, versions = self._parts(), self._versions("v")
        if len(parts) < 2:
            return
        own = f"{self.path}/c{versions[-1]}"
        merged_support(self._each(parts, "support"), ["spl_set_id", "snomed_id", "link_type", "drugs"], self.examples).write.mode("overwrite").parquet(f"{own}/support")
        self._each(parts, "chunks").distinct().write.mode("overwrite").parquet(f"{own}/chunks")
        for p in parts:
            place, fs = _folder(self.spark, f"{self.path}/{p}")
            fs.delete(place, True)

    def edges(self, run_ts: str) -> DataFrame:
        """What ``rollup`` gives for the mentions of all batches.  A store without a batch is an error."""
        parts = self._parts()
        if not parts:
            raise ValueError(f"no batch has been added to {self.path}")
        return composed(edge_support(self._each(parts, "support")), run_ts, self.labels, self.examples)


def keep_crosswalk(mentions: DataFrame, resolved: DataFrame, store: CrosswalkStore, checkpoint: str, min_conf: float = 0.0, **trigger) -> StreamingQuery:
    """Add a stream of mentions to a store, a batch at a time; a batch that runs again replaces itself."""
    add = lambda batch, number: store.append(batch, resolved, number, min_conf)
    return mentions.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
