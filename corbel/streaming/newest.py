"""Newest row of each key as keyed state: a batch costs what it brings, not what is kept."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from corbel.operators.ordered import top_rows

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_KEY, _DATE, _ORDER, _HASH = "__key", "__date", "__order", "__hash"


def _ranked(events: DataFrame, keys: list[str], date: str, order: str) -> DataFrame:
    """``events`` with their key as text and what they are compared by: the digits of a date, an order, a hash."""
    digits = F.regexp_replace(F.coalesce(F.col(date).cast("string"), F.lit("")), r"\D", "")
    named = F.struct(*[F.col(k).cast("string").alias(f"k{n}") for n, k in enumerate(keys)])
    return events.withColumns({_KEY: F.to_json(named), _DATE: digits, _ORDER: F.col(order), _HASH: F.xxhash64(*events.columns)})


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the newest row of each key, so that a key with many rows is not shuffled whole."""
    for b in batches:
        if b.num_rows:
            at = pc.sort_indices(b, sort_keys=[(_KEY, "ascending"), (_DATE, "descending"), (_ORDER, "descending"), (_HASH, "descending")], null_placement="at_end")
            keys = b.column(_KEY).take(at)
            first = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))
            at = at.filter(pa.concat_arrays([pa.array([True]), first]))
            yield b.take(at)


class _Newest(StatefulProcessor):
    """Holds one row for each key; what is no newer than it changes nothing."""

    def __init__(self, schema: StructType, ttl: int | None, quiet: int | None):
        self.schema, self.ttl, self.quiet = schema, ttl, quiet
        self.names = schema.names
        self.by = [self.names.index(c) for c in (_DATE, _ORDER, _HASH)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema, self.ttl)

    def _rank(self, row: tuple) -> tuple:
        date, order, mark = (row[k] for k in self.by)
        return date, order is not None, order, mark

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.best.get()
        new = max((tuple(r) for r in rows), key=self._rank)
        if old is not None and self._rank(tuple(old)) >= self._rank(new):
            return
        self.best.update(new)
        if self.quiet is None:
            yield Row(*self.names)(*new)
        else:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (found := self.best.get()) is not None:
            yield Row(*self.names)(*found)

    def close(self) -> None:
        pass


def newest_changes(events: DataFrame, keys: list[str], date: str, order: str, ttl: int | None = None, quiet: int | None = None) -> DataFrame:
    """A stream of the rows that became the newest of their keys.

    Newer is what has the larger digits of ``date``, then the larger ``order``
    (a scalar; null is least), then the larger hash of the row, so neither the
    order of rows nor their batches matter.  Null keys are keys.  With ``quiet``
    a row comes only when its key had no newer one for so many milliseconds;
    with ``ttl`` a key that had none for so many milliseconds is forgotten, and
    whatever comes next for it counts as new.
    """
    ranked = _ranked(events, keys, date, order)
    thin = ranked.mapInArrow(_thinned, ranked.schema)
    timed = ttl is not None or quiet is not None
    out = thin.groupBy(_KEY).transformWithState(_Newest(ranked.schema, ttl, quiet), ranked.schema, "Update", "ProcessingTime" if timed else "None")
    return out.drop(_KEY, _DATE, _ORDER, _HASH)


def log_newest(events: DataFrame, path: str, keys: list[str], date: str, order: str, checkpoint: str, ttl: int | None = None, quiet: int | None = None, **trigger) -> StreamingQuery:
    """Write the changes of each batch below ``path``; a batch that runs again replaces its own.

    State lies in RocksDB; ``newest_table`` reads what is kept.
    """
    changes = newest_changes(events, keys, date, order, ttl, quiet)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # a query keeps what is set when it starts
    try:
        return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def newest_table(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The newest row of each key by the changes that ``log_newest`` wrote: the last one of each."""
    log = spark.read.schema(StructType(schema.fields)).option("basePath", path).parquet(f"{path}/batch=*")
    log = log.withColumn("__batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long"))
    return top_rows(log, keys, [F.desc("__batch")]).drop("__batch")
