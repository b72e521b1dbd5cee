"""Structured Streaming forms of operators that need no whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corbel.operators.ordered import newest_rows


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events and their sum per key and window; rows later than ``late`` are dropped."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(span.alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events", "total")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key, ended by a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once, as long as its repetition comes within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _folder(spark: SparkSession, path: str):
    """A folder and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished versions of a table of ``keep_newest``, ascending."""
    root, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


def keep_newest(events: DataFrame, path: str, keys: list[str], date: str, order: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the newest row of each key in a table at ``path``; each batch replaces it as a whole, in a version of its own.

    The version that a batch starts from stays until the next batch, so that a
    batch that fails may run again; older ones are deleted.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [v for v in versions(spark, path) if v < batch_id]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{done[-1]}")) if done else batch
        newest_rows(rows, keys, date, order).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        for v in done[:-1]:
            old, fs = _folder(spark, f"{path}/v{v}")
            fs.delete(old, True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
