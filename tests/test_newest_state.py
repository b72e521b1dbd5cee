"""Newest rows kept as state equal those of the whole table."""

import random
import time

from pyspark.sql import functions as F

from corbel.operators.ordered import newest_rows
from corbel.streaming.newest import log_newest, newest_table

SCHEMA = "k string, k2 int, day string, n long, value double, at timestamp, extra array<int>"


def _batch(spark, r, rows, path):
    made = [(r.choice(["a", "b", "hot", "hot", "hot", None]), r.choice([1, 2, None]), r.choice(["2024-01-02", "20240103", "2024-01-04", None]), n, r.choice([None, float("nan"), 1.5]), None, r.choice([None, [], [n]])) for n in rows]
    spark.createDataFrame(made, SCHEMA).withColumn("at", F.lit("2024-01-01 00:00:00.123456").cast("timestamp")).coalesce(2).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _rows(df):
    return sorted(repr(tuple(x)) for x in df.select("k", "k2", "day", "n", "value", "at", "extra").collect())


def test_equal_after_batches_out_of_order_and_a_restart(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    r = random.Random(11)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for rows in ([range(100, 200), range(0, 100)], [range(300, 350), range(200, 300)]):
        for part in rows:
            _batch(spark, r, part, src)
        q = log_newest(_stream(spark, src), out, ["k", "k2"], "day", "n", check)
        q.awaitTermination(120)
        assert q.exception() is None
        every = spark.read.schema(SCHEMA).parquet(src)
        assert _rows(newest_table(spark, out, every.schema, ["k", "k2"])) == _rows(newest_rows(every, ["k", "k2"], "day", "n"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    # Only changes are written.
    assert spark.read.parquet(out).count() < 350 / 2


def test_quiet_keys_and_forgotten_ones(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _batch(spark, random.Random(12), range(60), src)
    q = log_newest(_stream(spark, src), out, ["k", "k2"], "day", "n", str(tmp_path / "c"), ttl=3_600_000, quiet=500, processingTime="200 milliseconds")
    every = spark.read.schema(SCHEMA).parquet(src)
    want = _rows(newest_rows(every, ["k", "k2"], "day", "n"))
    try:
        end = time.time() + 60
        while time.time() < end and q.exception() is None:
            try:
                if _rows(newest_table(spark, out, every.schema, ["k", "k2"])) == want:
                    break
            except Exception:  # nothing written yet
                pass
            time.sleep(0.5)
        assert _rows(newest_table(spark, out, every.schema, ["k", "k2"])) == want
        assert len(spark.read.parquet(out).collect()) == len(want)
    finally:
        q.stop()
