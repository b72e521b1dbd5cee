"""Streaming forms give what the batch forms give."""

from corbel.streaming.tables import first_seen, keep_newest, versions, windowed_counts


def _stream(spark, path):
    return spark.readStream.schema("k string, event_type string, value double, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(path)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    for k, rows in enumerate([[("a", "x", 1.0, "2024-01-01 00:10:00", 1), ("b", "x", 2.0, "2024-01-01 00:20:00", 2)], [("a", "x", 3.0, "2024-01-01 00:30:00", 3), ("a", "y", 4.0, "2024-01-01 05:00:00", 4)]]):
        spark.createDataFrame(rows, "k string, event_type string, value double, ts string, n int").selectExpr("k", "event_type", "value", "cast(ts as timestamp) ts", "n").coalesce(1).write.mode("append").parquet(src)
    q = keep_newest(_stream(spark, src), str(tmp_path / "t"), ["k"], "n", "n", str(tmp_path / "c"))
    q.awaitTermination(60)
    last = sorted(p.name for p in (tmp_path / "t").iterdir())[-1]
    assert {r["k"]: r["n"] for r in spark.read.parquet(str(tmp_path / "t" / last)).collect()} == {"a": 4, "b": 2}
    assert versions(spark, str(tmp_path / "t")) == [0, 1] and versions(spark, str(tmp_path / "none")) == []
    q = windowed_counts(_stream(spark, src)).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select max(events) from counts where event_type = 'x'").first()[0] == 3
    q = first_seen(_stream(spark, src), ["k"]).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select count(*) from firsts").first()[0] == 2
