"""The index on disk against exact search over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from corbel.operators import vectors
from corbel.sources.vector_index import VectorIndex

SCHEMA = "row_id long, vec array<float>, title string, at int, list int"


def some(n, seed, first=0, clusters=12, dims=8):
    r = random.Random(seed)
    centres = [[random.Random(c).gauss(0, 3) for _ in range(dims)] for c in range(clusters)]
    return [(first + k, [x + r.gauss(0, 0.2) for x in r.choice(centres)], f"t{first + k}", 1, 2) for k in range(n)]


@pytest.fixture(scope="module")
def parts(spark):
    a, b, c = some(400, 1), some(150, 2, 400), some(30, 3, 550)
    a[7] = (7, None, "none", 1, 2)
    a[8] = (8, [float("nan")] * 8, "nan", 1, 2)
    a[9] = (9, [1.0, 2.0], "short", 1, 2)
    b += [(3, a[3][1], "again", 1, 2), (3, a[3][1], "again", 1, 2), (700, a[5][1], "tie", 1, 2)]
    return [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (a, b, c)]


@pytest.fixture(scope="module")
def index(spark, parts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "one")
    VectorIndex.create(parts[0], path, lists=10).append(parts[1]).append(parts[2])
    return VectorIndex.load(spark, path)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["row_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_loaded_index_equals_exact_search(spark, index, parts, metric, tmp_path):
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    usable = every.where("vec is not null and size(vec) = 8 and not isnan(vec[0])")
    asked = usable.where("row_id % 9 = 0").select(F.col("row_id").alias("query_id"), F.col("vec").alias("qvec"))
    want = rows_of(vectors.search(asked, usable, 6, metric))
    assert rows_of(index.search(asked, 6, metric)) == want and len(want) > 300
    fresh = VectorIndex.create(every, str(tmp_path / "fresh"))
    assert rows_of(fresh.search(asked, 6, metric)) == want


def test_lists_that_hold_nothing_near_are_not_read(spark, index, parts):
    asked = parts[0].where("row_id = 5").select(F.col("row_id").alias("query_id"), F.col("vec").alias("qvec"))
    plan = index.search(asked, 3, "l2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan
    read = index.search(asked, 3, "l2")
    assert read.where("rank = 1").first()["row_id"] in (5, 700)


def test_rows_by_ordinal(spark, index):
    table = index.table()
    rows = {r["ordinal"]: (r["row_id"], r["row"]["title"]) for r in table.collect()}
    assert sorted(rows) == list(range(583)) and index.rows == 583
    assert [rows[k][0] for k in range(400)] == list(range(400)) and [rows[k] for k in (400, 401)] == [(3, "again")] * 2
    wanted = spark.createDataFrame([(0,), (399,), (400,), (582,), (582,), (583,), (-1,), (None,)], "ordinal int")
    found = index.rows_at(wanted)
    assert {r["ordinal"]: (r["row_id"], r["row"]["title"]) for r in found.collect()} == {k: rows[k] for k in (0, 399, 400, 582)} and found.count() == 4
    assert "PushedFilters: [" in found._jdf.queryExecution().toString() and "EqualTo(at," in found._jdf.queryExecution().toString()
    many = spark.range(0, 600, 2).select(F.col("id").alias("ordinal"))
    assert {r["ordinal"] for r in index.rows_at(many).collect()} == set(range(0, 583, 2))
    assert index.rows_at(wanted.where("ordinal < 0")).count() == 0
    hits = index.search(table.where("row_id = 12").select(F.col("row_id").alias("query_id"), F.col("vec").alias("qvec")), 3)
    named = {r["ordinal"]: r["row"]["title"] for r in index.rows_at(hits).collect()}
    assert {rows[o][1] for o in named} == set(named.values()) and len(named) == 3


def test_lost_and_racing_writers(spark, parts, tmp_path):
    path = str(tmp_path / "index")
    index = VectorIndex.create(parts[2], path)
    spark.range(3).write.parquet(f"{path}/shards/lost/rows")  # a writer that ended before its manifest entry
    assert VectorIndex.load(spark, path).rows == 30
    index.append(parts[2])
    with pytest.raises(Exception, match="exist"):
        index.append(parts[2])
    assert VectorIndex.load(spark, path).rows == 60
    with pytest.raises(Exception, match="exist"):
        VectorIndex.create(parts[2], path)


def test_empty_indexes(spark, parts, tmp_path):
    none = VectorIndex.create(parts[0].limit(0), str(tmp_path / "none"))
    asked = parts[2].select(F.col("row_id").alias("query_id"), F.col("vec").alias("qvec"))
    assert none.search(asked).count() == 0 and none.table().count() == 0 and none.rows == 0
    bare = VectorIndex.create(parts[2].select("row_id", "vec"), str(tmp_path / "bare"))
    assert bare.search(asked.limit(0)).count() == 0 and bare.search(asked.select("query_id", F.lit(None).cast("array<float>").alias("qvec"))).count() == 0
    assert bare.rows_at(spark.range(2).select(F.col("id").alias("ordinal"))).where("row is null").count() == 2
