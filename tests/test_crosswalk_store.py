"""The crosswalk by batches is the roll-up of all mentions at once."""

import random

import pytest
from pyspark.sql import functions as F

from corbel.operators.links import EDGE, crosswalk, rollup
from corbel.streaming.crosswalk import CrosswalkStore, keep_crosswalk

TS = "2024-01-01"
MENTION = "chunk_id string, spl_set_id string, snomed_id string, link_type string, section string, confidence double, match_text string, qualifiers struct<negated:boolean>, ord int"


def _mentions(n=400):
    draw, rows = random.Random(2), []
    for k in range(n):
        label = draw.randrange(30)
        rows.append((f"c{label}-{k // 4}", f"s{label}", draw.choice(["1", "2", "3", None]), draw.choice(["indication", "warning"]), draw.choice(["a", "b"]), round(draw.random(), 2), "m", (draw.choice([True, False, None]),), k))
    return rows


def _resolved(spark):
    one = lambda x: (x, "SCD", True, "spl_set_id", 165)
    kind = "struct<rxcui:string,tty:string,has_ndc:boolean,via:string,score:int>"
    return spark.createDataFrame([(f"s{k}", one(f"r{k % 3}"), [one("x")]) for k in range(30)], f"spl_set_id string, primary {kind}, secondary array<{kind}>")


def _same(got, want):
    rows = lambda df: sorted((str(r) for r in df.select(sorted(df.columns)).collect()))
    assert rows(got) == rows(want)


def test_batches_repeats_and_compaction(spark, tmp_path):
    every, resolved = spark.createDataFrame(_mentions(), MENTION), _resolved(spark)
    want = rollup(crosswalk(every, resolved, 0.2), TS, labels=4, examples=3)
    store = CrosswalkStore(spark, str(tmp_path / "s"), examples=3, labels=4)
    with pytest.raises(ValueError):
        store.edges(TS)
    part = lambda k: every.where(F.pmod(F.crc32("chunk_id"), F.lit(3)) == k)
    for k in (2, 0):
        store.append(part(k), resolved, min_conf=0.2)
    store.compact()
    store.append(part(0).unionByName(part(1)), resolved, min_conf=0.2)
    store.append(every.limit(0), resolved)
    store.append(part(0), resolved, batch=1)  # was added before the compaction
    _same(CrosswalkStore(spark, str(tmp_path / "s"), 3, 4).edges(TS), want)
    store.compact()
    _same(store.edges(TS), want)
    assert {r["rxcui"] for r in store.edges(TS).select(EDGE).collect()} == {"r0", "r1", "r2", "x"}


def test_lost_batch_runs_again(spark, tmp_path):
    every, resolved = spark.createDataFrame(_mentions(80), MENTION), _resolved(spark)
    store = CrosswalkStore(spark, str(tmp_path / "s"))
    store.append(every, resolved)
    # A writer that was lost before its chunks leaves a version that doesn't count.
    every.limit(3).write.parquet(str(tmp_path / "s" / "v1" / "support"))
    assert store._versions("v") == [0]
    store.append(every.limit(0), resolved, batch=1)
    _same(store.edges(TS), rollup(crosswalk(every, resolved), TS))


def test_stream(spark, tmp_path):
    rows, resolved = _mentions(120), _resolved(spark)
    every = spark.createDataFrame(rows, MENTION)
    for k in range(3):
        every.where(F.pmod(F.crc32("chunk_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = CrosswalkStore(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema(MENTION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        keep_crosswalk(stream, resolved, store, str(tmp_path / "c")).awaitTermination(120)
    assert store._versions("v") == [0, 1, 2]
    _same(store.edges(TS), rollup(crosswalk(every, resolved), TS))


def test_roll_up_shuffles_once_by_edge(spark):
    """Labels' rows are shuffled by label and once by edge; chunks of several labels are still told apart."""
    every, resolved = spark.createDataFrame(_mentions(), MENTION), _resolved(spark)
    plan = rollup(crosswalk(every, resolved), TS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("Join") == 1
    shared = spark.createDataFrame([("c", f"s{k}", "1", "t", "a", 0.9, "m", (True,), -k) for k in range(6)], MENTION)
    got = [(r["rxcui"], r["spl_set_id"]) for r in crosswalk(shared, resolved).orderBy("rxcui").collect()]
    assert got == [("r0", "s3"), ("r1", "s4"), ("r2", "s5"), ("x", "s5")]


def _by_hand(mentions, drugs, labels, examples):
    """The roll-up of mentions by loops, ``drugs`` being those of each label in their order."""
    rows = sorted((m[8], pos, m[1], m[4], m[0], d, m[2], m[3], m[5], m[7][0]) for m in mentions for pos, d in enumerate(drugs[m[1]]))
    seen, edges = set(), {}
    for o, _, label, section, chunk, *edge, confidence, negated in rows:
        if (key := (chunk, *edge)) not in seen:
            seen.add(key)
            edges.setdefault(tuple(edge), []).append((label, section, confidence, negated))
    return {e: (sorted({r[1] for r in x}), sorted({r[0] for r in x})[:labels], len({r[0] for r in x}), len(x), max(r[2] for r in x), [(r[0], r[1], r[3]) for r in x[:examples]]) for e, x in edges.items()}


@pytest.mark.parametrize("shared, twice", [(False, False), (True, False), (False, True)])
def test_support_is_kept_once_for_all_drugs(spark, tmp_path, shared, twice):
    """Labels with many mentions of a kind, a drug that comes twice, chunks of several labels, labels that are resolved twice."""
    draw = random.Random(5)
    rows = []
    for k in range(300):
        label = draw.randrange(5)
        rows.append((f"c{k // 6 % 50}" if shared else f"c{label}-{k // 2}", f"s{label}", draw.choice("12"), "warning", draw.choice("abcdefgh"), round(draw.random(), 2), "m", (draw.choice([True, False]),), k))
    every = spark.createDataFrame(rows, MENTION)
    drugs = {f"s{k}": [f"r{k % 2}", "x", "x", f"y{k}", f"z{k}"] for k in range(5)}
    one = lambda x: (x, "SCD", True, "spl_set_id", 165)
    kind = "struct<rxcui:string,tty:string,has_ndc:boolean,via:string,score:int>"
    resolved = spark.createDataFrame([(s, one(d[0]), [one(x) for x in [*d[1:], None]]) for s, d in drugs.items()] * (1 + twice), f"spl_set_id string, primary {kind}, secondary array<{kind}>")
    store = CrosswalkStore(spark, str(tmp_path / "s"), examples=2, labels=3)
    part = lambda k: every.where(F.pmod(F.crc32("chunk_id"), F.lit(2)) == k)
    for k in range(2):
        store.append(part(k), resolved)
    want = _by_hand(rows, drugs, 3, 2)
    for compacted in range(2):
        got = {tuple(r[k] for k in EDGE): (r["sections"], r["spl_set_ids"], r["spl_count"], r["chunk_count"], r["max_confidence"], [(e["spl_set_id"], e["section"], e["negated"]) for e in r["examples"]]) for r in store.edges(TS).collect()}
        assert got == want
        if not shared and not twice:
            kept = spark.read.parquet(str(tmp_path / "s" / ("c1" if compacted else "v[01]") / "support"))
            # Five labels, two conditions, two mentions of each; drugs don't multiply them.
            assert kept.count() == 5 * 2 * 2 * (1 if compacted else 2)
        store.compact()
    assert "ObjectHashAggregate" not in store.edges(TS)._jdf.queryExecution().executedPlan().toString()
