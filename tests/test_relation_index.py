"""The relation index gives what plain joins give, and its tables are not shuffled."""

import random
import re

import pytest
from pyspark.sql import DataFrameWriter

from corbel.operators import drugs
from corbel.sources import relation_index
from corbel.sources.relation_index import RelationIndex


def _tables(spark, seed):
    r = random.Random(seed)
    ids = [f"d{k}" for k in range(40)]
    kinds = ["has_ingredient", "has_dose_form", "has_tradename", "consists_of"]
    rel = [(r.choice(ids), r.choice(kinds), r.choice(ids), r.choice(["RXNORM", "rxnorm", "OTHER"])) for _ in range(300)] + [("d1", "has_ingredient", f"d{k}", "RXNORM") for k in range(40)]
    rel += rel[:50] + [(None, "has_ingredient", "d1", "RXNORM"), ("d2", "has_ingredient", None, "RXNORM"), ("d2", "has_tradename", "unknown", "RXNORM")]
    names = [(i, f"{i} oral tablet", "IN") for i in ids[:35]] + [(None, "x", "IN")]
    atts = [(r.choice(ids), r.choice(["UNII", "NDC", "ROUTE", "other"]), str(r.randrange(30))) for _ in range(200)] + [("d1", "UNII", str(k)) for k in range(60)] + [("d3", None, None)]
    return (
        spark.createDataFrame(rel, "src_rxcui string, rela string, dst_rxcui string, sab string"),
        spark.createDataFrame(names, "rxcui string, preferred_term string, tty string"),
        spark.createDataFrame(atts, "rxcui string, atn string, atv string"),
    )


def _rows(df):
    return sorted(repr(x) for x in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("crowd", [5, 100_000])
def test_equal_to_joins(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(relation_index, "CROWD", crowd)
    rel, names, atts = _tables(spark, crowd)
    RelationIndex.build(str(tmp_path / "i"), rel, names, atts).forget()
    index = RelationIndex.load(spark, str(tmp_path / "i"))
    assert _rows(index.enrich(names)) == _rows(drugs.enrich(names, rel, drugs.attribute_arrays(atts)))
    asked = spark.createDataFrame([("d1",), ("d1",), ("d7",), ("none",), (None,)], "rxcui string")
    want = {tuple(x) for x in rel.where("src_rxcui in ('d1', 'd7') and rela = 'has_ingredient' and upper(sab) = 'RXNORM'").select("src_rxcui", "dst_rxcui", "sab").collect()}
    got = [(x["src_rxcui"], x["dst_rxcui"], x["sab"]) for x in index.related(asked, ["has_ingredient"]).collect()]
    assert len(got) == len(want) and set(got) == want
    assert index.attributes(asked, ["unii"]).where("rxcui = 'd1'").count() >= 60
    assert index.related(asked.where("false")).count() == 0
    hot = spark.read.parquet(str(tmp_path / "i" / "relations_crowded"))
    assert (hot.count() > 0) == (crowd == 5)
    index.forget()


def test_empty(spark, tmp_path):
    rel, names, atts = (t.where("false") for t in _tables(spark, 1))
    index = RelationIndex.build(str(tmp_path / "i"), rel, names, atts)
    assert index.related(spark.createDataFrame([("d1",)], "rxcui string")).count() == 0
    index.forget()


def _above(plan: str, table: str) -> list[str]:
    """The operators from a table's scan up to the first join."""
    lines = plan.splitlines()
    at = next(k for k, x in enumerate(lines) if "FileScan" in x and table in x)
    depth, found = re.search(r"[A-Z*]", lines[at]).start(), []
    for line in reversed(lines[:at]):
        here = re.search(r"[A-Z*]", line)
        if here and here.start() < depth:
            depth = here.start()
            found.append(line)
            if "Join" in line:
                return found
    raise AssertionError("no join above")


def test_tables_are_not_shuffled(spark, tmp_path):
    index = RelationIndex.build(str(tmp_path / "i"), *_tables(spark, 3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = spark.createDataFrame([("d1",), ("d7",)], "rxcui string")
        plan = index.related(asked)._jdf.queryExecution().executedPlan().toString()
        for name in ("relations", "names"):
            path = _above(plan, index._table(name))
            assert "SortMergeJoin" in path[-1] and not any("Exchange" in x for x in path), plan
        assert "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        index.forget()


def _shuffled(plan: str) -> list[str]:
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


@pytest.mark.parametrize("few", [0, 64_000_000])
def test_relations_move_once_and_lie_by_key(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(relation_index, "FEW_NAMES", few)
    rel, names, atts = _tables(spark, 7)
    plans = []
    write = DataFrameWriter.saveAsTable

    def keep(self, *a, **k):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", keep)
    index = RelationIndex.build(str(tmp_path / "i"), rel, names, atts)
    # Without crowded keys repeats go where rows are dealt, not in a shuffle before it.
    assert "RepartitionByExpression" in plans[0] and plans[0].index("Aggregate") < plans[0].index("RepartitionByExpression") and "Join" not in plans[0], plans[0]
    assert all(t["by"] == [t["key"]] for t in index.tables.values()) and index.tables["names"]["bytes"] == spark.table(index._table("names")).selectExpr("sum(64 + length(rxcui) + length(name) + length(tty))").first()[0]
    asked = names.where("rxcui is not null")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = drugs.enriched(asked, index.related(asked, list(drugs.RELATED)), drugs.attribute_arrays(index.attributes(asked)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        if few:
            # Only what is asked moves: neither relations nor names nor what is grouped of them.
            assert all(re.search(r"hashpartitioning\((src_)?rxcui", x) for x in _shuffled(plan)), plan
            at = next(k for k, x in enumerate(plan.splitlines()) if "ObjectHashAggregate(keys=[src_rxcui" in x)
            assert "Exchange" not in plan.splitlines()[at - 1] and "ObjectHashAggregate" in plan.splitlines()[at + 1], plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert _rows(found) == _rows(drugs.enrich(asked, rel, drugs.attribute_arrays(atts)))
    index.forget()


def test_one_row_many_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relation_index, "CROWD", 50)
    rel, names, atts = _tables(spark, 9)
    many = rel.unionByName(spark.range(1000).selectExpr("'d9' src_rxcui", "'has_ingredient' rela", "'d1' dst_rxcui", "'RXNORM' sab"))
    index = RelationIndex.build(str(tmp_path / "i"), many, names, atts)
    assert index.tables["relations"]["by"] == ["src_rxcui", "part"] and index.tables["names"]["by"] == ["rxcui"]
    assert spark.table(index._table("relations")).count() == many.where("src_rxcui is not null").distinct().count()
    assert _rows(index.enrich(names)) == _rows(drugs.enrich(names, many, drugs.attribute_arrays(atts)))
    index.forget()


def test_equal_related_rows_count_once(spark):
    rel, names, _ = _tables(spark, 5)
    twice = rel.unionByName(rel).unionByName(spark.createDataFrame([("d4", "has_ingredient", "unknown", "RXNORM"), ("d4", "has_ingredient", "unknown", "rxnorm"), ("d4", "has_ingredient", None, "RXNORM")], rel.schema))
    none = drugs.attribute_arrays(spark.createDataFrame([], "rxcui string, atn string, atv string"))
    got = {x["rxcui"]: x["ingredients"] for x in drugs.enrich(names, twice, none).collect()}
    name = {x["rxcui"]: (x["preferred_term"], x["tty"]) for x in names.collect() if x["rxcui"]}
    want = {}
    for r in twice.collect():
        if r["rela"] == "has_ingredient" and r["sab"].upper() == "RXNORM" and r["src_rxcui"]:
            want.setdefault(r["src_rxcui"], set()).add((r["dst_rxcui"], *name.get(r["dst_rxcui"], (None, None))))
    for i, rows in want.items():
        if i in got:
            assert [tuple(x) for x in got[i]] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or "")), i
