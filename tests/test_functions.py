"""Functions against plain Python and worked examples."""

import hashlib
import json
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corbel.functions import keys, ranking, text
from corbel.operators.chunker import windows
from corbel.operators.concepts import pack


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("code", "plain", "segment"),
    [("1234-5678-90", "01234567890", "01234567890"), ("12345-678-90", "01234567890", "12345067890"), ("12345-6789-0", "01234567890", "12345678900"), ("12345678901", "12345678901", "12345678901"), ("1234567890", "01234567890", "1234567890"), ("ABC", None, "")],
)
def test_package_codes(spark, code, plain, segment):
    assert one(spark, keys.ndc11("c"), c=code) == plain
    assert one(spark, keys.ndc11_by_segment("c"), c=code) == segment


def test_label_packages(spark):
    products, packages = keys.label_packages("t")
    row = spark.createDataFrame([("NDC 1234-567-8 and 12345-6789-00",)], "t string").select(products.alias("a"), packages.alias("b")).first()
    assert row.a == ["01234-0567-00", "12345-6789-00"] and row.b == ["01234-0567-08"]


def test_uuid5_equals_python(spark):
    got = [r[0] for r in spark.createDataFrame([("a",), ("é|x",), ("",)], "n string").select(keys.uuid5(uuid.NAMESPACE_URL, "n")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in ("a", "é|x", "")]


def test_blake2s(spark):
    got = one(spark, keys.blake2s_of_json("j"), j='{"b": 1, "a": "x"}')
    assert got == hashlib.blake2s(json.dumps({"a": "x", "b": 1}, sort_keys=True, separators=(",", ":")).encode(), digest_size=8).hexdigest()


def test_folding(spark):
    assert one(spark, text.fold_accents("s"), s="Zorvexíl  10 MG") == "zorvexil 10 mg"
    assert one(spark, text.fold_ascii("s"), s="Ménière’s") == "menieres"


def test_dates(spark):
    df = spark.createDataFrame([("20240131",), ("20241331",), ("2024-1-1",)], "d string")
    assert [tuple(r) for r in df.select(keys.iso_date("d"), keys.iso_date("d", check=True)).collect()] == [("2024-01-31", "2024-01-31"), ("2024-13-31", "20241331"), ("2024-1-1", "2024-1-1")]


def test_titles(spark):
    brand, generic = text.title_names("t")
    row = spark.createDataFrame([("ZORVEX® (zorvexil) TABLETS, USP",), ("Plain Tablets",)], "t string").select(brand.alias("b"), generic.alias("g")).collect()
    assert [tuple(r) for r in row] == [("zorvex", "zorvexil"), ("plain", None)]


def test_tags(spark):
    assert one(spark, text.strip_tag("s"), s="Zorbitis (acute) (disorder)") == "Zorbitis (acute)"
    assert one(spark, text.semantic_tag("s"), s="Zorbitis (acute) (disorder)") == "disorder"
    assert one(spark, text.heading_key("s"), s="INFORMATION FOR OWNERS/CAREGIVERS SECTION") == "information_for_owners_or_caregivers"


def test_edge_score(spark):
    assert one(spark, ranking.edge_score(F.lit(0.9), F.lit(3))) == pytest.approx(1.094518, abs=1e-6)


@given(st.text("ab cé", max_size=30), st.text("ab cé", max_size=30))
@settings(max_examples=200, deadline=None)
def test_token_set_ratio_properties(a, b):
    r = ranking.token_set_ratio(a, b)
    assert 0 <= r <= 100 and r == pytest.approx(ranking.token_set_ratio(b, a))
    if a.split():
        assert ranking.token_set_ratio(a, a) == 100


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.text("abc", max_size=15), st.text("abc", max_size=15))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    assert ranking._common(a, b) == _subsequence(a, b)


@pytest.mark.parametrize(
    ("n", "spans"), [(100, [(0, 100)]), (161, [(0, 161), (1, 161)]), (500, [(0, 500), (340, 500)]), (2500, [(0, 1100), (940, 2040), (1880, 2500), (2340, 2500)])]
)
def test_windows_by_stride(n, spans):
    body = "".join(chr(97 + (k * 7 + k // 26) % 26) for k in range(n))
    assert [w[:2] for w in windows(body, distinct=False)] == spans


@given(st.text("ab .\n", max_size=4000))
@settings(max_examples=60, deadline=None)
def test_windows_overlap(body):
    found = list(windows(body, 300, 500, 60, distinct=False))
    for a, b in zip(found, found[1:]):
        assert b[0] <= a[1] and b[0] > a[0]


def test_windows_end_at_sentences():
    body = "word " * 200 + "end. " + "word " * 100
    assert windows(body).__next__()[1] == 1005
    assert list(windows("")) == [] and [w[2] for w in windows("x y " * 400, 100, 200, 0)] == list(range(1))


def test_synonym_packs():
    assert list(pack([], "S:\n", 10)) == []
    assert list(pack(["a" * 100, "b"], "S:\n", 10)) == ["S:\n- " + "a" * 100 + "\n", "S:\n- b\n"]


def test_snippets():
    good = "This is a sentence of six words. "
    assert text.snippet_of("Short. " + good * 4) == (good * 3).strip()
    assert text.snippet_of("Too short.") == "Too short."
    assert text.snippet_of("NDC 12345-678-90 only") == "NDC only" and text.snippet_of(None) == "" and text.snippet_of("x.12345 y. " + good) == good.strip()
    long = text.snippet_of(("word " * 200 + ". ") * 2)
    assert long.endswith("…") and len(long) <= 601
