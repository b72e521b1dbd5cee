"""The similarity join against every pair, and the resolver over it."""

import random

import pytest

from corbel.functions.ranking import token_set_ratio
from corbel.operators import likeness, resolve

WORDS = ["acute", "renal", "failure", "otitis", "media", "chronic", "of", "the", "heart", "disease", "disorder", "a", "b", "c", "x1", "éclair", "naïve", "type", "2", "ii"]


def names(n, seed):
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 6))) for _ in range(n)]
    out += ["disease", "the disease", "a a a", "a b c d e f g h i j k l", "hyperthyroidism", "hypothyroidism", "hyperthyroidisms", "l2", "word" * 40, "two parts", " led  ", ""]
    return out


def spoilt(texts, seed):
    """The texts with words swapped, letters dropped, doubled or changed, and words joined."""
    r = random.Random(seed)
    out = []
    for t in texts:
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(t) + 1)
            t = r.choice([t[:at] + t[at + 1 :], t[:at] + r.choice("aeé x") + t[at:], " ".join(sorted(t.split(), reverse=True)), t.replace(" ", "", 1)])
        out.append(t)
    return out


@pytest.mark.parametrize("cutoff", [100, 88, 81, 72, 55, 30])
def test_pairs_equal_brute_force(spark, cutoff):
    lex, asked = sorted(set(names(160, 3))), sorted(set(spoilt(names(70, 3), 4) + names(20, 5)))
    want = {}
    for q in asked:
        for k in lex:
            s = token_set_ratio(q, k)
            if s >= cutoff and (len(set(q.split())) > 1 or not set(q.split()) <= set(k.split())):
                want[q, k] = s
        held = [k for k in lex if len(set(q.split())) == 1 and set(q.split()) <= set(k.split())]
        if held:
            want[q, min(held)] = 100.0
    frame = lambda rows: spark.createDataFrame([(t,) for t in [*rows, *rows[:9], None]], "text string").repartition(3)
    got = {(r["q"], r["key"]): r["score"] for r in likeness.similar(frame(asked), frame(lex), cutoff).collect()}
    missing = set(want) - set(got)
    assert not missing, sorted(missing)[:5]
    more = {k: s for k, s in got.items() if k not in want}
    assert all(set(q.split()) <= set(k.split()) and s == 100 for (q, k), s in more.items()) and all(got[k] == s for k, s in want.items())


def test_no_pair_is_joined_without_a_key(spark):
    rows = spark.createDataFrame([(t,) for t in names(30, 1)], "text string")
    plan = likeness.similar(rows, rows)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_best_names_equal_brute_force(spark):
    lex = sorted({" ".join(t.split()) for t in names(200, 7)} - {""})
    asked = [(k, t) for k, t in enumerate(spoilt(lex, 8))] + [(1000, None), (1001, "  "), (1002, "DISEASE"), (1003, "disease"), (0, "renal")]
    want = {}
    for k, t in asked:
        q = " ".join((t or "").lower().split())
        best = min(((-token_set_ratio(q, n), n) for n in lex), default=None)
        if q and -best[0] >= 88:
            want[k] = min(want.get(k, best), best)
    table = spark.createDataFrame([(n, str(j), n.upper()) for j, n in enumerate(lex)], "key string, snomed_id string, name string")
    got = {r["qid"]: (-r["score"], r["name"].lower()) for r in resolve.fuzzy(spark.createDataFrame(asked, "qid int, text string"), table).collect()}
    assert got == want
    assert resolve.fuzzy(spark.createDataFrame(asked, "qid int, text string"), table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        likeness.similar(table.selectExpr("key as text"), table.selectExpr("key as text"), 0)


def test_asked_texts_in_blocks(spark, monkeypatch):
    """Grams are looked up a block of asked texts at a time, and their pairs come out in parts."""
    lex, asked = [t for t in names(120, 11)], spoilt(names(60, 11), 12)
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    want = {tuple(r) for r in likeness.similar(frame(asked), frame(lex)).collect()}
    monkeypatch.setattr(likeness, "ASKED", 20)
    monkeypatch.setattr(likeness, "PAIRS", 3)
    assert want and {tuple(r) for r in likeness.similar(frame(asked), frame(lex)).collect()} == want


def test_grams_are_not_shuffled(spark):
    """Texts meet by their grams without a join: rows for every gram of every text were what didn't finish."""
    rows = likeness._kinds(likeness._named(spark.createDataFrame([(t,) for t in names(30, 1)], "text string")), 88.0)
    plan = likeness._by_grams(rows, rows, 88.0)._jdf.queryExecution().toString()
    assert "Join" not in plan and "MapInPandas" in plan
