"""Inputs beyond the sizes that operators ship to every task at once."""

import os
import random
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corbel import constants as K
from corbel import queries
from corbel.operators import cut, dictionary, resolve, vectors
from corbel.plans import evidence, questions


def test_every_mention_is_scored(spark):
    lex = spark.createDataFrame([("renal failure", "1", "Renal failure")], "key string, snomed_id string, name string")
    asked = spark.range(100_050).selectExpr("id as qid", "'failure renal' as text")
    assert resolve.fuzzy(asked, lex).count() == 100_050


def test_queries_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    rows = spark.createDataFrame([(k, [r.random() for _ in range(4)]) for k in range(30)], "row_id int, vec array<float>")
    asked = rows.selectExpr("row_id as query_id", "vec as qvec")
    for run in (vectors.search, vectors.search_by_expression):
        for metric in ("ip", "l2"):
            want = sorted((x["query_id"], x["rank"], x["row_id"]) for x in run(asked, rows, 3, metric).collect())
            assert len(want) == 90
            with monkeypatch.context() as m:
                m.setattr(vectors, "QUERIES", 7)
                assert sorted((x["query_id"], x["rank"], x["row_id"]) for x in run(asked, rows, 3, metric).collect()) == want


def test_labels_are_elected_for_all_names(spark, monkeypatch):
    r = random.Random(9)
    text = "".join(r.choice("abcdefghijklmnop") for _ in range(101_000))
    names = sorted({text[k : k + 14] for k in range(100_500)})
    rows = spark.createDataFrame([("s1", "x", text, 0), ("s2", "x", text[:20], 1), ("s2", "x", text[:20].upper(), 2)], "spl_set_id string, section string, text string, ord int")
    asked = spark.createDataFrame([(k, n.upper(), "") for k, n in enumerate(names)], "qid int, drug_name string, question_label string")
    got = {x["qid"]: x["elected"] for x in evidence.elect_labels(asked, rows).collect()}
    assert got == {k: "s2" if n in text[:20] else "s1" for k, n in enumerate(names)}


def test_terms_held_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "BROADCAST_TERMS", 2)
    texts = spark.createDataFrame([(1, "abcab"), (2, "b"), (3, None), (4, "B")], "k int, text string")
    terms = spark.createDataFrame([(t,) for t in ("a", "ab", "b", "bca", "x", "", "a")], "term string")
    assert sorted((x["k"], x["term"]) for x in dictionary.holding(texts, terms).collect()) == [(1, "a"), (1, "ab"), (1, "b"), (1, "bca"), (2, "b")]
    assert dictionary.holding(texts, terms.where("false")).count() == 0


def test_every_passage_is_looked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dictionary, "BROADCAST_TERMS", 40)
    spark.createDataFrame([(k, f"Passage {k}!") for k in range(100)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(5, "x " + " ".join(f"passage {k}!" for k in range(99))), (6, "PASSAGE 7!")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(x) for x in queries.queries()["passage_contains"](spark, str(tmp_path)).collect())
    assert got == [(k, 2 if k == 7 else 1, 5) for k in range(99)]


def _matches(df, key):
    return sorted(tuple(x) for x in df.select(key, "term", "start", "end", "match_text", "around").collect())


def test_whole_words_of_any_lexicon(spark, monkeypatch):
    r = random.Random(10)
    words = ["ab", "b", "abc", "é1", "x_y", "Ab", "ß", "中", "a-b"]
    texts = [(k, "".join(r.choice(words) + r.choice([" ", " ", "-", ", ", " + ", ""]) for _ in range(r.choice([3, 60])))) for k in range(60)]
    texts += [(7, texts[3][1]), (None, texts[3][1]), (61, None), (62, ""), (63, "ab b")]
    rows = spark.createDataFrame(texts, "k int, text string")
    terms = ["", "+", " + ", "ab", "b", "ab b", "b ab", "ab-b", "é1 ab", "ß", "x_y", "中", "ab b ab", "zz", "ab zz", "ab ", "(b"] + [f"none {k}" for k in range(50)]
    lex = spark.createDataFrame([(t,) for t in terms + terms[:5]], "term string")
    want = _matches(dictionary.spans(rows, lex, "k", words=True).where("k is not null"), "k")
    assert len(want) > 300
    nameless = dictionary.spans(rows, lex, "k", words=True).where("k is null").count()
    monkeypatch.setattr(dictionary, "BROADCAST_TERMS", 4)
    monkeypatch.setattr(dictionary, "TERMS_AT_ONCE", 3)
    got = dictionary.spans(rows, lex, "k", words=True)
    assert _matches(got.where("k is not null"), "k") == want
    assert got.where("k is null").count() == nameless > 0
    assert dictionary.whole_words(rows, lex.where("false"), "k").count() == 0
    assert dictionary.whole_words(rows.where("false"), lex, "k").count() == 0


def test_whole_words_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lex = spark.createDataFrame([(t,) for t in ["that", "with", "this", "from", "of the", "the", "in", "not there at all"]], "term string")
    want = _matches(dictionary.spans(docs, lex, "doc_id", words=True), "doc_id")
    assert want and _matches(dictionary.whole_words(docs, lex, "doc_id"), "doc_id") == want


def test_names_in_long_texts(spark):
    """A place of a text costs no copy of the text: 60,000 words took minutes when it did."""
    text = " ".join(f"w{k % 997}" for k in range(60_000)) + " Red Kite is the red kite of may"
    rows = spark.createDataFrame([("a", text), ("b", "the is of"), ("c", None), ("d", "of the red, red kite"), ("e", "")], "qid string, text string")
    lex = spark.createDataFrame([(k,) for k in ("red kite", "red", "kite of may", "the is", "of the", "no such name here", "w1 w2 w3 w4 w5 w6 w7", "kite  of", None, "")], "key string")
    start = time.monotonic()
    assert {r["qid"]: r["name"] for r in questions.names_in_questions(rows, lex).collect()} == {"a": "kite of may", "d": "red kite"}
    assert time.monotonic() - start < 45


def test_search_holds_few_scores(spark):
    """Scores are held for some rows and queries at a time: 2,000 queries against 10,000 rows took over 1 GB at once."""
    r = np.random.default_rng(3)
    rows = spark.createDataFrame(pd.DataFrame({"row_id": range(10_000), "vec": r.integers(-3, 4, (10_000, 4)).astype(float).tolist()})).coalesce(1)
    asked = rows.where("row_id % 5 = 0").selectExpr("row_id as query_id", "vec as qvec")
    def run(q, v, of):
        return sorted((x["query_id"], x["rank"], x["row_id"], x["score"]) for x in vectors.search(q, v, 3, of).collect())

    assert vectors.ROWS_AT_ONCE * vectors.QUERIES_AT_ONCE * 8 < 8e6
    for metric in ("ip", "l2"):
        v = np.array([x["vec"] for x in rows.orderBy("row_id").collect()], float)
        scores = v[::5] @ v.T if metric == "ip" else -((v[::5, None] - v[None]) ** 2).sum(2)
        first = np.argsort(-scores, axis=1, kind="stable")[:, :3]
        want = [(5 * k, n + 1, int(j), float(abs(scores[k, j]) if metric == "l2" else scores[k, j])) for k in range(2_000) for n, j in enumerate(first[k])]
        assert run(asked, rows, metric) == want


def test_batches_come_in_pieces(spark):
    """A step takes few rows at once, whatever Spark's batches hold: 10,000 parsed texts were held together."""
    parts = list(cut.pieces(iter([pd.DataFrame({"k": range(1_000)}), pd.DataFrame({"k": []}), pd.DataFrame({"k": range(1_000, 1_300)})])))
    assert max(map(len, parts)) <= cut.PIECE and [k for p in parts for k in p["k"]] == list(range(1_300))


def test_a_cue_has_one_of_its_words():
    """Snippets skip a pattern whose words a text lacks; the same snippets come out as with every pattern searched."""
    texts = [f"Foo bar. It has {x} in all of it! Then more." for x in (
        "contraindicated with MAOI", "DO NOT USE any monoamine oxidase", "Vitamin  K antagonist", "P-gp", "co-administration", "Increases INR", "reduce levels", "TMP-SMX", "miconazole", "pregnancy", "severe hepatic impairment", "REMS", "serious hazards",
        "life threatening things", "ſeizure", "ſerious riſks", "İndication", "5 %x", "for the prevention", "usual starting dose 5 mg. No", "initial dose of 3 g. No", "titrate up. No", "maximum daily dose 4 mg. No", "given with meals now. No", "nothing",
    )]
    intents = [*evidence._CUES, "dosage"]
    found = [[evidence.intent_snippet_of(i, t) for i in intents] for t in texts]
    looked = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(evidence, "_present", lambda words, low: looked.append(words) or [""])
        assert found == [[evidence.intent_snippet_of(i, t) for i in intents] for t in texts] and looked


def test_snippets_are_cut_of_the_best_rows_only(spark, tmp_path):
    """Without similarities a snippet is cut for no more than the rows that are shown."""
    seen = str(tmp_path)

    @F.pandas_udf("string")
    def told(intents: pd.Series, texts: pd.Series) -> pd.Series:
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write("x" * len(texts))
        return texts.str.slice(0, 20)

    rows = spark.createDataFrame([("s1", "warnings", f"Warning: fatal case {k:04d}.", k) for k in range(400)], "spl_set_id string, section string, text string, ord long")
    asked = spark.createDataFrame([("q", "what", "warning", "", "x", "s1")], "qid string, text string, intent string, phrase string, drug_name string, question_label string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(evidence, "intent_snippet", told)
        found = evidence.collect_evidence(asked, rows).collect()
    assert len(found) == 6
    assert 0 < sum(os.path.getsize(f"{seen}/{f}") for f in os.listdir(seen)) <= 6


def test_a_pattern_has_one_of_its_words(spark):
    """Stages skip a pattern whose words a text lacks."""
    some = [
        "contraindicated with maoi", "do not use any monoamine oxidase", "Serotonin Syndrome", "WARFARIN", "coumadin", "vitamin\tk  antagonist", "xinr", "CYP3A4", "p-gp", "PGP", "concomitant", "co-administration", "co administration", "use with", "avoid concomitant",
        "bleeding", "hemorrhage", "increase inr", "increases level", "increase levels", "reduce level", "reduces levels", "potentiates", "anticoagulant effect", "tmp-smx", "tmpsmx", "trimethoprim", "sulfamethoxazole", "metronidazole", "azole", "amiodarone", "rifampin",
        "macrolide", "fluoroquinolone", "phenytoin", "carbamazepine", "miconazole", "nsaid", "hypersensitivity", "severe renal impairment", "severe hepatic impairment", "concomitant use with nitrate", "pregnancy", "boxed warning", "black box", "REMS", "warnings",
        "precaution", "serious risk", "serious hazards", "fatal", "mortality", "life-threatening", "life threatening", "agranulocytosis", "severe neutropenia", "myocarditis", "seizure", "adverse reaction", "side effects", "most common", "most frequently", "5 % of", "12%x", "nausea",
        "vomit", "vomiting", "diarrhea", "headache", "dizziness", "abdominal pain", "injection site", "constipation", "fatigue", "is indicated for", "for the treatment", "for the prevention", "for the reduction", "indications", "rash", "urticaria", "ſeizure", "İnr",
    ]
    rows = spark.createDataFrame([(x,) for x in some] + [(f"Of it.\n{x.upper()} and so on",) for x in some], "text string").withColumn("low", F.lower("text"))
    pairs = [(p, w) for i in K.INTENT_CUES for p, w in zip(K.INTENT_CUES[i], K.CUE_WORDS[i], strict=True)] + [(K.HARD_WARNING, K.HARD_WORDS), (K.ADVERSE_HINT, K.HINT_WORDS)]
    got = rows.select("text", *[F.struct(F.col("text").rlike("(?i)" + p).alias("a"), evidence._matches(F.col("text"), F.col("low"), p, w).alias("b")).alias(f"x{k}") for k, (p, w) in enumerate(pairs)]).collect()
    assert [r for r in got if any(r[f"x{k}"]["a"] != r[f"x{k}"]["b"] for k in range(len(pairs)))] == []
    assert all(any(r[f"x{k}"]["a"] for r in got) for k in range(len(pairs)))


def test_patterns_are_looked_for_once(spark, monkeypatch):
    """What a text tells is found before it meets questions: not for each of them again, and no text is dealt by label."""
    rows = spark.createDataFrame([("s1", "warnings", f"Warning: fatal case {k}.", k) for k in range(9)] + [("s2", "x", "S1 is used with warfarin.", 9)], "spl_set_id string, section string, text string, ord int")
    asked = spark.createDataFrame([(f"q{i}{k}", "what", i, f"case {k}" if k else "", "s1", "s1") for i in ("warning", "interaction", "dosage") for k in range(3)], "qid string, text string, intent string, phrase string, drug_name string, question_label string")
    seen, top = [], evidence.top_rows
    monkeypatch.setattr(evidence, "top_rows", lambda df, *a: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or top(df, *a))
    found = evidence.collect_evidence(asked, rows).collect()
    assert seen and not any("serotonin" in plan or "seizure" in plan for plan in seen)
    assert {(r["qid"], r["spl_set_id"], r["stage"]) for r in found} >= {("qwarning0", "s1", 1), ("qwarning2", "s1", 1), ("qinteraction1", "s2", 21)}
    assert [r["snippet"] for r in found if r["qid"] == "qwarning2" and r["rank"] == 1] == ["Warning: fatal case 0."]
