"""Semantic vectors against a plain SVD, and near copies against the hashing encoder."""

import random

import numpy as np
from pyspark.sql import functions as F

from corbel.operators.semantic import SemanticEncoder, _terms, _weights, fit_semantic
from corbel.operators.vectors import encode, hashing_encoder

TOPICS = ["heart valve blood vessel pulse beat artery", "skin rash itch cream burn dry scale", "lung breath cough air wheeze chest oxygen", "bone joint ache swell knee hip walk"]


def _texts(n, seed=3):
    draw = random.Random(seed)
    return [" ".join(draw.choices(TOPICS[k % 4].split(), k=12)) for k in range(n)]


def _plain(texts, buckets, dims):
    """Singular values and the projector on the strongest directions, by numpy alone."""
    found = [sorted(_terms(t, buckets).items()) for t in texts]
    df = np.zeros(buckets)
    for f in found:
        df[[b for b, _ in f]] += 1
    idf = np.where(df > 0, np.log((1 + len(texts)) / (1 + df)) + 1, 0)
    a = np.zeros((len(texts), buckets))
    for row, f in zip(a, found):
        at, n = np.array([b for b, _ in f]), np.array([c for _, c in f], float)
        row[at] = _weights(at, n, np.array([0]), idf)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    return s[:dims], v[:dims].T @ v[:dims]


def test_equals_plain_svd(spark):
    texts = _texts(80)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = fit_semantic(docs, dims=4, rounds=6, buckets=512)
    values, onto = _plain(texts, 512, 4)
    assert np.allclose(got.values, values, rtol=2e-3)
    assert np.abs(got.basis @ got.basis.T - onto).max() < 2e-2


def test_any_dealing_and_reload(spark, tmp_path):
    docs = spark.createDataFrame([(t,) for t in _texts(60)] + [(None,), ("",), ("?!",)], "text string")
    one, two = (fit_semantic(d, dims=6, buckets=256) for d in (docs.coalesce(1), docs.repartition(7, F.rand(1))))
    assert np.array_equal(one.basis, two.basis) and np.array_equal(one.idf, two.idf) and np.array_equal(one.values, two.values)
    one.save(spark, str(tmp_path / "e"))
    again = SemanticEncoder.load(spark, str(tmp_path / "e"))
    said = ["heart pulse", "", "word that nobody said", None]
    assert np.array_equal(one(said), again(said)) and not one(said)[[1, 3]].any() and one(said)[0].any()


def test_empty_table_and_long_text(spark):
    none = fit_semantic(spark.createDataFrame([], "text string"), dims=3, buckets=64)
    assert none(["a b"]).tolist() == [[0.0, 0.0, 0.0]]
    long = " ".join(f"w{k % 70000}" for k in range(300_000))
    got = fit_semantic(spark.createDataFrame([(long,), ("w1 w2",), ("w1 w2",)], "text string"), dims=2, buckets=1 << 15)
    assert np.isfinite(got([long, "w1 w2"])).all()


def test_near_copies_against_hashing(spark):
    """The first neighbour of texts with a share of their words replaced: ahead of hashing when half is, not for light edits."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 60 and 4000").select("doc_id", "text").dropDuplicates(["text"])
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    pool = [t.split() or ["x"] for t in texts]
    encoder = fit_semantic(docs, dims=48)

    def edited(part):
        draw, out = random.Random(5), []
        for text in texts:
            words = text.split()
            for k in draw.sample(range(len(words)), len(words) // part):
                words[k] = draw.choice(draw.choice(pool))
            out.append(" ".join(words))
        return out

    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    found = {}
    for part in (10, 3, 2):
        asked = edited(part)
        for name, e in (("semantic", encoder), ("hashing", hashing_encoder(48))):
            near = (unit(e(asked)) @ unit(e(texts)).T).argmax(1)
            found[name, part] = float((near == np.arange(len(texts))).mean())
    assert found["semantic", 2] > found["hashing", 2] + 0.1
    assert all(found["semantic", part] > 0.9 for part in (10, 3, 2)), found
    assert encode(docs, "text", encoder).where("size(vec) = 48").count() == len(texts)
