"""Latent semantic vectors of texts: a truncated SVD of tf-idf weights by randomised range finding.

Words fall into a fixed number of buckets.  A subspace of the buckets, random
at first, is multiplied by the weights and their transpose in every task, a
batch of texts at a time; the tasks' products are summed by one grouped shuffle
and made orthonormal, a few rounds long.  What reaches the driver has a row for
each bucket, whatever the number of texts.

Weights and subspace are integers in these products, so sums are exact: the
basis doesn't depend on how texts are dealt to tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators.cut import discard, materialize, pieces

#: Steps of a weight of 1 and of a component of 1 in exact products: a sum over 2^36 texts stays within 64 bits.
_WEIGHT, _PART = 10, 16
#: Entries of the matrix of weights that are multiplied at once.
_SLICE = 1 << 14
_WORD = re.compile(r"\w+")


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def _terms(text: str | None, buckets: int) -> Counter:
    """How often each bucket's words stand in a text; null is empty."""
    found: Counter = Counter()
    for m in _WORD.finditer((text or "").lower()):
        found[_hash(m.group()) % buckets] += 1
    return found


def _weights(at: np.ndarray, n: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf weights, each text's of length 1; a text whose words are all unknown has none."""
    w = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(np.add.reduceat(w * w, starts))
    return w / np.repeat(np.where(norm > 0, norm, 1), np.diff(np.append(starts, len(at))))


def _slices(ats: list[np.ndarray], ns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts that have words, as many at once as hold about _SLICE entries: (their places, entries' buckets, counts, first entries)."""
    held: list[int] = []
    size = 0
    for k in range(len(ats) + 1):
        if held and (k == len(ats) or size + len(ats[k]) > _SLICE):
            sizes = [len(ats[i]) for i in held]
            yield np.array(held), np.concatenate([ats[i] for i in held]), np.concatenate([ns[i] for i in held]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            held, size = [], 0
        if k < len(ats) and len(ats[k]):
            held.append(k)
            size += len(ats[k])


@dataclass
class SemanticEncoder:
    """Texts to vectors: the weights of their words times ``basis`` (a row for each bucket).  Texts without known words are zero."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]))
        found = [_terms(t, len(self.idf)) for t in texts]
        ats = [np.array(sorted(f), int) for f in found]
        for rows, at, n, starts in _slices(ats, [np.array([f[b] for b in a], float) for f, a in zip(found, ats)]):
            out[rows] = np.add.reduceat(_weights(at, n, starts, self.idf)[:, None] * self.basis[at], starts, axis=0)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the encoder as one Parquet table, a row for each bucket that has words; bucket -1 has the singular values."""
        used = np.flatnonzero(self.idf)
        rows = [(-1, float(len(self.idf)), self.values.tolist()), *[(int(b), float(self.idf[b]), self.basis[b].tolist()) for b in used]]
        spark.createDataFrame(rows, "bucket int, idf double, part array<double>").coalesce(1).write.mode("error").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SemanticEncoder:
        rows = spark.read.parquet(path).collect()
        head = next(r for r in rows if r["bucket"] < 0)
        idf, basis = np.zeros(int(head["idf"])), np.zeros((int(head["idf"]), len(head["part"])))
        for r in rows:
            if r["bucket"] >= 0:
                idf[r["bucket"]], basis[r["bucket"]] = r["idf"], r["part"]
        return cls(idf, basis, np.array(head["part"]))


def _counted(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(at, n): the buckets of each text that has words, ascending, and their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            found = [sorted(f.items()) for t in b["text"] if (f := _terms(t, buckets))]
            yield pd.DataFrame({"at": [[k for k, _ in f] for f in found], "n": [[c for _, c in f] for f in found]})

    return docs.select(F.col(text).alias("text")).mapInPandas(run, "at array<int>, n array<int>")


def _product(terms: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Transposed weights times weights times ``q``, exactly for weights and ``q`` in steps."""
    buckets, wide = q.shape
    shared = terms.sparkSession.sparkContext.broadcast((idf, np.rint(q * (1 << _PART)).astype(np.int64)))
    names = [f"y{k}" for k in range(wide)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, part = shared.value
        total, seen = np.zeros((buckets, wide), np.int64), np.zeros(buckets, bool)
        for b in batches:
            for rows, at, n, starts in _slices([np.asarray(a) for a in b["at"]], [np.asarray(n, float) for n in b["n"]]):
                w = np.rint(_weights(at, n, starts, idf) * (1 << _WEIGHT)).astype(np.int64)[:, None]
                y = np.add.reduceat(w * part[at], starts, axis=0) >> _WEIGHT
                back = w * np.repeat(y, np.diff(np.append(starts, len(at))), axis=0)
                order = np.argsort(at, kind="stable")
                found, first = np.unique(at[order], return_index=True)
                total[found] += np.add.reduceat(back[order], first, axis=0)
                seen[found] = True
        used = np.flatnonzero(seen)
        for k in range(0, len(used), 4096):
            some = used[k : k + 4096]
            yield pd.DataFrame(total[some], columns=names).assign(bucket=some)

    sums = terms.mapInPandas(run, ", ".join(f"{c} long" for c in names) + ", bucket long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((buckets, wide))
    found = sums.toPandas()  # a row for each bucket at most
    out[found["bucket"].to_numpy(int)] = found[names].to_numpy(float) / (1 << (_PART + _WEIGHT))
    shared.unpersist()
    return out


def fit_semantic(docs: DataFrame, text: str = "text", dims: int = 48, spare: int = 8, rounds: int = 2, buckets: int = 1 << 15, seed: int = 7) -> SemanticEncoder:
    """The encoder of the ``dims`` strongest directions of all texts of ``docs``.

    Every text is read once, its buckets and counts are written; each round and
    one more read those.  Null and empty texts, and an empty table, have no
    words and don't count; repeated rows count as often as they stand there.
    Directions that the texts don't have are zero.
    """
    terms = materialize(_counted(docs, text, buckets), "terms")
    spread = terms.select(F.explode("at").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).toPandas()
    n = terms.count()
    idf = np.zeros(buckets)
    idf[spread["bucket"].to_numpy(int)] = np.log((1 + n) / (1 + spread["n"].to_numpy(float))) + 1
    start = np.random.default_rng(seed).standard_normal((buckets, min(dims + spare, buckets)))
    q = np.linalg.qr(start * (idf > 0)[:, None])[0]
    for _ in range(rounds):
        q = np.linalg.qr(_product(terms, idf, q))[0]
    small = q.T @ _product(terms, idf, q)
    discard(terms)
    strength, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-strength, kind="stable")[:dims]
    known = strength[best] > max(strength.max(), 0) * 1e-5
    basis = (q @ turn[:, best]) * known * (idf > 0)[:, None]
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(len(best))] < 0, -1, 1)
    return SemanticEncoder(idf, basis, np.sqrt(np.where(known, strength[best], 0)))
