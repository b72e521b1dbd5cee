"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed in Arrow batches.  The trees are
fitted in numpy on a bounded sample of labelled rows and flattened into
complete binary trees, which numpy walks level by level for a batch at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.llm.common import fold, packed, text_of, unpacked

#: Names of the document statistics, in the order of the columns.
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "std_word", "distinct_words", "top_word",
    "repeats", "upper", "lower", "digit", "space", "newline", "sentence_marks",
    "pipes", "shouts", "symbols", "other_marks", "non_ascii", "entropy",
    "repeated_lines", "mean_line", "short_words", "marked_words", "top_byte",
)

#: Most labelled rows that a fit reads; the sample is the rows whose hashed id is smallest.
TRAIN_ROWS = 20_000

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t",
    "newline": b"\n\r",
    "sentence_marks": b".,;:?",
    "pipes": b"|",
    "shouts": b"!",
    "symbols": b"#$%&*@^~",
    "other_marks": b"\"'()+-/<=>[]\\_`{}",
    "non_ascii": bytes(range(128, 256)),
}


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(_CLASSES)))
    for k, members in enumerate(_CLASSES.values()):
        m[np.frombuffer(members, np.uint8), k] = 1
    return m


_MATRIX = _class_matrix()


def statistics(texts) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; null and empty texts give zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    at = {n: k for k, n in enumerate(STATISTICS)}
    for row, text in zip(out, texts):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        share = counts / len(raw)
        row[at["upper"] : at["upper"] + 7] = (share @ _MATRIX)[:7]
        row[at["shouts"] : at["shouts"] + 4] = (share @ _MATRIX)[7:]
        some = share[share > 0]
        row[at["log_bytes"]] = np.log1p(len(raw))
        row[at["entropy"]] = -(some * np.log2(some)).sum()
        row[at["top_byte"]] = share.max()
        words = raw.split()
        if words:
            sizes = np.fromiter(map(len, words), np.int32, len(words))
            seen = Counter(words)
            row[at["log_words"]] = np.log1p(len(words))
            row[at["mean_word"]] = sizes.mean()
            row[at["std_word"]] = sizes.std()
            row[at["distinct_words"]] = len(seen) / len(words)
            row[at["top_word"]] = max(seen.values()) / len(words)
            row[at["repeats"]] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
            row[at["short_words"]] = (sizes <= 2).mean()
            row[at["marked_words"]] = sum(n for w, n in seen.items() if w[-1:] in b"!#$%&*@^~|") / len(words)
        lines = raw.split(b"\n")
        row[at["repeated_lines"]] = 1 - len(set(lines)) / len(lines)
        row[at["mean_line"]] = np.log1p(len(raw) / len(lines))
    return out


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth, flattened; leaves hold log-odds."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss over binned statistics.

    Without rows, every text scores 1 (there is no reason to reject it).
    """
    nodes, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, leaves))
    if len(y) == 0:
        return Forest(depth, 30.0, feature[:0], threshold[:0], value[:0])
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
    n, width = x.shape
    offsets = np.arange(width) * bins
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 2 * least:
                    cell = (binned[rows] + offsets).ravel()
                    gs, hs, ns = (np.bincount(cell, np.repeat(w, width), width * bins).reshape(width, bins).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows))))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    gain[(ns < least) | (nt - ns < least)] = -1
                    for f in range(width):
                        gain[f, len(cuts[f]) :] = -1
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, b] > 1e-6:
                        feature[t, k], threshold[t, k] = f, cuts[f][b]
                node[rows] = 2 * k + 1 + (x[rows, feature[t, k]] > threshold[t, k])
        leaf = node - nodes
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value[t] = -rate * gs / (hs + ridge)
        total += value[t][leaf]
    return Forest(depth, base, feature, threshold, value)


def sample_rows(docs: DataFrame, ids: DataFrame, id_column: str, *columns) -> DataFrame:
    """One row of ``docs`` for each of the few ``ids`` (__id, __y): __id, __y and the columns, of rows with one id the least by their hash.

    ``ids`` is a bounded sample, so it may be broadcast; the rows are reduced on
    the map side before they are shuffled.
    """
    names = [f"__c{k}" for k in range(len(columns))]
    rows = docs.select(F.col(id_column).alias("__id"), *[c.alias(n) for c, n in zip(columns, names)]).join(F.broadcast(ids), "__id")
    return rows.groupBy("__id", "__y").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("c")).select("__id", "__y", *[F.col(f"c.{n}").alias(n) for n in names])


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", train_rows: int = TRAIN_ROWS, keep=None) -> Forest:
    """Fit on at most ``train_rows`` labelled rows for whose id ``keep`` holds.

    Null ids and labels are left out; an id counts once, with its largest label
    and one of its texts, null as the empty text.  Without rows every text
    scores 1.  Only statistics reach the driver, never texts.
    """
    ids = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    if keep is not None:
        ids = ids.where(keep)
    ids = ids.groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).cast("double").alias("__y"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(train_rows)

    def measured(batches):
        for b in batches:
            x = statistics(b["__c0"])
            yield pd.DataFrame({"x": list(x), "y": b["__y"]})

    rows = sample_rows(docs, ids, id_column, text_of(text_column)).select("__c0", "__y").mapInPandas(measured, "x array<double>, y double").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(STATISTICS))
    y = rows["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    return fit_forest(x[order], y[order])


def score_quality(docs: DataFrame, forest: Forest, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is good.

    Null texts are scored as empty ones; equal texts score alike, repeated rows
    stay.  An existing column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(statistics(texts)))

    return docs.withColumn(score_column, score(text_of(text_column)))


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; nulls and repeats: see ``fit_quality`` and ``score_quality``."""
    forest = fit_quality(docs, labels, keep=fold("doc_id", 3) != 1)
    plain = docs.select("doc_id", "text")
    return score_quality(plain, forest).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns.

    Rows without an id are scored as well, null texts as empty ones; rows that
    repeat go or stay together.  Without labelled rows all stay.
    """
    forest = fit_quality(docs, labels, keep=fold("doc_id", 3) != 1)
    scored = score_quality(packed(docs, text=F.col("text")), forest)
    return unpacked(scored.where(F.col("score") >= threshold), docs.columns)
