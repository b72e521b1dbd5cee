"""Scores and similarities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corbel import constants as K
from corbel.functions.text import col, literal_map


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine with guarded norms: zero vectors give 0."""
    return F.coalesce(dot(a, b) / ((norm(a) + 1e-9) * (norm(b) + 1e-9)), F.lit(0.0))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column | str) -> Column:
    """The vector over its norm, zero vectors as they are."""
    n = norm(a) + 1e-12
    return F.transform(col(a), lambda x: (x / n).cast("float"))


def edge_score(confidence: Column | str, labels: Column | str) -> Column:
    return 0.6 * col(confidence) + 0.4 * F.log1p(col(labels).cast("double"))


def link_score(tty: Column | str, has_ndc: Column | str, via: Column | str) -> Column:
    weight = F.coalesce(literal_map(K.LINK_TYPE_WEIGHT)[F.upper(F.coalesce(col(tty), F.lit("")))], F.lit(0))
    return weight + F.when(col(has_ndc), 60).otherwise(0) + F.when(col(via) == "spl_set_id", 5).otherwise(0)


def surface_confidence(surface: Column | str) -> Column:
    n = F.length(F.trim(col(surface)))
    return F.when(n < 4, 0.60).when(n < 8, 0.78).otherwise(0.90)


def neighbour_confidence(distance: Column | str, metric: str = "l2") -> Column:
    """0.5 to 0.95; distances count down, inner products count up."""
    d = F.abs(col(distance)) if metric == "l2" else F.greatest(F.lit(0.0), F.lit(1.0) - col(distance))
    return F.coalesce(F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.5 + 0.5 / (1.0 + d))), F.lit(0.7))


def evidence_score(cos: Column, section: Column, phrase: Column, dose: Column, intent: Column) -> Column:
    """Weighted evidence: similarity, section and phrase, plus what a dose or a cue adds."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return 0.38 * cos + 0.38 * flag(section) + 0.12 * flag(phrase) + 0.07 + 0.25 * flag(dose) + 0.30 * flag(intent)


def percent(part: Column | str, whole: Column | str) -> Column:
    return F.round(col(part) / F.greatest(F.lit(1), col(whole)) * 100, 2)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: best likeness of the shared words alone and with either side's others."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, mine, yours = sorted(left & right), sorted(left - right), sorted(right - left)
    if both and (not mine or not yours):
        return 100.0
    base, one, two = " ".join(both), " ".join(both + mine), " ".join(both + yours)
    best = _indel(one, two)
    if both:
        best = max(best, _indel(base, one), _indel(base, two))
    return best


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) if x is not None and y is not None else 0.0 for x, y in zip(a, b)])
