"""First, last, newest and best rows of a key, always by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in the given order, with their rank if asked for."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= n)
    return ranked.withColumnRenamed("__rank", rank) if rank else ranked.drop("__rank")


def first_rows(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Of rows with one key the first."""
    return top_rows(df, keys, [F.asc(order)])


def last_rows(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Of rows with one key the last."""
    return top_rows(df, keys, [F.desc(order)])


def newest_rows(df: DataFrame, keys: list[str], date: str, order: str = "ord") -> DataFrame:
    """Of rows with one key the newest, by the digits of a date; of equally new ones the last."""
    digits = F.regexp_replace(F.coalesce(F.col(date).cast("string"), F.lit("")), r"\D", "")
    return top_rows(df, keys, [digits.desc(), F.desc(order)])


def ordered_list(value: Column, order: Column, distinct: bool = True) -> Column:
    """Values of a group in the order given; of equal values the first."""
    out = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
    return F.array_distinct(out) if distinct else out


def sorted_set(value: Column) -> Column:
    return F.sort_array(F.collect_set(value))


def compact_text_set(value: Column) -> Column:
    """Distinct texts sorted without regard to case, then by themselves."""
    x = F.array_distinct(value)
    return F.transform(F.array_sort(F.transform(x, lambda v: F.struct(F.lower(v).alias("l"), v.alias("v")))), lambda s: s["v"])


def first_stage(df: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """Rows of each key's first stage that has any."""
    return df.withColumn("__stage", F.min(stage).over(Window.partitionBy(*keys))).where(F.col(stage) == F.col("__stage")).drop("__stage")


def fallback(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``primary``, and ``secondary`` for keys that ``primary`` lacks."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), keys, "left_anti"))
