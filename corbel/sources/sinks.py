"""Writers: Parquet by default, and the text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; null fields are left out.  ``path`` must not be a file."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "ord"])).alias("value")).write.mode("overwrite").text(path)


def _flat(df: DataFrame) -> list[Column]:
    return [F.array_join(F.sort_array(c), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]


def write_tsv(df: DataFrame, path: str) -> None:
    """Tabs under a header; arrays sorted and joined by commas."""
    df.select(*_flat(df)).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*_flat(df)).write.mode("overwrite").option("header", True).csv(path)


def write_ids(df: DataFrame, column: str, path: str, order: list[Column], top: int = 50) -> None:
    """The first ids as lines of text."""
    df.orderBy(*order).limit(top).select(F.col(column).cast("string")).coalesce(1).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors with their ordinal ``row_id``, ids and metadata in one table."""
    df.select("row_id", "id", "vec", "meta").write.mode("overwrite").parquet(path)


def report(df: DataFrame, **counts: Column) -> dict[str, float]:
    """Counters of a table in one pass."""
    return df.agg(*[c.alias(n) for n, c in counts.items()]).first().asDict()
