"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from corbel.operators.cut import discard, materialize, shared_dir, small_batches

__all__ = ["WORD", "discard", "fold", "materialize", "own", "packed", "row_hash", "shared_dir", "small_batches", "table", "text_of", "unpacked"]

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus, F.lit(0))


def own(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **made: Column) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, beside columns that are made of them: so no names clash."""
    return docs.select(F.struct(*[own(c) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in made.items()])


def unpacked(df: DataFrame, names: list[str], **made: Column) -> DataFrame:
    """The struct ``row`` as columns again; ``made`` replaces columns of those names, or follows them."""
    field = lambda c: F.col("row").getField(c)
    return df.select(*[(made[c] if c in made else field(c)).alias(c) for c in names], *[v.alias(c) for c, v in made.items() if c not in names])


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of a whole row; maps, which have no hash, are left out."""
    return F.xxhash64(*[own(f.name) for f in docs.schema.fields if _hashable(f.dataType)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
