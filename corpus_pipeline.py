"""A corpus pipeline of five stages over ``documents``.

Each stage takes the session, its predecessor's documents and the folder of the
tables; its result is written as Parquet and read again for the next stage.
Rows without an id, null texts, repeated rows and ids, further columns of any
name and empty tables are taken by every stage; what becomes of them is stated
where the stage's operator is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corbel.llm.chunks import without_repeats
from corbel.llm.common import shared_dir, table
from corbel.llm.mixing import take_mixed
from corbel.llm.pieces import encode_pieces
from corbel.llm.quality import keep_good
from corbel.llm.queries import PIECES, documents, tokenizer
from corbel.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject; see ``keep_good``."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, alike by 0.8 in shingles of five words; see ``keep_one``."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds; see ``without_repeats``."""
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; see ``take_mixed``."""
    return take_mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; see ``encode_pieces``."""
    return encode_pieces(docs, tokenizer(PIECES))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixture),
    ("sentencepiece coding", tokens),
]

#: Fitted models, hashes and random draws have no SQL; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/corbel/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
