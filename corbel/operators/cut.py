"""Cutting a plan's lineage at a written table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python step takes at once.
PIECE = 256


def pieces(batches: Iterator[pd.DataFrame], rows: int = PIECE) -> Iterator[pd.DataFrame]:
    """The batches in pieces, so that what a step makes of them is bounded whatever Spark's batches hold."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches hold few rows: texts may be very long.  The caller's choice of fewer stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@cache
def _local_folder() -> str:
    """A folder of this process alone, for local sessions; it goes with the process."""
    path = tempfile.mkdtemp(prefix="corbel-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none gets a temporary one; on a cluster that
    would be a different disk on every machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _local_folder()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    What follows is planned over a scan: no expression before the cut is
    planned or computed twice, and a lost executor costs a reread.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corbel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corbel_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that nothing reads any more; any other is left alone."""
    path = getattr(table, "_corbel_path", None)
    if path:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
