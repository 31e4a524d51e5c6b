"""Helpers that the operators with Python workers share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows handed to a Python worker at once, so that very long texts do not pile up in it. A batch is
#: there several times: in the executor's buffers, in Arrow's of the worker, as strings, and as what is returned.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4_000


def bounded(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches of this session in bytes as well as in rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return what Arrow keeps of past batches; Spark keeps the worker, idle too, beside the executor's heap."""
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filled(column: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
