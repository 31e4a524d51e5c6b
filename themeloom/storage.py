"""Shared-folder tables and positions, the two places where a plan is cut.

``settle`` writes an intermediate result once, so later steps read it instead of
recomputing it, and so Catalyst knows its true size: a small one is broadcast by
Spark's own threshold, a large one is joined by shuffle. Executors may be lost at
any time without losing it, because it lies in the cluster's checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

_written: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the session's warehouse.

    A warehouse on a machine's own disk is shared with nobody: it serves a local master only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    if (warehouse.startswith("file:") or warehouse.startswith("/")) and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_settled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a table read from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key``, sorted, and return it as a table read from there.

    Each bucket is one file, made by one shuffle. Later joins and aggregates on ``key`` do not
    shuffle this side again: what it meets is dealt into its buckets. ``buckets`` is the number
    of shuffle partitions if not given; a table of many terabytes wants it stated. The table lives in the
    session's catalog until ``release``.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}", f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.repartition(count, key).write.format("parquet").bucketBy(count, key).sortBy(key).option("path", path).saveAsTable(table))
    _written.append(path)
    _tables.append(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Delete what ``settle`` and ``bucketed`` have written in this process; results that read it must be done."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _numbered(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds ``_local``, the rank among the rows with equal ``by`` in this sorted partition, and its number ``_slice``."""
    slice_no, last, met = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(c)) for c in by]
        first = tuple(c[0].as_py() for c in columns)
        new = np.zeros(n, bool)
        for c in columns:
            code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, 0))
        local = at - start + np.where(start == 0, met if first == last else 0, 0)
        last, met = tuple(c[n - 1].as_py() for c in columns), int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(local, pa.int64()), pa.array(np.full(n, slice_no, np.int32))], [*batch.schema.names, "_local", "_slice"])


def with_position(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Add ``name``: 0-based rank of each row within ``by``, in ``order``.

    ``order`` must be unique within ``by``, or rows that tie are dealt ranks as they come. Rows are
    shuffled once, range-partitioned on the whole key, so one huge group spreads over many tasks;
    each numbers its own sorted slice as it streams through, and a slice's start is the row count
    of the slices before it. Only the first group of a slice can have begun earlier, so the table
    of starts has at most one row per partition and is safe to broadcast.
    """
    keys = [*by, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = StructType([*ranged.schema.fields, StructField("_local", LongType()), StructField("_slice", IntegerType())])
    sliced = settle(ranged.mapInArrow(lambda batches: _numbered(batches, by), kind), "slices")
    sizes = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(sizes.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col("_slice").alias("_k_slice"),
        F.sum("_rows").over(before).alias("_start"),
    ).filter("_start > 0"), "slice-starts")
    match: Column = F.col("_slice") == F.col("_k_slice")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return sliced.join(F.broadcast(starts), match, "left").select(
        *df.columns, (F.col("_local") + F.coalesce("_start", F.lit(0))).cast("long").alias(name))


def require_none(problems: DataFrame, error: type[Exception], what: str) -> None:
    """Raise ``error`` naming a few offending rows, if there are any."""
    found = problems.limit(5).collect()
    if found:
        raise error(f"{what}: " + "; ".join(str(r.asDict()) for r in found))
