"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

The binary digits of a document's number of tokens say how it is cut: into pieces of
``capacity`` as long as there are that many, then one piece for each one-bit of the rest, longest
first. Every piece is a sequence of its own. Equal lengths form a bucket, whose sequences have
consecutive numbers, so a bucket is a range of ``sequence_id`` that a training job reads as
batches of one shape.

Sequences are numbered without moving a row: each task counts its own pieces of each length, and
a piece's number is its bucket's start, plus the pieces of that length in tasks before, plus its
rank in its own task. Only the counts, one per task and length, are summed up; they are joined
by their true size, broadcast or shuffled as Spark sees fit.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.batch_bpe import loaded, runs
from themeloom.llm.batches import bounded, filled
from themeloom.storage import settle

CAPACITY, END_OF_TEXT = 2048, 1
#: Code points of the texts that are encoded at once.
TOGETHER = 1 << 22
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"
_NAMES = PIECE.replace(",", "").split()[::2]


def lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``total`` tokens, in text order; ``capacity`` is a power of two."""
    whole, rest = divmod(total, capacity)
    return [capacity] * whole + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pieces(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document, with the task that cut them and their rank among its pieces of equal length."""
    bounded(df.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end, task = loaded(path), struct.pack("<I", END_OF_TEXT), TaskContext.get().partitionId()
        met: dict[int, int] = {}
        for batch in batches:
            rows, keys = [], iter(batch["doc_id"].astype("Int64").array)
            for run in runs(batch["text"].tolist(), TOGETHER):
                for ids, key in zip(coder.encode_all(run), keys, strict=False):  # ids first: a run takes its own keys only
                    ids += end
                    total, start = len(ids) // 4, 0
                    for n in lengths(total, capacity):
                        rank = met.get(n, 0)
                        met[n] = rank + 1
                        rows.append((key, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), total, task, rank))
                        start += n
            yield pd.DataFrame(rows, columns=_NAMES).astype({"doc_id": "Int64"})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text")).mapInPandas(cut, PIECE)


def pack(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids, then the end-of-text id; null text counts as empty (one token). A null or
    repeated ``doc_id`` is kept, each row being a document of its own; other columns are not carried;
    an empty table gives no rows. Longest sequences have the lowest numbers, which run from 0
    without gaps; ``offset`` is always 0. Which number a piece has within its bucket depends on how
    the table is partitioned.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    cut = settle(pieces(df, path, text, doc_id, capacity), "binary-pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("_n"))
    # Starts of tasks within each length, then of lengths: neither window sees more than one row per task or length.
    tasks = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("_length")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_in_length", F.coalesce(F.sum("_n").over(tasks), F.lit(0)))
    buckets = counts.groupBy(F.col("length").alias("_length")).agg(F.sum("_n").alias("_all")).select(
        "_length", F.coalesce(F.sum("_all").over(longer), F.lit(0)).alias("_bucket"))
    first = settle(starts.join(buckets, F.col("length") == F.col("_length")).select(
        F.col("_length"), F.col("task").alias("_task"), (F.col("_bucket") + F.col("_in_length")).alias("_first")), "binary-starts")
    return (cut.join(first, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("_first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
