"""Exact duplicates by two passes over a Bloom filter, with DataFrame functions only.

Pass 1 sets two bits per text hash and notes the bits that were set more than once. Pass 2 tests
every row: a row whose bits were both set again is *possibly* repeated. Only those rows are
shuffled and compared by SHA-256; all others pass straight through as texts of their own.

The filter is a table of 4 KB blocks. It grows with the number of rows up to ``MAX_BITS``, which
bounds what is broadcast (32 MB); beyond that more rows are possibly repeated and shuffle, and
the result stays the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import filled
from themeloom.storage import settle

BITS_PER_ROW, MAX_BITS = 16, 1 << 28
#: Fixed value: bits of one block of the bitmap functions.
BLOCK_BITS = 32_768


def digest(text: str = "text") -> Column:
    """SHA-256, in hex, of a text whose runs of ASCII white space are replaced by one space; null is empty."""
    return F.sha2(F.regexp_replace(filled(text), r"[\x20\x09-\x0D]+", " "), 256)


def _bits(sha: str, blocks: int) -> list[Column]:
    """Block and the two bits in it of a digest."""
    h = F.xxhash64(sha)
    return [F.pmod(F.shiftright(h, 30), F.lit(blocks)).cast("int").alias("_block"),
            h.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int").alias("_bit1"),
            F.shiftright(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int").alias("_bit2")]


def bloom(hashes: DataFrame, sha: str, rows: int, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """Pass 1: the blocks of bits that were set more than once, and how many blocks there are in all."""
    bits = min(max_bits, max(BLOCK_BITS, 1 << math.ceil(math.log2(BITS_PER_ROW * max(rows, 1)))))
    blocks = bits // BLOCK_BITS
    again = (hashes.select(*_bits(sha, blocks))
             .select("_block", F.explode(F.array_distinct(F.array("_bit1", "_bit2"))).alias("_bit"))
             .groupBy("_block", "_bit").count().filter("count > 1"))
    table = again.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_again"))
    return settle(table, "bloom"), blocks


def possibly_repeated(df: DataFrame, sha: str, again: DataFrame, blocks: int) -> DataFrame:
    """Pass 2: ``df`` with the column ``_maybe``; false is certain, true is not."""
    def is_set(bit: str) -> Column:
        at = F.substring("_again", F.expr(f"{bit} div 8") + 1, 1)
        return F.getbit(F.conv(F.hex(at), 16, 10).cast("int"), F.expr(f"{bit} % 8")) == 1

    bits = df.select(*df.columns, *_bits(sha, blocks))
    # At most MAX_BITS / 8 bytes.
    joined = bits.join(F.broadcast(again), "_block", "left")
    maybe = F.coalesce(is_set("_bit1") & is_set("_bit2"), F.lit(False))
    return joined.select(*df.columns, maybe.alias("_maybe"))


def groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The smallest ``doc_id`` of equal texts stays, null after all
    others; of repeated rows with that id exactly one. Other columns are not carried; an empty
    table gives no rows.
    """
    rows = settle(df.select(F.col(doc_id).alias("doc_id"), digest(text).alias("text_sha256"),
                            F.monotonically_increasing_id().alias("_row")), "text-digests")
    again, blocks = bloom(rows, "text_sha256", rows.count(), max_bits)
    marked = possibly_repeated(rows, "text_sha256", again, blocks)
    maybe, single = marked.filter("_maybe"), marked.filter("NOT _maybe")
    found = settle(
        maybe.groupBy("text_sha256").agg(
            F.count("*").alias("_size"),
            F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row")).alias("_first"))
        .filter("_size > 1").withColumnRenamed("text_sha256", "_sha"), "equal-texts")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = dict(keep_id=F.col("doc_id"), group_size=F.lit(1).cast("long"), kept=F.lit(True))
    one_of = maybe.join(found, F.col("text_sha256") == F.col("_sha"), "left")
    grouped = F.col("_sha").isNotNull()
    return single.withColumns(alone).select(*out).unionByName(one_of.withColumns(dict(
        keep_id=F.when(grouped, F.col("_first.doc_id")).otherwise(F.col("doc_id")),
        group_size=F.coalesce("_size", F.lit(1)).cast("long"),
        kept=F.when(grouped, F.col("_row") == F.col("_first._row")).otherwise(True))).select(*out))


def first_of_equal(df: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; which ones, as in ``groups``.

    Whole rows are shuffled only if possibly repeated, and each task first reduces its own. Among
    rows with the same text and id, the smallest in the order of its columns stays.
    """
    hashes = settle(df.select(digest(text).alias("_sha")), "text-digests")
    again, blocks = bloom(hashes, "_sha", hashes.count(), max_bits)
    marked = possibly_repeated(df.withColumn("_sha", digest(text)), "_sha", again, blocks)
    row = F.struct(F.isnull(doc_id).alias("_none"), F.col(doc_id).alias("_id"), F.struct(*df.columns).alias("_all"))
    stay = marked.filter("_maybe").groupBy("_sha").agg(F.min(row).alias("_row"))
    return marked.filter("NOT _maybe").select(*df.columns).unionByName(stay.select("_row._all.*"))


ORACLE = r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
    FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, h AS text_sha256
FROM hashed WINDOW same AS (PARTITION BY h)
"""
