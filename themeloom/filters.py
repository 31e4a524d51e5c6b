"""A bounded filter of keys that prunes rows before they are shuffled.

Two bits per key are set in one 4 KB block of a bitmap. The blocks are a table of at most
``MAX_BITS / 8`` bytes, so it is safe to broadcast whatever it was built from. Beyond some
millions of keys more rows pass than need to, never fewer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.storage import settle

BITS_PER_KEY, MAX_BITS = 16, 1 << 28
#: Fixed value: bits of one block of the bitmap functions.
BLOCK_BITS = 32_768


def _bits(key: Column, blocks: int) -> list[Column]:
    h = F.xxhash64(F.lit("filter"), key)
    return [F.pmod(F.shiftright(h, 30), F.lit(blocks)).cast("int").alias("_block"),
            h.bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("_bit1"),
            F.shiftright(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("_bit2")]


def flagged(df: DataFrame, key: str, keys: DataFrame, count: int, name: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with ``name``: whether its ``key`` is, or may be, in the only column of ``keys``, which has about ``count`` rows.

    False is certain. Null keys are not in it. The rows are not shuffled.
    """
    bits = min(max_bits, max(BLOCK_BITS, 1 << math.ceil(math.log2(BITS_PER_KEY * max(count, 1)))))
    blocks = bits // BLOCK_BITS
    own = keys.columns[0]
    table = settle(
        keys.filter(F.col(own).isNotNull()).select(*_bits(F.col(own), blocks))
        .select("_block", F.explode(F.array("_bit1", "_bit2")).alias("_bit"))
        .groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_set")), "key-filter")

    def is_set(bit: str) -> Column:
        at = F.substring("_set", F.expr(f"cast({bit} div 8 as int)") + 1, 1)
        return F.getbit(F.conv(F.hex(at), 16, 10).cast("int"), F.expr(f"cast({bit} % 8 as int)")) == 1

    tested = df.select(*df.columns, *_bits(F.col(key), blocks)).join(F.broadcast(table), "_block", "left")
    found = F.col(key).isNotNull() & F.coalesce(is_set("_bit1") & is_set("_bit2"), F.lit(False))
    return tested.select(*df.columns, found.alias(name))


def among(df: DataFrame, key: str, keys: DataFrame, count: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is, or may be, in ``keys``."""
    return flagged(df, key, keys, count, "_among", max_bits).filter("_among").drop("_among")
