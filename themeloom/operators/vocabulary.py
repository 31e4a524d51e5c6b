"""The vocabulary as an inverted index: keywords by the anchor word that a text must have.

A row's distinct words are looked up in the index, so neither the plan nor the work per row grows
with the vocabulary. A keyword of one plain word is found by that; a phrase is searched in the
text only where its anchor occurs, its word that the fewest keywords share.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.text import WHITESPACE, keyword_pattern, words_of
from themeloom.model import InputError, Theme

#: Masks of 64 bits that the words of a text must pass before they are looked up. They are part of the plan, and of
#: this size whatever the vocabulary; those of a large one let most words through, to the index itself.
MASKS = 4
#: Keywords that a vocabulary may have: it is a parameter that the driver holds, and is broadcast.
MAX_KEYWORDS = 1_000_000


@dataclass(frozen=True)
class Index:
    """``keywords`` (anchor, theme, pattern; none for a plain word) and ``themes`` (theme, theme_key, label, advice, any_keyword)."""

    keywords: DataFrame
    themes: DataFrame
    #: Whether some keyword is anchored at a character outside of ASCII words, or at none.
    marks: bool
    #: In each mask, a bit for six bits of the checksum of every anchor.
    masks: tuple[int, ...]


def _anchor(keyword: str, shared: Counter) -> str:
    """The word of a keyword that the fewest keywords share, the longest of these; a character where it has no words."""
    words = words_of(keyword)
    if words:
        return min(words, key=lambda w: (shared[w], -len(w), w))
    plain = keyword.strip(WHITESPACE).lower()
    fixed = [c for c in plain if not c.isspace() and len(c.upper()) == 1 and c.upper().lower() == c]
    return min(fixed, default="")


def indexed(spark: SparkSession, vocabulary: Sequence[Theme] | Index) -> Index:
    """The index of a vocabulary; blank keywords and repeated ones of a theme count once or not at all."""
    if isinstance(vocabulary, Index):
        return vocabulary
    if not vocabulary:
        raise InputError("the vocabulary is empty")
    usable = [[k for k in dict.fromkeys(t.keywords) if k.strip()] for t in vocabulary]
    if sum(map(len, usable)) > MAX_KEYWORDS:
        raise InputError(f"the vocabulary has more than {MAX_KEYWORDS} keywords")
    shared = Counter(w for keywords in usable for k in keywords for w in set(words_of(k)))
    rows = []
    for i, keywords in enumerate(usable):
        for k in keywords:
            plain = words_of(k) == [k.strip().lower()]
            rows.append((_anchor(k, shared), i, None if plain else keyword_pattern(k)))
    keywords = pa.table({"anchor": pa.array([r[0] for r in rows], pa.string()), "theme": pa.array([r[1] for r in rows], pa.int32()),
                         "pattern": pa.array([r[2] for r in rows], pa.string())})
    themes = pa.table({
        "theme": pa.array(range(len(vocabulary)), pa.int32()), "theme_key": pa.array([t.key for t in vocabulary], pa.string()),
        "label": pa.array([t.label for t in vocabulary], pa.string()),
        "advice": pa.array([t.recommendation or None for t in vocabulary], pa.string()),
        "any_keyword": pa.array([keyword_pattern(*t.keywords) for t in vocabulary], pa.string())})
    marks = any(not words_of(k) for ks in usable for k in ks)
    masks = [0] * MASKS
    for check in {zlib.crc32(anchor.encode()) for anchor, _, _ in rows}:
        for i in range(MASKS):
            masks[i] |= 1 << (check >> 6 * i & 63)
    signed = tuple(m - (1 << 64) if m >> 63 else m for m in masks)
    return Index(spark.createDataFrame(keywords), spark.createDataFrame(themes), marks, signed)


def tokens(text: Column, index: Index) -> Column:
    """What a text can be looked up by: its distinct ASCII words in lower case, and its other characters if anchors are such.

    Most words that no anchor equals fail the masks.
    """
    def may_be_known(w: Column) -> Column:
        check, out = F.crc32(w.cast("binary")), F.lit(True)
        for i, mask in enumerate(index.masks):
            bit = F.shiftright(check, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            out = out & (F.getbit(F.lit(mask).cast("long"), bit) == 1)
        return out

    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.lower(w))
    if index.marks:
        others = F.regexp_extract_all(F.concat(text, F.lower(F.upper(text))), F.lit(r"[^A-Za-z0-9\s]"), F.lit(0))
        words = F.concat(words, others, F.array(F.lit("")))
    return F.array_distinct(F.filter(words, may_be_known))


def matched(rows: DataFrame, index: Index) -> DataFrame:
    """``rows``, which have a ``text``, once for each keyword in it, with its ``theme``. Texts are not shuffled."""
    # An inner explode would copy the words into a pushed-down filter and make them twice per row;
    # the outer form is planned as written.
    each = rows.withColumn("_token", F.explode_outer(tokens(F.col("text"), index)))
    met = each.join(F.broadcast(index.keywords), F.col("_token") == F.col("anchor"))
    return met.filter(F.col("pattern").isNull() | F.rlike("text", F.col("pattern"))).drop("_token", "anchor", "pattern")
