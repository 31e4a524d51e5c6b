"""Text columns: trimming, label keys, keyword matching, quotes and phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a trimmed cell loses at both ends.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = (
    r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)


def trimmed(cell: Column) -> Column:
    """The cell without outer whitespace; a missing cell is the empty string."""
    return F.coalesce(F.btrim(cell, F.lit(WHITESPACE)), F.lit(""))


def blank_to_null(cell: Column) -> Column:
    return F.nullif(trimmed(cell), F.lit(""))


def single_spaced(cell: Column) -> Column:
    """Trimmed, with every inner run of whitespace as one space."""
    return F.regexp_replace(trimmed(cell), SPACE_CLASS + "+", " ")


def label_key(label: Column) -> Column:
    """Grouping key of a theme label: case and spacing ignored, nothing else."""
    return F.lower(single_spaced(label))


# -- keywords -----------------------------------------------------------------


def keyword_pattern(*keywords: str) -> str:
    """Java pattern: any of the keywords, not touching an ASCII letter or digit."""
    # What may not stand on either side of a keyword.
    parts = []
    for keyword in keywords:
        plain = keyword.strip(WHITESPACE).lower()
        if plain:
            quoted = re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", plain)
            parts.append(quoted if plain.isascii() else f"(?iu:{quoted})")
    if not parts:
        return "(?!)"
    return f"(?i)(?:^|[^a-z0-9])(?:{'|'.join(parts)})(?![a-z0-9])"


def matches_keyword(text: Column, keyword: str) -> Column:
    """Whole-word, case-insensitive occurrence of a keyword or phrase."""
    return text.rlike(keyword_pattern(keyword))


def words_of(keyword: str) -> list[str]:
    """ASCII words of a keyword; each must occur in a text that contains it."""
    return re.findall(r"[a-z0-9]+", keyword.strip(WHITESPACE).lower())


# -- quotes -------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Pieces of a text, each keeping its closing punctuation."""
    # Fixed value: where a piece ends.
    return F.split(text, "(?<=[.!?])" + SPACE_CLASS + "+")


def first_sentence_with(pieces: Column, text: Column, keywords: list[str] | Column) -> Column:
    """The first piece holding a keyword, or the whole text. ``keywords`` are a list, or a column of their pattern."""
    pattern = keywords if isinstance(keywords, Column) else F.lit(keyword_pattern(*keywords))
    hits = F.filter(pieces, lambda s: F.rlike(s, pattern))
    return trimmed(F.coalesce(F.try_element_at(hits, F.lit(1)), text))


def attribution(author: Column, verified: Column, country: Column) -> Column:
    """Who a quote is credited to."""
    # The words of a credit and the mark between them.
    buyer = F.when(verified, "Verified buyer").otherwise("Buyer")
    with_country = F.when(
        F.coalesce(country, F.lit("")) != "", F.concat(buyer, F.lit(" · "), country)
    ).otherwise(buyer)
    return F.coalesce(F.nullif(author, F.lit("")), with_country)


# -- phrases ------------------------------------------------------------------


def lower_first(label: Column) -> Column:
    """Label for use inside a sentence: "USB port" stays, "Sound" becomes "sound"."""
    first_word = F.split(label, SPACE_CLASS, 2)[0]
    technical = F.substring(first_word, 2, 2**30).rlike("[A-Z]")
    lowered = F.concat(F.lower(F.substring(label, 1, 1)), F.substring(label, 2, 2**30))
    return F.when(technical, label).otherwise(lowered)
