"""Rule engine: keyword themes, polarity by rating, counts and quotes.

Text is read once, and never shuffled: what leaves the map side are ids, themes and numbers, one
row per review and keyword found. Products are counted first and categories are sums over products,
so no review row is joined to a product, and a product or category holding a third of all rows is
reduced inside the map tasks before its figures are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.numbers import mean_to_tenth, share_percent
from themeloom.filters import among
from themeloom.functions.text import attribution, first_sentence_with, sentences
from themeloom.model import DateWindow, Theme, Unit
from themeloom.operators.scopes import in_scopes, in_window
from themeloom.operators.vocabulary import Index, indexed, matched
from themeloom.storage import settle

POSITIVE = "positive"
NEGATIVE = "negative"

# Layout of the pick order: fewest missing hits, then rating, then day, in one BIGINT.
_MOST_HITS = 1 << 15
_DAY_BITS = 22
_RATING_BITS = 3
_DAY_SHIFT = 719_163


def polarity(rating: Column) -> Column:
    """Four stars and more praise, two and fewer fault, three neither."""
    return F.when(rating >= 4, POSITIVE).when(rating <= 2, NEGATIVE)


def theme_hits(rows: DataFrame, vocabulary: Sequence[Theme] | Index) -> DataFrame:
    """One row per row and theme that it mentions: all columns but ``text``, ``theme`` and ``n``.

    ``theme`` is the position in the vocabulary and ``n`` the number of its distinct keywords in the
    text. Rows that are equal in all columns but the text count as one: give them a number.
    """
    kept = [c for c in rows.columns if c != "text"]
    return matched(rows, indexed(rows.sparkSession, vocabulary)).groupBy(*kept, "theme").agg(F.count("*").cast("int").alias("n"))


def _pick_order(hits: Column, rating: Column, day: Column) -> Column:
    """Smaller is better: most keyword hits, strongest rating, earliest day."""
    strength = F.when(rating >= 4, 5 - rating).otherwise(rating - 1)
    days = F.coalesce(F.unix_date(day) + _DAY_SHIFT, F.lit(0))
    packed = F.shiftleft((F.lit(_MOST_HITS) - hits).cast("long"), _RATING_BITS) + strength
    return F.shiftleft(packed, _DAY_BITS) + days


def mentions(reviews: DataFrame, vocabulary: Sequence[Theme] | Index) -> DataFrame:
    """One row per review and mentioned theme with a polarity; no text."""
    polar = reviews.select("row_pos", "product_id", "review_date", "rating", "text").filter("rating <> 3")
    return theme_hits(polar, vocabulary).select(
        "product_id",
        "theme",
        polarity(F.col("rating")).alias("polarity"),
        _pick_order(F.col("n"), F.col("rating"), F.col("review_date")).alias("pick"),
        "row_pos",
        F.lit(1).cast("long").alias("mentions"),
    )


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions and best row per key, by two hash aggregates on fixed-width values.

    The first also groups by the pick order: it spreads a hot key over many tasks
    and leaves at most one row per distinct order for the second.
    """
    by_order = rows.groupBy(*keys, "pick").agg(
        F.sum("mentions").alias("mentions"), F.min("row_pos").alias("row_pos"))
    return by_order.groupBy(*keys).agg(
        F.sum("mentions").alias("mentions"),
        F.min_by("row_pos", "pick").alias("row_pos"),
        F.min("pick").alias("pick"),
    )


def scope_tallies(mentioned: DataFrame, products: DataFrame) -> DataFrame:
    """Mentions and representative row per (scope, theme, polarity), every scope."""
    per_product = _fold(mentioned, ["product_id", "theme", "polarity"])
    return _fold(in_scopes(per_product, products), ["scope_kind", "scope_key", "theme", "polarity"])


def scope_totals(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Selected rows, rating sum and dated rows per scope, counted once per product."""
    per_product = reviews.groupBy("product_id").agg(
        F.count("*").alias("selected"),
        F.sum("rating").alias("stars"),
        F.count("review_date").alias("dated"),
    )
    return in_scopes(per_product, products).groupBy("scope_kind", "scope_key").agg(
        *[F.sum(c).alias(c) for c in ("selected", "stars", "dated")])


def selection_summary(totals: DataFrame) -> DataFrame:
    """Selected rows and mean rating to one decimal."""
    return totals.select(
        "scope_kind", "scope_key", F.col("selected").alias("review_count"),
        mean_to_tenth(F.col("stars"), F.col("selected")).alias("average_rating"),
    )


def enough_evidence(unit: Unit) -> Column:
    return F.col("mentions") >= unit.min_evidence


def ranked(findings: DataFrame) -> DataFrame:
    """Position within scope and polarity: mentions first, then label in locale order.

    The window runs on finished findings, at most one per theme.
    """
    order = Window.partitionBy("scope_kind", "scope_key", "polarity").orderBy(
        F.col("mentions").desc(), F.collate("label", "UNICODE"), "label")
    return findings.withColumn("rank", F.row_number().over(order))


def findings(
    reviews: DataFrame, products: DataFrame, vocabulary: Sequence[Theme] | Index, unit: Unit,
    window: DateWindow | None = None, totals: DataFrame | None = None,
) -> DataFrame:
    """Ranked findings of every scope, with the representative row but no quote."""
    selected, index = in_window(reviews, window), indexed(reviews.sparkSession, vocabulary)
    tallies = scope_tallies(mentions(selected, index), products).filter(enough_evidence(unit))
    if totals is None:
        totals = scope_totals(selected, products)
    counted = totals.select("scope_kind", "scope_key", "selected")
    named = index.themes.select("theme", "theme_key", "label")
    supported = tallies.join(counted, ["scope_kind", "scope_key"]).join(named, "theme").select(
        "scope_kind", "scope_key", "polarity", "theme", "theme_key", "label", "mentions",
        share_percent(F.col("mentions"), F.col("selected")).alias("percent"),
        "selected",
        "row_pos",
    )
    return ranked(supported)


def quotes_of(rows: DataFrame, index: Index) -> DataFrame:
    """row_pos, theme, quote, review_id and whom it is credited to, of every theme that a row mentions. No text leaves the map side."""
    held = rows.select("row_pos", "review_id", "text", "author", "verified", "country")
    found = matched(held, index).join(F.broadcast(index.themes.select("theme", "any_keyword")), "theme")
    return found.select(
        "row_pos", "theme", first_sentence_with(sentences(F.col("text")), F.col("text"), F.col("any_keyword")).alias("quote"), "review_id",
        attribution(F.col("author"), F.col("verified"), F.col("country")).alias("quote_author"))


def with_quotes(found: DataFrame, reviews: DataFrame, vocabulary: Sequence[Theme] | Index) -> DataFrame:
    """Add the quote and its attribution.

    The findings are written out first. A filter of their row numbers prunes the reviews as they
    are read, and sentences are cut there; only quotes meet the findings.
    """
    index, held = indexed(found.sparkSession, vocabulary), settle(found, "findings")
    rows = among(reviews, "row_pos", held.select("row_pos"), held.count())
    # A theme is met once for each of its keywords in a row; the quote is the same.
    quotes = settle(quotes_of(rows, index).join(held.select("row_pos", "theme").distinct(), ["row_pos", "theme"]).distinct(), "quotes")
    return held.join(quotes, ["row_pos", "theme"]).select(*found.columns, "review_id", "quote", "quote_author")


def recommendations(found: DataFrame, vocabulary: Sequence[Theme] | Index) -> DataFrame:
    """Advice for each fault, in fault order; themes without advice give none."""
    advice = indexed(found.sparkSession, vocabulary).themes.select("theme", "advice").filter("advice is not null")
    return found.filter(F.col("polarity") == NEGATIVE).join(advice, "theme").select("scope_kind", "scope_key", "rank", "advice")


def combined_themes(found: DataFrame) -> DataFrame:
    """Praise and faults in one list per scope, most mentioned first."""
    order = Window.partitionBy("scope_kind", "scope_key").orderBy(
        F.col("mentions").desc(), F.collate("label", "UNICODE"), "label",
        F.when(F.col("polarity") == POSITIVE, 0).otherwise(1))
    return found.withColumn("overall_rank", F.row_number().over(order))
