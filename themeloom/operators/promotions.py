"""Promoted purchases against full-price ones, per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.numbers import mean_to_tenth, one_decimal, round_half_up
from themeloom.functions.text import blank_to_null
from themeloom.model import DateWindow
from themeloom.operators.scopes import in_scopes, in_window
from themeloom.storage import settle

# Fixed value: a smaller difference of means counts as none.
MEANINGFUL_DELTA = 0.1


def is_promoted() -> Column:
    """A promotion label, or a discount above zero."""
    return blank_to_null(F.col("promotion")).isNotNull() | F.coalesce(
        F.col("discount_percent") > 0, F.lit(False))


def promotion_labels(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct promotion labels per scope, one row each."""
    per_product = reviews.select(
        "product_id", blank_to_null(F.col("promotion")).alias("promotion")
    ).filter("promotion is not null").distinct()
    return in_scopes(per_product, products).distinct()


def relation_note() -> Column:
    promoted = one_decimal(F.col("promo_average"))
    full = one_decimal(F.col("full_price_average"))
    gap = one_decimal(F.abs("rating_delta"))
    noun = F.when(F.col("promo_count") == 1, "review").otherwise("reviews")
    moved = lambda word: F.concat(
        F.lit("Bought on promotion: "), promoted, F.lit("★, which is "), gap,
        F.lit(f"★ {word} than at full price ("), full, F.lit("★)."))
    return (
        F.when(~F.col("comparable"), F.concat(
            F.lit("Every purchase here was promoted ("), F.col("promo_count").cast("string"),
            F.lit(" "), noun, F.lit(", mean "), promoted, F.lit("★); nothing at full price to compare.")))
        .when(F.col("rating_delta") >= MEANINGFUL_DELTA, moved("higher"))
        .when(F.col("rating_delta") <= -MEANINGFUL_DELTA, moved("lower"))
        .otherwise(F.concat(
            F.lit("Promotion makes no visible difference: "), promoted, F.lit("★ against "), full,
            F.lit("★ at full price.")))
    )


def promotions(
    reviews: DataFrame, products: DataFrame, window: DateWindow | None = None
) -> DataFrame:
    """One row per scope that has a promoted purchase.

    Counts are hash-aggregated per product and summed per category. Labels are made
    distinct before they are listed, so a list holds labels, never rows, and every scope
    lists all of its labels; ``promotion_labels`` holds them as rows.
    """
    # One pass over the rows; what follows reads a row per product, label and kind of purchase.
    cells = settle(
        in_window(reviews, window).select(
            "product_id", "rating", blank_to_null(F.col("promotion")).alias("promotion"), is_promoted().alias("_promo"))
        .groupBy("product_id", "promotion", "_promo").agg(F.count("*").alias("n"), F.sum("rating").alias("stars")),
        "promotion_cells")
    part = lambda promo, c: F.sum(F.when(F.col("_promo") == promo, F.col(c)).otherwise(0))
    per_product = cells.groupBy("product_id").agg(
        part(True, "n").alias("promo_count"), part(False, "n").alias("full_price_count"),
        part(True, "stars").alias("_promo_stars"), part(False, "stars").alias("_full_stars"),
    )
    sums = ("promo_count", "full_price_count", "_promo_stars", "_full_stars")
    merged = in_scopes(per_product, products).groupBy("scope_kind", "scope_key").agg(
        *[F.sum(c).alias(c) for c in sums])
    compared = (
        merged.filter("promo_count > 0")
        .withColumns({
            "promo_average": mean_to_tenth(F.col("_promo_stars"), F.col("promo_count")),
            "full_price_average": mean_to_tenth(F.col("_full_stars"), F.col("full_price_count")),
            "comparable": F.col("full_price_count") > 0,
        })
        .withColumn("rating_delta", F.when(
            F.col("comparable"),
            round_half_up(F.col("promo_average") - F.col("full_price_average"), 1),
        ).otherwise(F.lit(0.0)))
        .withColumn("note", relation_note())
        .drop("_promo_stars", "_full_stars")
    )
    every = promotion_labels(cells, products)
    lists = every.groupBy("scope_kind", "scope_key").agg(
        F.array_sort(F.collect_list(F.collate("promotion", "UNICODE"))).alias("_labels"))
    labels = lists.select(
        "scope_kind", "scope_key",
        F.transform("_labels", lambda x: F.collate(x, "UTF8_BINARY")).alias("promotions"))
    none = F.array().cast("array<string>")
    return (
        compared.join(labels, ["scope_kind", "scope_key"], "left")
        .withColumn("promotions", F.coalesce("promotions", none))
        .withColumn("label_count", F.size("promotions").cast("long"))
    )
