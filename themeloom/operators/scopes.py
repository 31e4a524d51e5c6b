"""What an analysis covers: one product, one category, or all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.model import DateWindow, SelectionError
from themeloom.storage import settle

PRODUCT = "product"
CATEGORY = "category"


def in_window(reviews: DataFrame, window: DateWindow | None) -> DataFrame:
    """Rows dated inside the window; without a window every row stays.

    The test is a plain range on the date column, so it reaches a Parquet scan.
    """
    if window is None:
        return reviews
    return reviews.filter(F.col("review_date").between(F.lit(window.start), F.lit(window.end)))


def select_product(
    reviews: DataFrame, products: DataFrame, product_id: str, window: DateWindow | None = None
) -> DataFrame:
    if products.filter(F.col("product_id") == product_id).isEmpty():
        raise SelectionError(f"unknown product {product_id}")
    return in_window(reviews.filter(F.col("product_id") == product_id), window)


def select_category(
    reviews: DataFrame, products: DataFrame, category: str, window: DateWindow | None = None
) -> DataFrame:
    """Rows of every product whose top category matches.

    The product's category decides, not the row's own. The ids are written out
    first, so Spark knows their size and broadcasts them only when they are small.
    """
    ids = settle(products.filter(F.col("top_category") == category).select("product_id"), "category_ids")
    if ids.isEmpty():
        raise SelectionError(f"unknown category {category}")
    return in_window(reviews, window).join(ids, "product_id", "left_semi")


def selection_order() -> list[str]:
    """Sort keys of a selection: oldest first, undated before dated, then file order."""
    return ["review_date", "row_pos"]


def scope_list(products: DataFrame) -> DataFrame:
    """Every scope that can be asked for: each product and each top category."""
    by_product = products.select(
        F.lit(PRODUCT).alias("scope_kind"), F.col("product_id").alias("scope_key"),
        F.col("name").alias("subject"),
    )
    by_category = products.filter("top_category <> ''").select(
        F.lit(CATEGORY).alias("scope_kind"), F.col("top_category").alias("scope_key"),
        F.col("top_category").alias("subject"),
    ).distinct()
    return by_product.unionByName(by_category)


def expand_scopes(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Each row once under its product and once under its product's category.

    Meant for narrow rows (ids, dates, counts). ``rows`` is planned only once, so
    whatever it read is read once. A blank top category gives no category scope.
    """
    keyed = products.select("product_id", "top_category")
    scopes = F.array(
        F.struct(F.lit(PRODUCT).alias("kind"), F.col("product_id").alias("key")),
        F.struct(F.lit(CATEGORY).alias("kind"), F.col("top_category").alias("key")),
    )
    return rows.join(keyed, "product_id").select(*rows.columns, F.explode(scopes).alias("_s")).select(
        F.col("_s.kind").alias("scope_kind"), F.col("_s.key").alias("scope_key"), *rows.columns
    ).filter((F.col("scope_kind") == PRODUCT) | (F.col("scope_key") != ""))


def in_scopes(per_product: DataFrame, products: DataFrame) -> DataFrame:
    """Per-product figures under both scopes, ready to be summed per scope."""
    return expand_scopes(per_product, products).drop("product_id")


def unknown_scopes(requested: DataFrame, products: DataFrame) -> DataFrame:
    """Requested scopes (scope_kind, scope_key) that do not exist."""
    return requested.join(scope_list(products), ["scope_kind", "scope_key"], "left_anti")


def partition_problems(selections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows that the category selections miss or hold more than once."""
    chosen = selections.groupBy("review_id").agg(F.count("*").alias("times"))
    return (
        reviews.select("review_id").join(chosen, "review_id", "full_outer")
        .select("review_id", F.coalesce("times", F.lit(0)).alias("times"))
        .filter("times <> 1")
    )
