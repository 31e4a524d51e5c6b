"""Accepting and rejecting raw rows, and the dimension and counts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.filters import flagged
from themeloom.functions.category import leaf_category, top_category
from themeloom.functions.dates import strict_date
from themeloom.functions.numbers import exact_stars, valid_discount, without_percent
from themeloom.functions.text import blank_to_null, trimmed
from themeloom.model import InputError, PRODUCT_RECORD, REVIEW, Unit
from themeloom.sources.files import PRODUCT_EXPORT
from themeloom.storage import settle


def classify(raw: DataFrame) -> DataFrame:
    """Typed rows with ``reject_reason``, NULL where the row is accepted.

    An id counts as taken by its first *accepted* row: a bad first copy does not
    block a good second one, and any later copy is a duplicate whatever else is
    wrong with it. The cells are parsed once, and the typed rows written with their own
    reason. Only ids that occur more than once matter; those are found from the narrow
    columns alone. A bounded filter of them then tells which rows to match, and only
    these are joined: rows of an id that occurs once pass straight through, text and all.
    Rows without an id are never matched, so a mass of blank ids loads no single task.
    """
    names = ("review_id", "product_id", "product_name", "category", "review_text")
    rest = [c for c in raw.columns if c not in names]
    cells = raw.select(*rest, *[trimmed(F.col(c)).alias(c) for c in names])
    numbers = cells.withColumns({
        "_discount": without_percent(F.col("discount_percent")),
        "_day": F.when(F.col("is_dated"), strict_date(F.col("review_date"))),
    })
    typed = numbers.select(
        "row_pos", "review_id", "product_id", "product_name",
        F.when(F.col("category") == "", "Uncategorized").otherwise(F.col("category")).alias("category"),
        exact_stars(F.col("stars_value")).alias("rating"),
        "source_rating",
        F.col("_day").alias("review_date"),
        F.col("review_text").alias("text"),
        blank_to_null(F.col("review_title")).alias("title"),
        F.lit(None).cast("string").alias("author"),
        F.when(F.col("has_verified"), trimmed(F.col("verified_purchase")) == "true").alias("verified"),
        blank_to_null(F.col("country")).alias("country"),
        blank_to_null(F.col("promotion")).alias("promotion"),
        valid_discount(F.col("discount_percent"), F.col("_discount")).alias("discount_percent"),
        "source",
        "is_dated",
        "source_reason",
    )
    own = (
        F.when(F.col("source_reason").isNotNull(), F.col("source_reason"))
        .when(F.col("review_id") == "", "missing_review_id")
        .when(F.col("product_id") == "", "missing_product_id")
        .when(F.col("is_dated") & F.col("review_date").isNull(), "invalid_date")
        .when(F.col("rating").isNull(), "invalid_rating")
        .when(F.col("text") == "", "missing_review_text")
    )
    judged = settle(typed.withColumn("_own", own), "typed-rows")
    taken = settle(
        judged.filter((F.col("review_id") != "") & F.col("source_reason").isNull())
        .groupBy("review_id")
        .agg(
            F.count("*").alias("_copies"),
            F.min(F.when(F.col("_own").isNull(), F.col("row_pos"))).alias("_taken_at"),
        )
        .filter("_copies > 1 and _taken_at is not null")
        .select(F.col("review_id").alias("_id"), "_taken_at"), "taken_ids")
    marked = flagged(judged, "review_id", taken.select("_id"), taken.count(), "_maybe")
    late = F.col("source_reason").isNull() & (F.col("row_pos") > F.col("_taken_at"))
    matched = marked.filter("_maybe and review_id <> ''").join(taken, F.col("review_id") == F.col("_id"), "left").withColumn(
        "reject_reason", F.when(late, "duplicate_review_id").otherwise(F.col("_own")))
    single = marked.filter("not _maybe or review_id = ''").withColumn("reject_reason", F.col("_own"))
    done = [*[c for c in typed.columns if c != "source_reason"], "reject_reason"]
    return single.select(*done).unionByName(matched.select(*done))


def load(raw: DataFrame) -> DataFrame:
    """Classified rows, which ``classify`` has written as columnar files.

    Every later step reads them several times: counts read narrow columns only, and
    the text is read once more for the quotes.
    """
    return classify(raw)


REVIEW_COLUMNS = (
    "row_pos", "review_id", "product_id", "review_date", "rating", "source_rating", "text",
    "category", "title", "author", "verified", "country", "promotion", "discount_percent", "source",
)


def accepted(classified: DataFrame) -> DataFrame:
    """The reviews; a row's own category is the leaf of its path."""
    return classified.filter("reject_reason is null").withColumns(
        {"category": leaf_category(F.col("category"))}
    ).select(*REVIEW_COLUMNS)


def rejected(classified: DataFrame) -> DataFrame:
    return classified.filter("reject_reason is not null").select(
        "row_pos", "review_id", "product_id", "reject_reason"
    )


def require_accepted(classified: DataFrame) -> None:
    if classified.filter("reject_reason is null").isEmpty():
        raise InputError("every row was rejected; count the reject reasons to see why")


def product_dimension(classified: DataFrame) -> DataFrame:
    """One row per product, named and categorised by its first accepted row.

    Names and categories are grouping keys of a first aggregate, so the wide scan
    is reduced by a hash aggregate before the first row is picked.
    """
    spellings = (
        classified.filter("reject_reason is null")
        .groupBy("product_id", "product_name", "category")
        .agg(F.min("row_pos").alias("row_pos"))
    )
    first = spellings.groupBy("product_id").agg(
        F.min_by(F.struct("product_name", "category"), "row_pos").alias("f")
    )
    return first.select(
        "product_id",
        F.when(F.col("f.product_name") == "", F.col("product_id"))
        .otherwise(F.col("f.product_name")).alias("name"),
        leaf_category(F.col("f.category")).alias("category"),
        top_category(F.col("f.category")).alias("top_category"),
    )


def load_stats(classified: DataFrame) -> DataFrame:
    """Rows read, accepted and skipped; the last two add up to the first."""
    return classified.agg(
        F.count("*").alias("parsed"),
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"),
    )


def skip_reasons(classified: DataFrame) -> DataFrame:
    return classified.filter("reject_reason is not null").groupBy("reject_reason").agg(
        F.count("*").alias("rows"))


def category_summary(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Products and rows per top category; products without one are left out."""
    rows = reviews.groupBy("product_id").agg(F.count("*").alias("_rows"))
    return (
        products.filter("top_category <> ''").join(rows, "product_id", "left")
        .groupBy(F.col("top_category").alias("category"))
        .agg(
            F.count("*").alias("product_count"),
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_count"),
        )
    )


def product_stats(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(
        F.count("*").alias("review_count"),
        F.min("review_date").alias("first_date"),
        F.max("review_date").alias("last_date"),
    )


def dataset_span(reviews: DataFrame) -> DataFrame:
    """First and last date, and whether every row is dated (false when empty)."""
    return reviews.agg(
        F.min("review_date").alias("first_date"),
        F.max("review_date").alias("last_date"),
        ((F.count("*") > 0) & (F.count("*") == F.count("review_date"))).alias("has_dates"),
    )


def rating_polarity(reviews: DataFrame) -> DataFrame:
    """How many rows lean each way: product averages hardly ever fall to two stars."""
    return reviews.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("rating") >= 4).alias("high_rows"),
        F.count_if(F.col("rating") <= 2).alias("low_rows"),
    )


def is_product_level(source: Column) -> Column:
    return source == PRODUCT_EXPORT


def unit_for(source: str) -> Unit:
    return PRODUCT_RECORD if source == PRODUCT_EXPORT else REVIEW
