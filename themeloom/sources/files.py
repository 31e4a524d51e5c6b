"""Review files, product exports and their column-pruned copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions.category import category_path
from themeloom.functions.numbers import amount, strict_number, whole_stars
from themeloom.functions.text import WHITESPACE, trimmed
from themeloom.model import InputError
from themeloom.storage import settle

# The columns of the two accepted file shapes.
REVIEW_REQUIRED = ("review_id", "product_id", "product_name", "category", "rating", "review_text")
REVIEW_OPTIONAL = (
    "review_date", "review_title", "country", "promotion", "verified_purchase", "discount_percent",
)
EXPORT_REQUIRED = ("product_id", "product_name", "category", "rating", "review_content")
EXPORT_KEPT = (
    "product_id", "product_name", "category", "discounted_price", "actual_price",
    "discount_percentage", "rating", "rating_count", "review_content",
)

UPLOADED = "uploaded"
PRODUCT_EXPORT = "product_export"
SAMPLE = "sample"
# Fixed value: the id of a record of an export.
RECORD_ID_FORMAT = "amz-%04d"


def read_table(df: DataFrame, order: str) -> DataFrame:
    """Rows of a table (Parquet, say) with the caller's unique BIGINT file-order column."""
    if order not in df.columns:
        raise InputError(f"ordering column {order} is missing; row order is part of the input")
    return df.withColumnRenamed(order, "row_pos")


#: File splits whose places are broadcast, at 16 bytes each; those of more files are joined by their size.
MAX_SPLITS = 1 << 20


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Text cells of one or many CSV files, with trimmed header names and ``row_pos``.

    ``row_pos`` counts data rows from 1, file after file in path order. The files are read once:
    rows are written out as columns with the file split they came from and their place in the scan;
    where each split starts is then known from these two numbers alone. A file whose cells hold no line
    breaks can be split among tasks: ``multi_line=False``.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if not raw.columns:
        raise InputError("the file is empty")
    names = [c.strip(WHITESPACE) for c in raw.columns]
    if len(set(names)) != len(names):
        raise InputError("the header repeats a column name")
    held = settle(raw.select(
        *[F.col(f"`{old}`").alias(new) for old, new in zip(raw.columns, names)],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    ), "csv-rows")
    splits = held.groupBy("_file", "_block").agg(
        F.count("*").alias("_rows"), F.min("_seen").alias("_first")
    )
    # A split lies in one task of the scan, whose numbers ascend through it without a gap. One row per split.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(splits.select(
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.xxhash64("_file", "_block").alias("_split")), "csv-splits")
    if starts.select("_split").distinct().count() < (count := starts.count()):
        raise InputError("two file splits have the same hash")
    small = F.broadcast(starts) if count <= MAX_SPLITS else starts
    return held.withColumn("_key", F.xxhash64("_file", "_block")).join(small, F.col("_key") == F.col("_split")).select(
        *names, (F.col("_seen") + F.col("_shift")).alias("row_pos"))


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def as_reviews(raw: DataFrame) -> DataFrame:
    """Raw review rows: required columns checked, absent optional ones as NULL."""
    lacking = missing_columns(raw, REVIEW_REQUIRED)
    if lacking:
        raise InputError("missing required columns: " + ", ".join(lacking))
    return raw.select(
        "row_pos",
        *[c for c in REVIEW_REQUIRED if c != "rating"],
        strict_number(F.col("rating")).alias("stars_value"),
        *[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
          for c in REVIEW_OPTIONAL],
        F.lit("review_date" in raw.columns).alias("is_dated"),
        F.lit("verified_purchase" in raw.columns).alias("has_verified"),
        F.lit(UPLOADED).alias("source"),
        F.lit(None).cast("double").alias("source_rating"),
        F.lit(None).cast("string").alias("source_reason"),
    )


def product_records(raw: DataFrame) -> DataFrame:
    """Normalised view of a product export; one row is one product listing.

    Bad prices and counts become NULL and never reject a row. The source cells are
    kept beside the parsed values.
    """
    lacking = missing_columns(raw, EXPORT_REQUIRED)
    if lacking:
        raise InputError("the product export lacks columns: " + ", ".join(lacking))

    # Cells, then numbers, then verdicts: each step reads the one before it by name, so
    # the plan holds every parse once.
    named = (*EXPORT_KEPT[:-1], "review_content")
    cells = raw.select("row_pos", *[
        (trimmed(F.col(c)) if c in raw.columns else F.lit("")).alias(c) for c in named])
    numbers = cells.select(
        "*", category_path(F.col("category")).alias("category_path"),
        strict_number(F.col("rating")).alias("source_rating"))
    stars = numbers.withColumn("stars", whole_stars(F.col("source_rating")))
    reason = (
        F.when(F.col("product_id") == "", "missing_product_id")
        .when(F.col("review_content") == "", "missing_review_text")
        .when(F.col("stars").isNull(), "invalid_rating")
    )
    return stars.select(
        "row_pos",
        F.format_string(RECORD_ID_FORMAT, F.col("row_pos")).alias("review_id"),
        "product_id",
        "product_name",
        "category_path",
        F.coalesce(F.try_element_at("category_path", F.lit(-1)), F.lit("")).alias("category"),
        F.col("stars").alias("rating"),
        "source_rating",
        F.col("review_content").alias("review_text"),
        amount(F.col("discounted_price")).alias("discounted_price"),
        amount(F.col("actual_price")).alias("actual_price"),
        amount(F.col("discount_percentage")).alias("discount_percent"),
        amount(F.col("rating_count")).alias("rating_count"),
        F.struct("discounted_price", "actual_price", "discount_percentage", "rating", "rating_count",
                 "category").alias("raw"),
        reason.alias("source_reason"),
    )


def export_as_reviews(raw: DataFrame) -> DataFrame:
    """Product records in the review columns: undated, never a purchase promotion."""
    records = product_records(raw)
    return records.select(
        "row_pos", "review_id", "product_id", "product_name",
        F.col("raw.category").alias("category"),
        "review_text",
        F.col("rating").cast("double").alias("stars_value"),
        *[F.lit(None).cast("string").alias(c) for c in REVIEW_OPTIONAL],
        F.lit(False).alias("is_dated"),
        F.lit(False).alias("has_verified"),
        F.lit(PRODUCT_EXPORT).alias("source"),
        "source_rating",
        "source_reason",
    )


def read_reviews(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return as_reviews(read_csv(spark, path))


def read_product_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return export_as_reviews(read_csv(spark, path))


def route(raw: DataFrame) -> DataFrame:
    """Choose the file shape from the header alone; the review shape wins a tie."""
    as_review = missing_columns(raw, REVIEW_REQUIRED)
    as_export = missing_columns(raw, EXPORT_REQUIRED)
    if not as_review:
        return as_reviews(raw)
    if not as_export:
        return export_as_reviews(raw)
    raise InputError(
        f"neither a review file (lacks {', '.join(as_review)}) "
        f"nor a product export (lacks {', '.join(as_export)})"
    )


def read_feedback(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return route(read_csv(spark, path))


def prune_export(raw: DataFrame) -> DataFrame:
    """The kept export columns in fixed order; reviewer identities are left behind."""
    lacking = missing_columns(raw, EXPORT_KEPT)
    if lacking:
        raise InputError("the product export lacks columns: " + ", ".join(lacking))
    return raw.select(*EXPORT_KEPT)


def write_pruned_export(spark: SparkSession, source: str, target: str, form: str = "parquet") -> None:
    """Store the pruned copy; Parquet scales, CSV keeps the original form."""
    pruned = prune_export(read_csv(spark, source))
    writer = pruned.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(target)
    else:
        writer.parquet(target)
