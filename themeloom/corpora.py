"""The supplied tables read as feedback: documents as reviews, sales as promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.model import Theme
from themeloom.operators.ingest import product_dimension
from themeloom.sources.files import UPLOADED

# Words that occur in the invented prose, so that themes are found.
VOCABULARY = (
    Theme("origin", "origin", ("from", "de", "von"), "trace where it comes from"),
    Theme("means", "means", ("by", "por", "avec"), "ask how it was done"),
    Theme("compare", "comparison", ("than", "que", "que la"), "compare with rivals"),
    Theme("choice", "choice", ("or", "und", "the or"), "offer fewer options"),
    Theme("place", "place", ("at", "dans", "in"), "check the location"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the shape of classified reviews, all accepted."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select(
        doc.alias("row_pos"),
        F.concat(F.lit("d"), doc).alias("review_id"),
        F.col("source").alias("product_id"),
        F.concat(F.lit("Product "), F.col("source")).alias("product_name"),
        F.concat_ws("|", "lang", "source").alias("category"),
        (F.lit(1) + (doc * 7) % 5).cast("int").alias("rating"),
        F.lit(None).cast("double").alias("source_rating"),
        F.date_add(F.lit("2026-01-01").cast("date"), (doc % 180).cast("int")).alias("review_date"),
        "text",
        F.lit(None).cast("string").alias("title"),
        F.when(doc % 4 == 0, F.concat(F.lit("Author "), doc % 10)).alias("author"),
        (doc % 3 == 0).alias("verified"),
        F.when(doc % 2 == 0, F.upper("lang")).alias("country"),
        F.when(doc % 6 == 0, F.concat(F.lit("deal "), doc % 4)).alias("promotion"),
        F.when(doc % 5 == 0, (doc % 3).cast("double")).alias("discount_percent"),
        F.lit(UPLOADED).alias("source"),
        F.lit(None).cast("string").alias("reject_reason"),
    )


def document_reviews(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = document_rows(spark, folder)
    return rows.drop("product_name", "reject_reason"), product_dimension(rows)


def sale_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items in the shape of classified reviews: a part is a product."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    promoted = F.col("l_discount") > 0
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_pos"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat_ws("|", "p_type", "p_brand").alias("category"),
        (F.lit(1) + (F.col("l_linenumber") + F.col("l_quantity").cast("int")) % 5).alias("rating"),
        F.col("l_shipdate").cast("date").alias("review_date"),
        F.when(promoted, F.concat(F.lit("code "), F.col("l_returnflag"))).alias("promotion"),
        (F.col("l_discount") * 100).alias("discount_percent"),
        F.lit(None).cast("string").alias("reject_reason"),
    )
