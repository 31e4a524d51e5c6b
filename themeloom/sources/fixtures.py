"""The built-in sample, the labelled stand-in and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from themeloom.functions.text import blank_to_null
from themeloom.model import InputError, SampleLimits, Theme
from themeloom.sources.files import SAMPLE, as_reviews, read_feedback

STAND_IN_LABEL = "Synthetic product records"

SAMPLE_VOCABULARY = (
    Theme("light", "Light output", ("bright", "dim", "glow"), "Measure the lamp against its rating."),
    Theme("switch", "Switch", ("switch", "button", "power button"), "Test the switch for wear."),
    Theme("price", "Price", ("cheap", "price", "worth it"), "Compare the price with rivals."),
)

_SAMPLE_ROWS = [
    ("s1", "lamp", "Desk lamp", "Home|Lighting", 5, "Very bright. The switch feels solid.", "2026-01-03", "Opening week", 15.0),
    ("s2", "lamp", "Desk lamp", "Home|Lighting", 4, "Bright enough to read by.", "2026-01-09", None, None),
    ("s3", "lamp", "Desk lamp", "Home|Lighting", 1, "The switch broke. Sent it back.", "2026-02-11", None, None),
    ("s4", "lamp", "Desk lamp", "Home|Lighting", 2, "Switch stuck after a week!", "2026-02-20", "Opening week", 15.0),
    ("s5", "lamp", "Desk lamp", "Home|Lighting", 3, "Fine for the price.", "2026-03-01", None, None),
    ("s6", "fan", "Table fan", "Home|Cooling", 5, "Cheap and quiet, worth it.", "2026-01-15", None, None),
    ("s7", "fan", "Table fan", "Home|Cooling", 4, "A fair price.", "2026-03-09", None, None),
    ("s8", "kettle", "Kettle", "Kitchen", 2, "The power button is loose.", "2026-02-02", None, None),
]


def sample_reviews(spark: SparkSession) -> DataFrame:
    """Eight invented dated reviews of three products, some bought on promotion."""
    names = ["review_id", "product_id", "product_name", "category", "rating", "review_text",
             "review_date", "promotion", "discount_percent"]
    rows = [(i + 1, *[None if v is None else str(v) for v in r]) for i, r in enumerate(_SAMPLE_ROWS)]
    raw = spark.createDataFrame(rows, "row_pos long, " + ", ".join(f"{n} string" for n in names))
    return as_reviews(raw).withColumn("source", F.lit(SAMPLE))


def preferred(spark: SparkSession, path: str, stand_in: str, label: str) -> DataFrame:
    """The real file if it is there, else the stand-in, marked as synthetic."""
    try:
        return read_feedback(spark, path).withColumns(
            {"dataset_label": F.lit(label), "is_synthetic": F.lit(False)}
        )
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    return read_feedback(spark, stand_in).withColumns(
        {"dataset_label": F.lit(STAND_IN_LABEL), "is_synthetic": F.lit(True)}
    )


def read_responses(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Raw tagger responses (run_id, batch_id, payload).

    ``parquet`` and ``json`` (one object a line) state all three. In ``text`` each file is the payload of one
    response, as it came, in the folder ``run_id=…/batch_id=…``.
    """
    kind = "run_id string, batch_id long, payload string"
    if form == "text":
        whole = spark.read.schema("value string, run_id string, batch_id long").option("wholetext", True).text(path)
        return whole.select("run_id", "batch_id", F.col("value").alias("payload"))
    if form not in ("parquet", "json"):
        raise InputError(f"responses cannot be read from {form}")
    return spark.read.schema(kind).format(form).load(path)


def read_mixed_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reviews labelled with the clause that praises and the clause that faults."""
    raw = spark.read.schema(
        "reviews array<struct<id:string,text:string,kind:string,praiseClause:string,faultClause:string>>"
    ).option("multiLine", True).json(path)
    return raw.select(F.explode("reviews").alias("r")).select(
        F.col("r.id").alias("review_id"), F.col("r.text").alias("text"), F.col("r.kind").alias("kind"),
        F.col("r.praiseClause").alias("praise_clause"), F.col("r.faultClause").alias("fault_clause"),
    )


def read_cluster_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reviews labelled with the one concept they are about."""
    raw = spark.read.schema("reviews array<struct<id:string,text:string,cluster:string>>").option(
        "multiLine", True).json(path)
    return raw.select(F.explode("reviews").alias("r")).select(
        F.col("r.id").alias("review_id"), F.col("r.text").alias("text"),
        F.col("r.cluster").alias("cluster"),
    )


def mislabelled(mixed: DataFrame) -> DataFrame:
    """Labelled clauses that are not part of their own text."""
    wrong = lambda clause: F.coalesce(~F.contains(F.col("text"), F.col(clause)), F.lit(False))
    return mixed.filter(wrong("praise_clause") | wrong("fault_clause")).select("review_id")


def size_bounded_sample(rows: DataFrame, limits: SampleLimits = SampleLimits()) -> DataFrame:
    """First rows in order that fit the row, text and request limits.

    Blank and repeated ids are skipped; the first row that does not fit ends it.
    The row limit is applied first by a distributed top-k, so the running sums run
    over at most ``max_rows`` rows.
    """
    usable = rows.select(
        "row_pos", blank_to_null(F.col("review_id")).alias("review_id"),
        blank_to_null(F.col("text")).alias("text"),
    ).filter("review_id is not null and text is not null")
    firsts = usable.groupBy("review_id").agg(F.min("row_pos").alias("row_pos"))
    head = firsts.orderBy("row_pos").limit(limits.max_rows)
    picked = usable.join(F.broadcast(head), ["review_id", "row_pos"])
    so_far = Window.orderBy("row_pos").rowsBetween(Window.unboundedPreceding, 0)
    request = F.octet_length(F.to_json(F.struct(F.col("review_id").alias("id"), "text")))
    return (
        picked.withColumn("text_bytes", F.octet_length("text").cast("long"))
        .withColumn("total_bytes", F.sum("text_bytes").over(so_far))
        .withColumn("_request", F.sum(request + 1).over(so_far) + 13)
        .filter((F.col("total_bytes") <= limits.max_text_bytes)
                & (F.col("_request") <= limits.max_request_bytes))
        .drop("_request")
    )


def write_results(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Store briefs, findings, tags or audits, one folder per scope kind."""
    writer = df.write.mode("errorifexists")
    if "scope_kind" in df.columns:
        writer = writer.partitionBy("scope_kind")
    writer.format(form).save(path)
