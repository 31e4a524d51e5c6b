"""Raw rows, tagger responses and labelled sets derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.corpora import document_reviews, table
from themeloom.model import Theme
from themeloom.operators.labels import SCOPE
from themeloom.sources.files import as_reviews, read_table


# Words of the part names.
PART_VOCABULARY = (
    Theme("size", "size", ("small", "large"), "measure"), Theme("colour", "colour", ("red", "blue"), "compare"),
    Theme("kind", "kind", ("widget", "ring", "small ring"), "sort"),
)


def pick(index: Column, *values: Column | str | None) -> Column:
    """The value at ``index`` of a short list; NULL beyond it."""
    chain = F.when(index == 0, _col(values[0]))
    for i, v in enumerate(values[1:], start=1):
        chain = chain.when(index == i, _col(v))
    return chain


def _col(v: Column | str | None) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("string")


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text cells with every kind of defect."""
    d = F.col("doc_id")
    iso = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (d % 180).cast("int")), "yyyy-MM-dd")
    stars = (F.lit(1) + (d * 7) % 5).cast("string")
    raw = table(spark, folder, "documents").select(
        d.alias("row_pos"),
        F.when(d % 23 == 0, " ").otherwise(
            F.concat(F.lit("r"), d - F.when(d % 10 == 9, 1).otherwise(0))).alias("review_id"),
        F.when(d % 29 == 0, "  ").otherwise(F.col("source")).alias("product_id"),
        F.when(d % 7 == 0, "").otherwise(F.concat_ws(" ", "source", "lang")).alias("product_name"),
        F.when(d % 13 == 0, " ").otherwise(F.concat("lang", F.lit(" |  "), "source", F.lit(" |"))).alias("category"),
        F.coalesce(pick(d % 11, "4.0", "3.5", "", "4d", " 5 ", "6"), stars).alias("rating"),
        F.when(d % 31 == 0, " ").otherwise(F.col("text")).alias("review_text"),
        F.coalesce(pick(d % 17, "2026-02-30", "2026-2-3"), iso).alias("review_date"),
        F.when(d % 3 == 0, F.concat(F.lit(" T"), d)).alias("review_title"),
        F.when(d % 2 == 0, F.upper("lang")).otherwise("").alias("country"),
        pick(d % 5, " deal a ", "", "deal b").alias("promotion"),
        pick(d % 3, "true", "TRUE", "false").alias("verified_purchase"),
        pick(d % 6, "10%", "abc", "", "101", " 5.5 ").alias("discount_percent"),
    )
    return as_reviews(read_table(raw, "row_pos"))


def raw_export(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as a product export, with unreadable ratings and decorated prices."""
    k = F.col("p_partkey")
    price = F.concat(F.lit("₹"), F.format_number(F.col("p_retailprice").cast("int"), 0))
    return table(spark, folder, "part").select(
        (k + 1).alias("row_pos"),
        F.when(k % 37 == 0, "").otherwise(F.concat(F.lit("P"), F.floor(k / 2))).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat("p_type", F.lit("| "), "p_brand", F.lit(" |Size  "), F.col("p_size").cast("string")).alias("category"),
        F.when(k % 3 == 0, "").otherwise(price).alias("discounted_price"),
        price.alias("actual_price"),
        pick(k % 4, "64%", "n/a", "", "7.5 %").alias("discount_percentage"),
        F.coalesce(pick(k % 9, "4.2", "3.5", "2.4", "|", "", "5.6"), F.lit("4")).alias("rating"),
        F.format_number(k * 13, 0).alias("rating_count"),
        F.when(k % 41 == 0, " ").otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("review_content"),
        F.lit("reviewer").alias("user_name"),
    )


def response_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Up to four tag entries per document, some of them wrong, as JSON texts."""
    d, text = F.col("doc_id"), F.col("text")
    stars = F.lit(1) + (d * 7) % 5
    batch = F.floor(d / 10)
    base = lambda i: pick(i, "battery", "price", "pack", "speed")
    own = base(d % 4)
    theme_0 = pick(F.floor(d / 4) % 3, own, F.concat(F.lit("  "), F.initcap(own), F.lit("  Issue ")),
                   F.concat(F.upper(own), F.lit(" POINT")))
    theme_1 = F.concat(base(F.floor(d / 5) % 4), F.when(F.floor(d / 3) % 2 == 0, "").otherwise(" issue"))
    mood_0 = F.when(stars >= 4, "praise").when(stars <= 2, "fault").otherwise("neutral")
    mood_1 = F.when(stars <= 2, "praise").otherwise("fault")
    spoiled = (d % 7 == 0) | (batch % 29 == 7)
    proof_0 = F.concat(F.substring(text, 1, 12), F.when(spoiled, "#~").otherwise(""))
    proof_1 = F.when(batch % 29 == 7, "#~").when(d % 2 == 0, F.right(text, F.lit(10))).otherwise(
        F.substring(text, F.floor(F.char_length(text) / 3).cast("int") + 1, F.lit(20)))
    entry = lambda who, theme, mood, proof: F.to_json(F.struct(
        who.alias("review_id"), theme.alias("theme"), mood.alias("sentiment"), proof.alias("evidence_span")))
    me = F.concat(F.lit("d"), d)
    flaw = pick(
        d % 9, entry(me, F.lit(5), mood_0, proof_0), F.lit('"junk"'),
        entry(F.concat(F.lit("x"), d), own, mood_0, proof_0), entry(me, own, F.lit("angry"), proof_0),
        F.lit("null"), entry(me, F.lit("  "), mood_0, proof_0))
    repeat = F.when(d % 5 == 0, entry(me, F.upper(theme_0), mood_0, F.substring(text, 3, 5)))
    return table(spark, folder, "documents").select(
        "doc_id", batch.alias("batch_id"),
        F.posexplode(F.array(entry(me, theme_0, mood_0, proof_0), entry(me, theme_1, mood_1, proof_1),
                             repeat, flaw)).alias("e", "json"),
    ).filter("json is not null")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """One response per ten documents; some fenced, cut off, wrapped or empty."""
    lists = response_entries(spark, folder).groupBy("batch_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "e", "json"))), lambda x: x["json"]).alias("j"))
    body = F.concat(F.lit("["), F.array_join("j", ", "), F.lit("]"))
    b = F.col("batch_id")
    return lists.select(
        F.lit("run1").alias("run_id"), "batch_id",
        F.when(b % 17 == 5, F.concat(F.lit("["), F.element_at("j", 1)))
        .when(b % 19 == 3, F.concat(F.lit('{"tags": '), body, F.lit("}")))
        .when(b % 23 == 4, " [] ")
        .when(b % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body).alias("payload"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The reviews of each response's batch; every thirteenth review was in another one."""
    d = F.col("doc_id")
    return table(spark, folder, "documents").select(
        (F.floor(d / 10) + F.when(d % 13 == 5, 1).otherwise(0)).alias("batch_id"), F.concat(F.lit("d"), d).alias("review_id"))


def group_by_first_word(chunks: DataFrame) -> DataFrame:
    """A stand-in for outside judgement: labels with the same first word are one theme."""
    word = F.split(F.lower("label"), " ")[0]
    grouped = chunks.groupBy(*SCOPE, "chunk", word.alias("word")).agg(
        F.array_sort(F.collect_list("idx")).alias("members"))
    return grouped.groupBy(*SCOPE, "chunk").agg(F.array_sort(F.collect_list("members")).alias("groups"))


def mixed_labels(spark: SparkSession, folder: str) -> DataFrame:
    d, half = F.col("doc_id"), F.floor(F.char_length("text") / 2).cast("int")
    return table(spark, folder, "documents").select(
        F.concat(F.lit("d"), d).alias("review_id"),
        pick(d % 3, "mixed", "praise-only", "fault-only").alias("kind"),
        F.substring("text", F.lit(1), half).alias("praise_clause"),
        F.substring("text", half + 1, F.char_length("text")).alias("fault_clause"))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("review_id"), F.col("lang").alias("cluster"))


def runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events as timed runs, and a price per model."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    n = F.col("event_id")
    timed = events.select(
        F.col("event_type").alias("model"),
        F.concat(F.lit("f"), F.col("user_id") % 3).alias("fixture"),
        (n % 1000).alias("input_tokens"), F.col("user_id").alias("output_tokens"),
        F.floor(F.col("value") * 10).alias("latency_ms"),
        (F.col("value") > 50).alias("timed_out"), (n % 50 == 0).alias("errored"),
        F.when(n % 7 == 0, "max_tokens").otherwise("end").alias("stop_reason"),
        (n % 31 == 0).alias("parse_error"))
    prices = events.select(F.col("event_type").alias("model")).distinct().select(
        "model", F.length("model").cast("double").alias("input_usd"),
        (F.length("model") * 2).cast("double").alias("output_usd"))
    return timed, prices


