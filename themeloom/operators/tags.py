"""Tag engine, first half: parsing responses and grounding tags in their review."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import SPACE_CLASS, blank_to_null, keyword_pattern, label_key, sentences, trimmed
from themeloom.model import TagError, Theme
from themeloom.storage import require_none, settle, with_position

# The sentiments a tag may carry; neutral supports no finding.
SENTIMENTS = ("praise", "fault", "neutral")

BATCH = ["run_id", "batch_id"]


def without_fence(payload: Column) -> Column:
    """The payload without one code fence around it."""
    plain = trimmed(payload)
    # Fixed value: what a fence looks like.
    fence = rf"^```(?:json)?{SPACE_CLASS}*\n([\s\S]*?)\n```$"
    return trimmed(F.when(plain.rlike(fence), F.regexp_extract(plain, fence, 1)).otherwise(plain))


def parse_responses(raw: DataFrame) -> DataFrame:
    """Add ``items``: the payload as an array of variants, NULL if it is not one.

    The parser stops after the first JSON value and ignores what follows, so the
    payload is parsed inside brackets and inside braces: only a payload that is one
    whole value survives both, as the single element of the outer array.
    """
    plain = raw.select(*BATCH, without_fence(F.col("payload")).alias("_plain"))
    parsed = plain.select(
        *BATCH,
        F.try_parse_json(F.concat(F.lit("["), "_plain", F.lit("]"))).alias("_inside"),
        F.try_parse_json(F.concat(F.lit('{"v":'), "_plain", F.lit("}"))).isNotNull().alias("_closed"),
    ).withColumn("_outer", F.try_variant_get("_inside", "$", "array<variant>"))
    items = F.try_variant_get(F.try_element_at("_outer", F.lit(1)), "$", "array<variant>")
    whole = F.col("_closed") & (F.size("_outer") == 1)
    return parsed.select(*BATCH, F.when(whole, items).alias("items"))


def _string_field(name: str) -> Column:
    """The field if it is a JSON string; a number or a missing field is NULL."""
    field = F.try_variant_get("item", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get("item", f"$.{name}", "string"))


def entries(responses: DataFrame) -> DataFrame:
    """One row per entry of a usable response; ``well_formed`` if its shape holds."""
    # The outer form keeps the parse out of a pushed-down filter, where it would be repeated.
    item = responses.select(*BATCH, F.posexplode_outer("items").alias("entry_pos", "item")).filter(
        "entry_pos is not null")
    fields = item.select(
        *BATCH, "entry_pos",
        _string_field("review_id").alias("review_id"),
        _string_field("theme").alias("theme"),
        _string_field("sentiment").alias("sentiment"),
        _string_field("evidence_span").alias("evidence"),
    )
    shape = (
        (F.col("review_id") != "") & blank_to_null(F.col("theme")).isNotNull()
        & F.col("sentiment").isin(*SENTIMENTS) & (F.col("evidence") != "")
    )
    return fields.withColumn("well_formed", F.coalesce(shape, F.lit(False)))


def grounded(tag_entries: DataFrame, reviews: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Entries whose evidence stands word for word in the review they name.

    ``batches`` says which reviews a response was asked about, as (batch_id, review_id): a tag
    of any other review is not accepted. Only texts that a tag names leave their scan.
    """
    sound = tag_entries.filter("well_formed").drop("well_formed")
    if batches is not None:
        sound = sound.join(batches.select("batch_id", "review_id").distinct(), ["batch_id", "review_id"], "left_semi")
    return sound.join(reviews.select("review_id", "text"), "review_id").filter(
        F.contains(F.col("text"), F.col("evidence"))).drop("text")


def validate(tag_entries: DataFrame, reviews: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Valid tags; of equal (review, theme key, sentiment) in a response the first stays.

    ``copies`` counts the entries a tag stands for. Equal entries are merged by a
    partial aggregate, so a response full of repeats loads no single task.
    """
    keyed = grounded(tag_entries, reviews, batches).withColumns(
        {"theme": trimmed(F.col("theme")), "theme_key": label_key(F.col("theme"))})
    return keyed.groupBy(*BATCH, "review_id", "theme_key", "sentiment").agg(
        F.min("entry_pos").alias("entry_pos"),
        F.min_by(F.struct("theme", "evidence"), "entry_pos").alias("_first"),
        F.count("*").alias("copies"),
    ).select(*BATCH, "entry_pos", "review_id", F.col("_first.theme").alias("theme"), "theme_key",
             "sentiment", F.col("_first.evidence").alias("evidence"), "copies")


def outcomes(responses: DataFrame, tag_entries: DataFrame, valid: DataFrame) -> DataFrame:
    """Counts and verdict per response.

    ``unusable``: not a JSON array. ``all_rejected``: entries, but none valid.
    ``not_strict``: usable, though some entry was rejected or repeated.
    """
    seen = tag_entries.groupBy(*BATCH).agg(F.count("*").alias("entries"))
    kept = valid.groupBy(*BATCH).agg(
        F.count("*").alias("valid"), F.sum(F.col("copies") - 1).alias("deduped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counted = (
        responses.select(*BATCH, F.col("items").isNotNull().alias("usable"))
        .join(seen, BATCH, "left").join(kept, BATCH, "left")
        .select(*BATCH, "usable", zero("entries"), zero("valid"), zero("deduped"))
        .withColumn("rejected", F.col("entries") - F.col("valid") - F.col("deduped"))
    )
    verdict = (
        F.when(~F.col("usable"), "unusable")
        .when((F.col("valid") == 0) & (F.col("rejected") > 0), "all_rejected")
        .when(F.col("rejected") + F.col("deduped") > 0, "not_strict")
        .otherwise("clean")
    )
    return counted.withColumn("verdict", verdict)


def accept_tags(
    raw: DataFrame, reviews: DataFrame, strict: bool = False, batches: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Valid tags of the responses that pass their gate, and the outcomes of those that do not.

    Tags are written out once: counts and findings then agree even if the source is
    not repeatable. A response that fails takes only its own tags with it.
    """
    responses = parse_responses(raw)
    found = entries(responses)
    valid = settle(validate(found, reviews, batches), "valid_tags")
    failing = ["unusable", "all_rejected"] + (["not_strict"] if strict else [])
    refused = settle(outcomes(responses, found, valid).filter(F.col("verdict").isin(failing)), "refused_responses")
    return valid.join(refused, BATCH, "left_anti"), refused


def input_problems(reviews: DataFrame) -> DataFrame:
    """Rows that may not be sent to a tagger: blank or repeated ids, blank text; or that there are none."""
    blank_id = blank_to_null(F.col("review_id")).isNull()
    blank_text = blank_to_null(F.col("text")).isNull()
    bad = reviews.filter(blank_id | blank_text).select(
        F.when(blank_id, "blank_id").otherwise("blank_text").alias("problem"),
        "review_id", F.lit(1).cast("long").alias("rows"))
    repeated = reviews.filter(~blank_id).groupBy("review_id").agg(
        F.count("*").alias("rows")).filter("rows > 1")
    none = reviews.agg(F.count("*").alias("rows")).filter("rows = 0").select(
        F.lit("no_rows").alias("problem"), F.lit(None).cast("string").alias("review_id"), "rows")
    return bad.unionByName(
        repeated.select(F.lit("repeated_id").alias("problem"), "review_id", "rows")).unionByName(none)


def tagger_input(reviews: DataFrame) -> DataFrame:
    """Only id and text go to a tagger, so a rating cannot sway it."""
    return reviews.select("review_id", "text")


TAG_SCHEMA = "review_id string, theme string, sentiment string, evidence string"
Tagger = Callable[[pd.DataFrame], pd.DataFrame]


def tag_rows(reviews: DataFrame, tagger: Tagger) -> DataFrame:
    """Tags from ``tagger``, called with (review_id, text) batches inside the tasks.

    The input is checked first and the output is written once before use.
    """
    require_none(input_problems(reviews), TagError, "rows cannot be tagged")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield tagger(frame)

    return settle(tagger_input(reviews).mapInPandas(run, TAG_SCHEMA), "tags")


def keyword_tags(
    reviews: DataFrame, vocabulary: Sequence[Theme], praise_words: Sequence[str], fault_words: Sequence[str]
) -> DataFrame:
    """Repeatable tags without an outside tagger: a theme's sentence, praised or faulted by the words in it."""
    require_none(input_problems(reviews), TagError, "rows cannot be tagged")
    said = tagger_input(reviews).select("review_id", F.explode_outer(sentences(F.col("text"))).alias("evidence"))
    mood = (F.when(F.col("evidence").rlike(keyword_pattern(*praise_words)), "praise")
            .when(F.col("evidence").rlike(keyword_pattern(*fault_words)), "fault").otherwise("neutral"))
    named = F.array(*[F.when(F.col("evidence").rlike(keyword_pattern(*t.keywords)), t.label) for t in vocabulary])
    # The outer form keeps the patterns out of a pushed-down filter, where they would run again.
    found = said.select("review_id", F.explode_outer(F.array_compact(named)).alias("theme"), "evidence").filter("theme is not null")
    return settle(found.select("review_id", "theme", mood.alias("sentiment"), "evidence"), "tags")


def coverage_problems(selected: DataFrame, batches: DataFrame) -> DataFrame:
    """Ids that batches miss, repeat, or hold in another order than the selection.

    ``selected`` has (review_id, sel_pos), ``batches`` (batch_id, pos, review_id). All three
    kinds are reported together. Order compares the id at each place of the batches with the id
    that the selection has there, which says something only if both have as many places. Places
    are numbered in parallel, so neither side passes through one task.
    """
    comparable = selected.count() == batches.count()
    times = batches.groupBy("review_id").agg(F.count("*").alias("times"))
    missing = selected.select("review_id").join(times, "review_id", "left_anti").select(
        F.lit("missing").alias("problem"), "review_id")
    repeated = times.filter("times > 1").select(F.lit("duplicated").alias("problem"), "review_id")
    placed = with_position(batches.select("batch_id", "pos", "review_id"), [], ["batch_id", "pos"], "_at")
    there = selected.select(F.col("sel_pos").alias("_at"), F.col("review_id").alias("_selected"))
    moved = placed.join(there, "_at").filter(F.lit(comparable) & (F.col("review_id") != F.col("_selected"))).select(
        F.lit("out_of_order").alias("problem"), "review_id").distinct()
    return missing.unionByName(repeated).unionByName(moved)
