"""Tag engine, second half: findings from reconciled tags, and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.numbers import share_percent
from themeloom.functions.text import attribution, label_key, lower_first
from themeloom.model import Unit
from themeloom.operators.labels import SCOPE, TAG_ORDER
from themeloom.operators.themes import NEGATIVE, POSITIVE, enough_evidence, ranked
from themeloom.storage import settle

GROUP = [*SCOPE, "polarity", "theme_key"]


def support(canonical: DataFrame) -> DataFrame:
    """Supporting reviews per final theme and polarity, with the first tag's evidence.

    Two raw labels of one review may have become the same theme, so a review counts
    once. Grouping by review first also spreads a theme that a third of all tags
    carry. Neutral tags support nothing.
    """
    polar = canonical.filter("sentiment <> 'neutral'").select(
        *SCOPE, F.when(F.col("sentiment") == "praise", POSITIVE).otherwise(NEGATIVE).alias("polarity"),
        F.col("canonical_key").alias("theme_key"), F.col("canonical_theme").alias("label"),
        "review_id", *TAG_ORDER, "evidence")
    per_review = polar.groupBy(*GROUP, "review_id", "review_date", "row_pos").agg(
        F.min_by("label", "entry_pos").alias("label"),
        F.min_by("evidence", F.struct(F.collate("evidence", "UNICODE"), "evidence")).alias("evidence"),
    )
    first = F.struct("review_date", "row_pos")
    return per_review.groupBy(*GROUP).agg(
        F.count("*").alias("mentions"),
        F.min_by(F.struct("label", "evidence", "review_id", "row_pos"), first).alias("_first"),
    ).select(*GROUP, F.col("_first.label").alias("label"), "mentions",
             F.col("_first.evidence").alias("quote"), F.col("_first.review_id").alias("review_id"),
             F.col("_first.row_pos").alias("row_pos"))


def tag_findings(canonical: DataFrame, totals: DataFrame, unit: Unit) -> DataFrame:
    """Ranked findings of every scope; the share is of all selected rows."""
    enough = support(canonical).filter(enough_evidence(unit))
    shared = enough.join(totals.select(*SCOPE, "selected"), SCOPE).withColumn(
        "percent", share_percent(F.col("mentions"), F.col("selected")))
    return ranked(shared)


def with_authors(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Add who each quote is credited to, looking up the winning rows only."""
    held = settle(found, "tag_findings")
    rows = held.select("row_pos").distinct().join(
        reviews.select("row_pos", "author", "verified", "country"), "row_pos")
    return held.join(rows, "row_pos").select(
        *found.columns,
        attribution(F.col("author"), F.col("verified"), F.col("country")).alias("quote_author"))


def derived_advice(found: DataFrame, unit: Unit) -> DataFrame:
    """One prompt per fault, naming its support."""
    share = F.when(F.col("selected") == 1, F.lit(f"the only {unit.one}")).otherwise(F.concat(
        F.col("mentions").cast("string"), F.lit(" of "), F.col("selected").cast("string"),
        F.lit(f" {unit.many}")))
    return found.filter(F.col("polarity") == NEGATIVE).select(
        *SCOPE, "rank",
        F.concat(F.lit("Look into "), lower_first(F.col("label")), F.lit(": named in "), share,
                 F.lit(".")).alias("advice"))


def below_threshold(canonical: DataFrame, unit: Unit) -> DataFrame:
    """Themes that exist but lack support."""
    return support(canonical).filter(~enough_evidence(unit)).select(*GROUP, "label", "mentions")


def mapping_problems(canonical: DataFrame) -> DataFrame:
    """Where canonical tags are not a closed, single-valued relabelling of raw ones."""
    raw_keys = canonical.select(*SCOPE, label_key(F.col("raw_theme")).alias("canonical_key")).distinct()
    pairs = canonical.groupBy(*SCOPE, "raw_key", "canonical_key").agg(
        F.count_if(F.coalesce("canonical_theme", F.lit("")) == "").alias("empty_label"),
        F.count_if(F.col("canonical_key") != label_key(F.col("canonical_theme"))).alias("wrong_key"),
        F.count_if(F.col("raw_key") != label_key(F.col("raw_theme"))).alias("wrong_raw_key"),
    )
    broken = pairs.filter("empty_label + wrong_key + wrong_raw_key > 0").select(
        *SCOPE, "raw_key",
        F.when(F.col("empty_label") > 0, "empty_label")
        .when(F.col("wrong_key") > 0, "wrong_key").otherwise("wrong_raw_key").alias("problem"))
    invented = pairs.join(raw_keys, [*SCOPE, "canonical_key"], "left_anti").select(
        *SCOPE, "raw_key", F.lit("never_offered").alias("problem"))
    split = pairs.groupBy(*SCOPE, "raw_key").agg(F.count("*").alias("n")).filter("n > 1").select(
        *SCOPE, "raw_key", F.lit("maps_two_ways").alias("problem"))
    return broken.unionByName(invented).unionByName(split)


def compare_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places where two computations of the findings differ; empty if they agree."""
    place = [*SCOPE, "polarity", "rank"]
    values = ["label", "mentions", "percent", "quote"]
    left = a.select(*place, F.struct(*values).alias("left"))
    right = b.select(*place, F.struct(*values).alias("right"))
    return left.join(right, place, "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
