"""Reconciling free-form theme labels inside each scope.

Which labels mean the same is a judgement that arrives from outside, as a function
or a table of index groups. Everything else is checked here: the request limits,
that a grouping is an exact partition, and that level after level maps every label.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import blank_to_null, label_key
from themeloom.model import LabelLimits
from themeloom.storage import settle, with_position

SCOPE = ["scope_kind", "scope_key"]
TAG_ORDER = ["review_date", "row_pos", "entry_pos"]


def distinct_labels(tags: DataFrame) -> DataFrame:
    """One label per key and scope: its first spelling, numbered by first appearance."""
    spellings = tags.groupBy(*SCOPE, "theme_key", "theme").agg(
        F.min(F.struct(*TAG_ORDER)).alias("_at"))
    firsts = spellings.groupBy(*SCOPE, "theme_key").agg(
        F.min_by("theme", "_at").alias("label"), F.min("_at").alias("_at"))
    flat = firsts.select(*SCOPE, "theme_key", "label", *[F.col(f"_at.{c}").alias(c) for c in TAG_ORDER])
    return with_position(flat, SCOPE, [*TAG_ORDER, "theme_key"], "label_pos").drop(*TAG_ORDER)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    beyond = F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", "")
    return F.char_length(text) + F.char_length(beyond)


def chunk_labels(labels: DataFrame, limits: LabelLimits = LabelLimits()) -> DataFrame:
    """Requests of at most ``max_labels`` labels: adds ``chunk`` and ``idx`` within it.

    A scope that fits one request keeps its order of appearance; a larger one is
    sorted by label and sliced, so its chunks do not depend on arrival.
    """
    sizes = labels.groupBy(*SCOPE).agg(F.count("*").alias("_labels"))
    keyed = labels.join(sizes, SCOPE).withColumn(
        "_sort", F.when(F.col("_labels") > limits.max_labels, F.col("label")).otherwise(""))
    placed = with_position(keyed, SCOPE, ["_sort", "label_pos"], "_at")
    return placed.select(
        *labels.columns,
        F.floor(F.col("_at") / limits.max_labels).cast("int").alias("chunk"),
        (F.col("_at") % limits.max_labels).cast("int").alias("idx"),
    )


def label_problems(chunks: DataFrame, limits: LabelLimits = LabelLimits()) -> DataFrame:
    """Labels and requests outside the limits, with the rule each one breaks."""
    place = [*SCOPE, "chunk"]
    each = chunks.select(
        *place, "label",
        F.when(blank_to_null(F.col("label")).isNull(), "blank")
        .when(utf16_length(F.col("label")) > limits.max_length, "too_long").alias("problem"),
    ).filter("problem is not null")
    repeated = chunks.groupBy(*place, "label").agg(F.count("*").alias("n")).filter("n > 1").select(
        *place, "label", F.lit("repeated").alias("problem"))
    encoded = F.octet_length(F.to_json(F.array("label"))) - 2
    sums = chunks.groupBy(*place).agg(
        F.count("*").alias("n"), F.sum(encoded + 1).alias("bytes"))
    whole = sums.select(
        *place, F.lit(None).cast("string").alias("label"),
        F.when(F.col("n") > limits.max_labels, "too_many")
        .when(F.col("bytes") + 12 > limits.max_bytes, "too_large").alias("problem"),
    ).filter("problem is not null")
    return each.unionByName(repeated).unionByName(whole)


def _members(groups: DataFrame) -> DataFrame:
    outer = groups.select(*SCOPE, "chunk", F.posexplode("groups").alias("group_no", "_g"))
    return outer.select(*SCOPE, "chunk", "group_no", F.try_element_at("_g", F.lit(1)).alias("rep_idx"),
                        F.posexplode("_g").alias("member_no", "idx"))


def grouping_problems(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """Why a grouping is not an exact partition of its chunk's labels; empty if it is."""
    place = [*SCOPE, "chunk"]
    sizes = chunks.groupBy(*place).agg(F.count("*").alias("labels"))
    shape = groups.select(
        *place, F.size("groups").alias("n_groups"),
        F.exists("groups", lambda g: g.isNull() | (F.size(g) == 0)).alias("has_empty"))
    used = _members(groups).join(sizes, place).groupBy(*place).agg(
        F.count("*").alias("used"), F.count_distinct("idx").alias("distinct"),
        F.count_if(F.col("idx").isNull() | (F.col("idx") < 0) | (F.col("idx") >= F.col("labels")))
        .alias("outside"),
    )
    judged = sizes.join(shape, place, "full_outer").join(used, place, "left")
    problem = (
        F.when(F.col("labels").isNull(), "unknown_chunk")
        .when(F.coalesce("n_groups", F.lit(-1)) <= 0, "no_groups")
        .when(F.col("n_groups") > F.col("labels"), "more_groups_than_labels")
        .when(F.col("has_empty"), "empty_group")
        .when(F.col("outside") > 0, "out_of_range")
        .when(F.col("used") > F.col("distinct"), "repeated")
        .when(F.col("distinct") < F.col("labels"), "not_covered")
    )
    return judged.withColumn("problem", problem).filter("problem is not null").select(*place, "problem")


def apply_grouping(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Each label with the first label of its group as its representative."""
    at = [*SCOPE, "chunk", "idx"]
    named = chunks.select(*at, "label")
    reps = named.select(*SCOPE, "chunk", F.col("idx").alias("rep_idx"), F.col("label").alias("representative"))
    return _members(groups).join(named, at).join(reps, [*SCOPE, "chunk", "rep_idx"]).select(
        *SCOPE, "chunk", "group_no", "label", "representative")


Grouper = Callable[[DataFrame], DataFrame]


def _scopes_of(problems: DataFrame, stage: str) -> DataFrame:
    """One reason per scope; the first in name order where there are several."""
    return problems.groupBy(*SCOPE).agg(F.concat(F.lit(stage + ": "), F.min("problem")).alias("problem"))


def reconcile(labels: DataFrame, group: Grouper, limits: LabelLimits = LabelLimits()) -> tuple[DataFrame, DataFrame]:
    """Label map (scope, level, label, representative), and (scope, problem) of those that have none.

    ``group`` gets the chunks of one level and returns (scope, chunk, groups). A scope is done
    once its labels fit one request; one with a single label needs none. A scope fails if its
    labels or its grouping break a rule, if it merges nothing while it still needs several
    requests, or if it is not done after ``max_levels``. It then leaves the next level, and no
    other scope notices.
    """
    counts = labels.groupBy(*SCOPE).agg(F.count("*").alias("_n"))
    trivial = labels.join(counts.filter("_n <= 1").drop("_n"), SCOPE, "left_semi").select(
        *SCOPE, F.lit(0).alias("level"), "label", F.col("label").alias("representative"))
    current = labels.join(counts.filter("_n > 1").drop("_n"), SCOPE, "left_semi").select(
        *SCOPE, "label", "label_pos")
    maps, failed = [trivial], []
    for level in range(limits.max_levels):
        chunks = settle(chunk_labels(current, limits), "chunks")
        refused = settle(_scopes_of(label_problems(chunks, limits), f"level {level} labels"), "refused_labels")
        sound = chunks.join(refused, SCOPE, "left_anti")
        groups = settle(group(sound), "groups")
        spoiled = settle(_scopes_of(grouping_problems(groups, sound), f"level {level} grouping"), "refused_groups")
        applied = settle(apply_grouping(sound, groups).join(spoiled, SCOPE, "left_anti"), "label_map")
        maps.append(applied.select(*SCOPE, F.lit(level).alias("level"), "label", "representative"))
        unfinished = settle(
            applied.groupBy(*SCOPE).agg(
                F.max("chunk").alias("_last"), F.count("*").alias("_labels"),
                F.count_if(F.col("label") == F.col("representative")).alias("_kept"),
            ).filter("_last > 0").select(*SCOPE, (F.col("_kept") >= F.col("_labels")).alias("_stuck")), "unfinished")
        last = level == limits.max_levels - 1
        reason = F.when(F.col("_stuck"), f"level {level}: merged nothing").otherwise(
            f"not done within {limits.max_levels} levels")
        halted = unfinished.filter(F.col("_stuck") | F.lit(last)).select(*SCOPE, reason.alias("problem"))
        failed += [refused, spoiled, halted]
        current = applied.filter("label = representative").join(
            unfinished.filter("NOT _stuck"), SCOPE, "left_semi").select(
            *SCOPE, "label",
            (F.col("chunk").cast("long") * limits.max_labels + F.col("group_no")).alias("label_pos"))
        if last or current.isEmpty():
            break
    problems = settle(reduce(DataFrame.unionByName, failed), "label_problems")
    return reduce(DataFrame.unionByName, maps).join(problems, SCOPE, "left_anti"), problems


def level_problems(label_map: DataFrame, limits: LabelLimits = LabelLimits()) -> DataFrame:
    """Levels too large for one request that merge nothing, or lie too deep."""
    levels = label_map.groupBy(*SCOPE, "level").agg(
        F.count("*").alias("labels"), F.count_distinct("representative").alias("representatives"))
    large = F.col("labels") > limits.max_labels
    return levels.withColumn(
        "problem",
        F.when(large & (F.col("representatives") >= F.col("labels")), "merged_nothing")
        .when(large & (F.col("level") >= limits.max_levels - 1), "too_many_levels"),
    ).filter("problem is not null")


def compose_levels(labels: DataFrame, label_map: DataFrame, limits: LabelLimits = LabelLimits()) -> DataFrame:
    """Final representative of each label: every level applied once, in order.

    ``canonical`` is NULL where a level of the scope does not map what the level
    before it gave.
    """
    depth = label_map.groupBy(*SCOPE).agg(F.max("level").alias("_depth"))
    walked = labels.join(depth, SCOPE, "left").withColumn("canonical", F.col("label"))
    for level in range(limits.max_levels):
        hop = label_map.filter(F.col("level") == level).select(
            *SCOPE, F.col("label").alias("canonical"), F.col("representative").alias("_next"))
        walked = walked.join(hop, [*SCOPE, "canonical"], "left").withColumn(
            "canonical",
            F.when(F.coalesce("_depth", F.lit(0)) >= level, F.col("_next")).otherwise(F.col("canonical")),
        ).drop("_next")
    return walked.select(*labels.columns, "canonical")


def composition_problems(composed: DataFrame) -> DataFrame:
    """Scopes with a level that does not map every label, or with a final label nobody offered."""
    offered = composed.select(*SCOPE, F.col("label").alias("canonical")).distinct()
    lost = composed.filter("canonical is null").select(*SCOPE, F.lit("a level does not map every label").alias("problem"))
    invented = composed.filter("canonical is not null").join(offered, [*SCOPE, "canonical"], "left_anti").select(
        *SCOPE, F.lit("a canonical label was never offered").alias("problem"))
    return lost.unionByName(invented).groupBy(*SCOPE).agg(F.min("problem").alias("problem"))


def canonical_labels(composed: DataFrame) -> DataFrame:
    """Final labels of a scope in order of first appearance."""
    firsts = composed.groupBy(*SCOPE, "canonical").agg(F.min("label_pos").alias("first_pos"))
    return with_position(firsts, SCOPE, ["first_pos"], "position").drop("first_pos")


def canonical_tags(tags: DataFrame, composed: DataFrame) -> DataFrame:
    """Tags under their final label, with the raw label kept beside it.

    Raw tags have ``theme``, canonical ones ``canonical_theme``, so the aggregates
    cannot take one for the other. The map is joined, never collected; its true
    size, once it is written, decides how.
    """
    keyed = composed.select(*SCOPE, "theme_key", "canonical")
    named = tags.join(keyed, [*SCOPE, "theme_key"], "left")
    return named.select(
        *SCOPE, "review_id", *TAG_ORDER, "sentiment", "evidence",
        F.col("canonical").alias("canonical_theme"),
        label_key(F.col("canonical")).alias("canonical_key"),
        F.col("theme").alias("raw_theme"),
        F.col("theme_key").alias("raw_key"),
    )


def unmapped_tags(canonical: DataFrame) -> DataFrame:
    return canonical.filter("canonical_theme is null").select(*SCOPE, "raw_key").distinct()
