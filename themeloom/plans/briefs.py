"""One brief per scope: counts, praise, faults, quotes, advice and promotions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.numbers import mean_to_tenth, one_decimal
from themeloom.functions.text import lower_first
from themeloom.model import DateWindow, LabelLimits, Theme, Unit
from themeloom.operators import labels as lab
from themeloom.operators import promotions as promo
from themeloom.operators import tag_findings as tf
from themeloom.operators import themes
from themeloom.operators.scopes import expand_scopes, in_window, scope_list
from themeloom.operators.vocabulary import Index, indexed
from themeloom.storage import settle

SCOPE = ["scope_kind", "scope_key"]


def unit_noun(count: Column, unit: Unit) -> Column:
    return F.when(count == 1, unit.one).otherwise(unit.many)


def theme_phrase(noun: str, unit: Unit) -> str:
    """Only rows of single customers can make a theme recur."""
    return noun if unit.product_level else f"recurring {noun}"


def scope_phrase(dated: Column, unit: Unit) -> Column:
    return F.when(dated, "between these dates").otherwise(f"among these {unit.many}")


def summary(unit: Unit) -> Column:
    """The sentence on top of a brief, from its counts and its leading findings."""
    n, subject = F.col("review_count"), F.col("subject")
    top, bottom = F.try_element_at("praise", F.lit(1)), F.try_element_at("faults", F.lit(1))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    stars = one_decimal(F.col("average_rating"))
    count = n.cast("string")
    intro = F.when(n == 1, text(f"One {unit.one} of ", subject, ", rated ", stars, "★: ")).otherwise(
        text(count, f" {unit.many} of ", subject, ", ", stars, "★ on average: "))
    support = lambda f: F.when(n == 1, F.lit("")).otherwise(
        text(" (", f["mentions"].cast("string"), " of ", count, ")"))
    liked = text(lower_first(top["label"]), " is praised most", support(top))
    faulted = text(lower_first(bottom["label"]), " is faulted most", support(bottom))
    where = scope_phrase(F.col("dated"), unit)
    return (
        F.when(n == 0, text(f"No {unit.many} of ", subject, " were selected."))
        .when(top["label"] == bottom["label"], text(
            intro, "opinions differ most on ", lower_first(top["label"]), " (",
            top["mentions"].cast("string"), " for, ", bottom["mentions"].cast("string"), " against)."))
        .when(top.isNotNull() & bottom.isNotNull(), text(intro, liked, "; ", faulted, "."))
        .when(top.isNotNull(), text(
            intro, liked, f". No {theme_phrase('complaints', unit)} have enough support ", where, "."))
        .when(bottom.isNotNull(), text(intro, faulted, ". Too little praise has support ", where, "."))
        .otherwise(text(intro, f"no theme has enough support; the {unit.many} differ."))
    )


def _listed(found: DataFrame, advice: DataFrame) -> DataFrame:
    """Findings and advice per scope as ordered lists of at most one entry per theme."""
    entry = F.struct("rank", "label", "mentions", "percent", "quote", "quote_author")
    side = lambda p: F.array_sort(F.collect_list(F.when(F.col("polarity") == p, entry)))
    lists = found.groupBy(*SCOPE).agg(
        side(themes.POSITIVE).alias("praise"), side(themes.NEGATIVE).alias("faults"))
    steps = advice.groupBy(*SCOPE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "advice"))),
                    lambda s: s["advice"]).alias("recommendations"))
    return lists.join(steps, SCOPE, "left")


def assemble(
    scopes: DataFrame, totals: DataFrame, found: DataFrame, advice: DataFrame,
    promoted: DataFrame | None, unit: Unit, window: DateWindow | None,
) -> DataFrame:
    """Every scope with its lists; a scope with nothing selected has empty ones."""
    listed = _listed(found, advice)
    out = scopes.join(totals, SCOPE, "left").join(listed, SCOPE, "left")
    if promoted is not None:
        packed = promoted.select(*SCOPE, F.struct(
            "promo_count", "full_price_count", "promo_average", "full_price_average",
            "rating_delta", "label_count", "promotions", "comparable", "note").alias("promotion"))
        out = out.join(packed, SCOPE, "left")
    zero = F.lit(0).cast("long")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(listed.schema[c].dataType)).alias(c)
    rows = F.coalesce("selected", zero)
    return out.select(
        *SCOPE, "subject",
        F.lit(window.start if window else None).cast("date").alias("window_start"),
        F.lit(window.end if window else None).cast("date").alias("window_end"),
        rows.alias("review_count"),
        mean_to_tenth(F.coalesce("stars", zero), rows).alias("average_rating"),
        ((rows > 0) & (F.col("dated") == rows)).alias("dated"),
        empty("praise"), empty("faults"), empty("recommendations"),
        *(["promotion"] if promoted is not None else []),
    ).withColumn("summary", summary(unit))


def rule_briefs(
    reviews: DataFrame, products: DataFrame, vocabulary: Sequence[Theme] | Index, unit: Unit,
    window: DateWindow | None = None,
) -> DataFrame:
    """The rule engine for every product and category in one job.

    Products and totals are needed in several places, so they are written once; the
    joins with them then follow their true size.
    """
    products = settle(products, "products")
    selected, vocabulary = in_window(reviews, window), indexed(reviews.sparkSession, vocabulary)
    totals = settle(themes.scope_totals(selected, products), "totals")
    ranked = themes.findings(reviews, products, vocabulary, unit, window, totals)
    found = settle(themes.with_quotes(ranked, reviews, vocabulary), "quoted")
    return assemble(
        scope_list(products), totals, found, themes.recommendations(found, vocabulary),
        promo.promotions(selected, products), unit, window)


def scoped_tags(
    tags: DataFrame, reviews: DataFrame, products: DataFrame, window: DateWindow | None = None
) -> DataFrame:
    """Valid tags under the scopes of their review, with its place in the selection."""
    rows = in_window(reviews, window).select("review_id", "product_id", "review_date", "row_pos")
    return expand_scopes(tags.join(rows, "review_id"), products).drop("product_id")


def reconciled_tags(
    tags: DataFrame, group: lab.Grouper, limits: LabelLimits = LabelLimits()
) -> tuple[DataFrame, DataFrame]:
    """Scoped tags under their reconciled labels, and (scope, problem) of scopes left out of them.

    Labels are merged before grouping. A scope whose labels cannot be reconciled has no tags in
    the result and its reason in the second table; the others are complete.
    """
    offered = settle(lab.distinct_labels(tags), "labels")
    label_map, failed = lab.reconcile(offered, group, limits)
    composed = settle(
        lab.compose_levels(offered.join(failed, SCOPE, "left_anti"), label_map, limits), "composed")
    problems = settle(failed.unionByName(lab.composition_problems(composed)), "reconciling_problems")
    sound = composed.join(problems, SCOPE, "left_anti")
    return lab.canonical_tags(tags.join(problems, SCOPE, "left_anti"), sound), problems


def tag_briefs(
    tags: DataFrame, reviews: DataFrame, products: DataFrame, group: lab.Grouper, unit: Unit,
    window: DateWindow | None = None, limits: LabelLimits = LabelLimits(),
) -> DataFrame:
    """The tag engine for every product and category in one job.

    ``problem`` says why a scope has no findings although it has tags; NULL elsewhere. Scoped tags are written once: labels and findings both read them, and grounding
    them in their texts is the dear part.
    """
    products = settle(products, "products")
    totals = settle(themes.scope_totals(in_window(reviews, window), products), "totals")
    scoped = settle(scoped_tags(tags, reviews, products, window), "scoped_tags")
    named, problems = reconciled_tags(scoped, group, limits)
    canonical = settle(named, "canonical_tags")
    found = settle(tf.with_authors(tf.tag_findings(canonical, totals, unit), reviews), "credited")
    made = assemble(scope_list(products), totals, found, tf.derived_advice(found, unit), None, unit, window)
    return made.join(problems, SCOPE, "left")
