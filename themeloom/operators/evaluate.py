"""Quality figures over tag tables: validity, mixed opinions, merging, stability, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.storage import settle, with_position


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row aggregates as one row: their figures are summed under each name, never joined."""
    named = [r.select(F.explode(F.map_from_arrays(
        F.array(*map(F.lit, r.columns)), F.array(*[F.col(c).cast("long") for c in r.columns]))).alias("name", "value")) for r in rows]
    every = named[0]
    for r in named[1:]:
        every = every.unionByName(r)
    return every.agg(*[F.sum(F.when(F.col("name") == c, F.col("value"))).alias(c) for r in rows for c in r.columns])


def evidence_validity(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Valid tags among valid and rejected ones."""
    sums = outcomes.groupBy(*by).agg(F.sum("valid").alias("valid"), F.sum("rejected").alias("rejected"))
    return sums.withColumn(
        "evidence_validity", _rate(F.col("valid"), F.col("valid") + F.col("rejected")))


def mixed_recall(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """How well praise and fault of one review are told apart (one row).

    A mixed review is hit when a praise tag lies in the praise clause, a fault tag
    in the fault clause, and their themes differ. Per review, side and theme a flag
    is enough: two sides differ unless both have just one theme and it is the same.
    So the tags of a review are aggregated, never paired.
    """
    inside = lambda clause: F.coalesce(F.contains(F.col(clause), F.col("evidence")), F.lit(False))
    side = (
        F.when((F.col("sentiment") == "praise") & inside("praise_clause"), "praise")
        .when((F.col("sentiment") == "fault") & inside("fault_clause"), "fault"))
    wrong = (
        ((F.col("sentiment") == "praise") & inside("fault_clause"))
        | ((F.col("sentiment") == "fault") & inside("praise_clause")))
    tagged = labels.join(tags.select("review_id", "theme_key", "sentiment", "evidence"), "review_id")
    mixed = tagged.filter("kind = 'mixed'").select(
        "review_id", "theme_key", side.alias("side"), wrong.cast("long").alias("wrong"))
    themes = mixed.groupBy("review_id", "side", "theme_key").agg(F.sum("wrong").alias("wrong"))
    praise, fault = F.col("side") == "praise", F.col("side") == "fault"
    key_of = lambda is_side, pick: pick(F.when(is_side, F.col("theme_key")))
    per_review = themes.groupBy("review_id").agg(
        F.sum("wrong").alias("wrong"),
        key_of(praise, F.min).alias("p_lo"), key_of(praise, F.max).alias("p_hi"),
        key_of(fault, F.min).alias("f_lo"), key_of(fault, F.max).alias("f_hi"))
    same = (F.col("p_lo") == F.col("p_hi")) & (F.col("f_lo") == F.col("f_hi")) & (F.col("p_lo") == F.col("f_lo"))
    hits = per_review.agg(
        F.count_if(F.col("p_lo").isNotNull() & F.col("f_lo").isNotNull() & ~same).alias("mixed_hits"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("misattributed"))
    controls = tagged.filter("kind <> 'mixed'").agg(F.count_if(
        F.col("sentiment") == F.when(F.col("kind") == "praise-only", "fault").otherwise("praise")
    ).alias("control_violations"))
    total = labels.agg(F.count_if(F.col("kind") == "mixed").alias("mixed_reviews"))
    return _side_by_side(total, hits, controls).select(
        "mixed_reviews", "mixed_hits", "misattributed", "control_violations",
        F.coalesce(_rate(F.col("mixed_hits"), F.col("mixed_reviews")), F.lit(0.0)).alias("mixed_recall"))


#: Rows of a key that meet in one task; the rows of more are dealt over a square of tiles.
TILE_ROWS = 4_096


def _pairs(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2)


def key_signatures(tags: DataFrame, clusters: DataFrame) -> DataFrame:
    """How many labelled reviews of a cluster have the same set of theme keys, as ranks, most frequent first.

    Reviews that agree in both become one row, so a mass of copies costs nothing.
    """
    held = settle(tags.select("review_id", "theme_key").distinct().join(clusters.select("review_id", "cluster"), "review_id"), "labelled-keys")
    frequency = held.groupBy("theme_key").agg((-F.count("*")).alias("_often"))
    ranks = settle(with_position(frequency, [], ["_often", "theme_key"], "rank").select("theme_key", "rank"), "key-ranks")
    return (held.join(ranks, "theme_key").groupBy("review_id", "cluster").agg(F.array_sort(F.collect_list("rank")).alias("keys"))
            .groupBy("cluster", "keys").agg(F.count("*").alias("n")))


def _merged(rows: DataFrame, by: list[str], name: str, tile_rows: int) -> DataFrame:
    """Pairs of reviews under equal ``by`` whose sets ``before`` have nothing in common (one row).

    Reviews with nothing before are pairs of each other by count; all others by rows, in tiles.
    """
    sized = rows.join(rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.ceil(F.count("*") / tile_rows).alias("tiles")),
                      [F.col(c) == F.col(f"_{c}") for c in by])
    dealt = sized.select(*by, "before", "n", "tiles", F.pmod(F.xxhash64("before"), F.col("tiles")).alias("tile"))
    side = lambda x, own, other, tiles: dealt.select(
        *by, F.col("before").alias(f"before_{x}"), F.col("n").alias(f"n_{x}"), F.col("tile").alias(own), F.explode(tiles).alias(other))
    left = side("a", "i", "j", F.sequence("tile", F.col("tiles") - 1))
    right = side("b", "j", "i", F.sequence(F.lit(0).cast("long"), F.col("tile")))
    apart = ((F.col("i") < F.col("j")) | (F.col("before_a") < F.col("before_b"))) & ~F.arrays_overlap("before_a", "before_b")
    met = left.join(right, [*by, "i", "j"]).filter(apart).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))
    alone = rows.filter(F.size("before") == 0).agg(F.sum(_pairs(F.col("n"))).alias("n"))
    return met.unionByName(alone).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(name))


def merge_rates(tags: DataFrame, clusters: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Share of same-cluster and of cross-cluster pairs that have a theme in common.

    A pair is counted at the most frequent key that it shares, and there only: what its reviews have
    *before* that key, their more frequent ones, has nothing in common. So at each key, reviews with the
    same keys before it are one row. A very frequent key has few keys before it and hence few rows,
    however many reviews have it, and a rare one has few reviews; pairs of rows are summed up
    where they meet and never put out.
    """
    held = settle(key_signatures(tags, clusters), "signatures")
    at_key = held.select("cluster", "n", "keys", F.posexplode("keys").alias("_at", "key")).select(
        "cluster", "key", F.slice("keys", F.lit(1), F.col("_at")).alias("before"), "n")
    same = settle(at_key.groupBy("cluster", "key", "before").agg(F.sum("n").alias("n")), "cluster-keys")
    every = settle(same.groupBy("key", "before").agg(F.sum("n").alias("n")), "all-keys")
    totals = clusters.groupBy("cluster").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0)).alias("same_pairs"),
        F.coalesce(_pairs(F.sum("n")), F.lit(0)).alias("all_pairs"))
    row = _side_by_side(totals, _merged(same, ["cluster", "key"], "same_merged", tile_rows), _merged(every, ["key"], "all_merged", tile_rows))
    merged_cross = F.col("all_merged") - F.col("same_merged")
    cross = F.col("all_pairs") - F.col("same_pairs")
    rate = lambda part, whole: F.coalesce(_rate(part, whole), F.lit(0.0))
    return row.select(
        "same_pairs", "same_merged", cross.alias("cross_pairs"),
        merged_cross.alias("cross_merged"),
        rate(F.col("same_merged"), F.col("same_pairs")).alias("true_merge_rate"),
        rate(merged_cross, cross).alias("false_merge_rate"))


def scorable(run_keys: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Theme keys of runs that neither timed out nor failed; a run without tags has no keys and so is not there."""
    sound = runs.filter(~F.coalesce("timed_out", F.lit(False)) & ~F.coalesce("errored", F.lit(False))).select(*by, "run").distinct()
    return run_keys.join(sound, [*by, "run"], "left_semi")


def theme_stability(run_keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean Jaccard similarity of the theme sets of repeated runs.

    ``run_keys`` has (by, run, theme_key), only of runs that produced tags, see ``scorable``. The keys of an
    experiment are numbered and a run's set becomes a bitmap of 64-bit words, so two sets are
    compared by counting bits; runs with the same set are one row with a weight. NULL where an
    experiment has a single run.
    """
    keys = settle(run_keys.select(*by, "run", "theme_key").distinct(), "run_keys")
    numbered = settle(with_position(keys.select(*by, "theme_key").distinct(), list(by), ["theme_key"], "_bit"), "run-key-bits")
    words = keys.join(numbered, [*by, "theme_key"]).groupBy(*by, "run", F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    sets = words.groupBy(*by, "run").agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("words")).groupBy(
        *by, "words").agg(F.count("*").alias("w"))
    sized = settle(sets.withColumn("n", F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x["_bits"]))), "run-sets")
    side = lambda x: sized.select(*by, F.col("words").alias(f"words_{x}"), F.col("w").alias(f"w_{x}"), F.col("n").alias(f"n_{x}"))
    bits_of = F.map_from_entries("words_b")
    both = F.aggregate("words_a", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(
        x["_bits"].bitwiseAND(F.coalesce(F.try_element_at(F.col("_b"), x["_word"]), F.lit(0)))))
    pairs = side("a").join(side("b"), list(by)).filter("words_a < words_b").withColumn("_b", bits_of).withColumn("both", both)
    apart = pairs.select(*by, (F.col("w_a") * F.col("w_b") * F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("_sum"))
    alike = sized.select(*by, _pairs(F.col("w")).cast("double").alias("_sum"))
    sums = apart.unionByName(alike).groupBy(*by).agg(F.sum("_sum").alias("_sum"))
    runs = sized.groupBy(*by).agg(F.sum("w").alias("runs"))
    return runs.join(sums, list(by), "left").select(
        *by, "runs",
        F.when(F.col("runs") > 1, F.coalesce("_sum", F.lit(0.0)) / _pairs(F.col("runs"))).alias("stability"))


def with_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost_usd`` from the price per million tokens of the run's model."""
    return runs.join(prices, "model").withColumn(
        "cost_usd",
        F.col("input_tokens") / 1e6 * F.col("input_usd") + F.col("output_tokens") / 1e6 * F.col("output_usd")
    ).drop("input_usd", "output_usd")


#: Figures of a run that a summary averages, where the runs have them.
QUALITY = ("evidence_validity", "distinct_themes", "mixed_recall", "misattributed", "control_violations", "true_merge_rate", "false_merge_rate")


def run_summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means, middle and longest latency, stop reasons and failures per experiment, and means of the ``QUALITY`` figures there are.

    A mean is over the runs that have a figure, NULL if none has. Stop reasons are the distinct
    ones, in order, a run without one counting as NULL that is listed last.

    The middle is the element at floor(n/2) of the sorted latencies. It is found
    from counts per distinct latency, so no list of runs is gathered.
    """
    base = runs.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.avg("input_tokens").alias("avg_input_tokens"),
        F.avg("output_tokens").alias("avg_output_tokens"),
        F.avg("cost_usd").alias("avg_cost_usd"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.count_if("timed_out").alias("timeouts"),
        F.count_if("errored").alias("errors"),
        F.count_if(F.col("stop_reason") == "max_tokens").alias("truncated"),
        F.count_if("parse_error").alias("parse_errors"),
        F.array_sort(F.collect_set(F.coalesce("stop_reason", F.lit("\U0010ffff")))).alias("stop_reasons"),
        *[F.avg(c).alias(f"avg_{c}") for c in QUALITY if c in runs.columns],
    ).withColumn("stop_reasons", F.transform("stop_reasons", lambda r: F.when(r != "\U0010ffff", r)))
    counts = runs.groupBy(*by, "latency_ms").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    middle = counts.withColumn("_upto", F.sum("n").over(upto)).join(
        base.select(*by, "runs"), list(by)).filter(F.col("_upto") > F.floor(F.col("runs") / 2)).groupBy(
        *by).agg(F.min("latency_ms").alias("middle_latency_ms"))
    return base.join(middle, list(by))
