"""Sizing and quality figures against hand-computed or brute-force values."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from themeloom.model import BatchLimits, DEMO_CEILING, Sizing
from themeloom.operators import evaluate, sizing


def selection(spark, sizes):
    rows = [("category", "C", None, i, f"r{i:03}", s) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "scope_kind string, scope_key string, review_date date, row_pos long, "
                                 "review_id string, text_bytes long")


def greedy(sizes, limits):
    batches, used = [], 0
    for i, size in enumerate(sizes):
        new = not batches or len(batches[-1]) == limits.max_rows or used + size > limits.max_bytes
        if new:
            batches.append([])
            used = 0
        batches[-1].append(i)
        used += size
    return batches


@pytest.mark.parametrize("slice_rows", (1, 7, 50, 10_000))
def test_batches_are_greedy_whatever_the_slices(spark, slice_rows):
    rng = random.Random(slice_rows)
    limits = BatchLimits(max_rows=4, max_bytes=100)
    for count in (157, 50, 9, 1):
        sizes = [rng.choice([1, 30, 40, 90, 100, 101, 500]) for _ in range(count)]
        batches = sizing.bounded_batches(selection(spark, sizes), limits, slice_rows)
        got = {}
        for r in batches.collect():
            got.setdefault(r.batch_no, []).append(r.sel_pos)
            assert r.oversized == (r.text_bytes > 100)
        assert [sorted(got[k]) for k in sorted(got)] == greedy(sizes, limits)
        assert sizing.batch_counts(batches).first().filled_batches == len(got)


def test_batches_of_many_scopes_through_a_deep_tree(spark, monkeypatch):
    """Slices of four rows, composed by threes: scopes of up to seven levels, of which one has no key."""
    monkeypatch.setattr(sizing, "FAN", 3)
    rng, limits = random.Random(8), BatchLimits(max_rows=4, max_bytes=100)
    scopes = {("product", None): 300, ("product", "a"): 700, ("category", "a"): 1, ("category", "b"): 5, ("category", "c"): 12}
    sizes = {k: [rng.choice([0, 1, 30, 40, 90, 100, 101, 500]) for _ in range(n)] for k, n in scopes.items()}
    rows = [(*k, None, i, f"r{i}", size) for k, own in sizes.items() for i, size in enumerate(own)]
    df = spark.createDataFrame(rows, "scope_kind string, scope_key string, review_date date, row_pos long, review_id string, text_bytes long").repartition(5)
    got = {}
    for r in sizing.bounded_batches(df, limits, 4).collect():
        got.setdefault((r.scope_kind, r.scope_key), {}).setdefault(r.batch_no, []).append(r.sel_pos)
    assert {k: [sorted(v[b]) for b in sorted(v)] for k, v in got.items()} == {k: greedy(own, limits) for k, own in sizes.items()}
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    assert sizing.bounded_batches(df.limit(0), limits, 4).isEmpty()


def estimate(spark, rows, size, filled=0, **kw):
    sizes = spark.createDataFrame([("c", "k", rows, size)], "scope_kind string, scope_key string, rows long, text_bytes long")
    batches = spark.createDataFrame([("c", "k", filled)], "scope_kind string, scope_key string, filled_batches long")
    return sizing.run_estimates(sizes, batches, Sizing(**kw)).first()


def test_cost_of_a_run(spark):
    made = estimate(spark, 25, 2814, filled=3)
    assert made.output_tokens == 3372 and made.batches == 9 and made.labels == 28
    tagging = (2814 * 0.44 + 9 * 760) / 1e6 * 5 + 3372 / 1e6 * 25
    label = (28 * 6 + 760) / 1e6 * 5 + 28 * 3 / 1e6 * 25
    assert made.total_usd == pytest.approx(tagging * 1.1 + label) and made.decision == "go"
    assert made.tokens_per_row == 3372 / 25


def test_decisions(spark):
    assert estimate(spark, 0, 0).decision == "empty" and estimate(spark, 0, 0).total_usd == 0
    assert estimate(spark, 601, 1000).decision == "refuse_rows"
    assert estimate(spark, 61, 1000, ceiling=DEMO_CEILING).decision == "refuse_rows"
    assert estimate(spark, 100, 97_000).decision == "confirm"
    deep = estimate(spark, 600, 600_000)
    assert deep.labels == 2017 and not deep.labels_fit and deep.decision == "refuse_labels"
    wide = estimate(spark, 600, 100_000)
    assert wide.labels == 746 and wide.labels_fit and wide.label_requests == 3 + 2 + 1


TAGS = "review_id string, theme_key string, sentiment string, evidence string"


def test_mixed_recall(spark):
    labels = spark.createDataFrame(
        [("a", "mixed", "nice light", "bad switch"), ("b", "mixed", "nice light", "bad switch"),
         ("c", "mixed", "x", "y"), ("d", "praise-only", None, None), ("e", "fault-only", None, None)],
        "review_id string, kind string, praise_clause string, fault_clause string")
    tags = spark.createDataFrame(
        [("a", "light", "praise", "nice"), ("a", "switch", "fault", "bad"), ("a", "switch", "praise", "switch"),
         ("b", "light", "praise", "nice"), ("b", "light", "fault", "bad"),
         ("d", "k", "fault", "q"), ("e", "k", "praise", "q"), ("e", "k", "fault", "q")], TAGS)
    made = evaluate.mixed_recall(tags, labels).first()
    assert (made.mixed_reviews, made.mixed_hits, made.misattributed, made.control_violations) == (3, 1, 1, 2)
    assert evaluate.mixed_recall(tags.limit(0), labels.limit(0)).first().mixed_recall == 0.0


@pytest.mark.parametrize("seed, most, tile_rows", [(1, 4, evaluate.TILE_ROWS), (2, 12, 7), (3, 18, evaluate.TILE_ROWS), (4, 30, 3)])
def test_merge_rates_against_all_pairs(spark, seed, most, tile_rows):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(max(20, 3 * most))]
    held = {f"r{i}": (rng.choice("xyz"), frozenset(rng.sample(keys, rng.randint(0, most)))) for i in range(60)}
    held.update({f"copy{i}": ("x", frozenset(keys[:most])) for i in range(30)})
    tags = spark.createDataFrame([(r, k) for r, (_, ks) in held.items() for k in ks], "review_id string, theme_key string")
    clusters = spark.createDataFrame([(r, c) for r, (c, _) in held.items()], "review_id string, cluster string")
    same = cross = same_hit = cross_hit = 0
    for (ca, ka), (cb, kb) in itertools.combinations(held.values(), 2):
        hit = bool(ka & kb)
        same, same_hit = same + (ca == cb), same_hit + (ca == cb and hit)
        cross, cross_hit = cross + (ca != cb), cross_hit + (ca != cb and hit)
    made = evaluate.merge_rates(tags, clusters, tile_rows).first()
    assert (made.same_pairs, made.same_merged, made.cross_pairs, made.cross_merged) == (same, same_hit, cross, cross_hit)


def test_stability(spark):
    rows = [("m", 1, "a"), ("m", 1, "b"), ("m", 2, "b"), ("m", 3, "c"), ("solo", 1, "a")]
    made = evaluate.theme_stability(
        spark.createDataFrame(rows, "model string, run int, theme_key string"), ["model"]).collect()
    assert {r.model: r.stability for r in made} == {"m": pytest.approx(0.5 / 3), "solo": None}


def test_stability_against_all_pairs_of_runs(spark):
    rng = random.Random(4)
    runs = {(m, i): frozenset(rng.sample([f"k{x}" for x in range(200)], rng.choice([1, 3, 90]))) for m in "mn" for i in range(9)}
    runs["m", 50] = runs["m", 51] = runs["m", 0]
    runs |= {("late", i): frozenset({"k1", f"k{i}"}) for i in range(4)}
    keys = spark.createDataFrame([(m, i, k) for (m, i), ks in runs.items() for k in ks], "model string, run int, theme_key string")
    state = spark.createDataFrame([(m, i, m == "late" and i == 2 or None, i == 1 and m == "n") for m, i in runs], "model string, run int, timed_out boolean, errored boolean")
    sound = {k: v for k, v in runs.items() if k != ("late", 2) and k != ("n", 1)}
    made = {r.model: (r.runs, r.stability) for r in evaluate.theme_stability(evaluate.scorable(keys, state, ["model"]), ["model"]).collect()}
    for m in ("m", "n", "late"):
        own = [v for (x, _), v in sound.items() if x == m]
        mean = [len(a & b) / len(a | b) for a, b in itertools.combinations(own, 2)]
        assert made[m] == (len(own), pytest.approx(sum(mean) / len(mean)))


def test_stop_reasons_and_quality_of_runs(spark):
    rows = [("m", "end", 0.5), ("m", "max_tokens", None), ("m", None, 1.0), ("m", "end", 0.0), ("n", None, None)]
    runs = spark.createDataFrame([(m, 1, 1, 5, False, False, s, False, 0.0, q) for m, s, q in rows],
                                 "model string, input_tokens long, output_tokens long, latency_ms long, timed_out boolean, errored boolean, "
                                 "stop_reason string, parse_error boolean, cost_usd double, evidence_validity double")
    made = {r.model: r for r in evaluate.run_summary(runs, ["model"]).collect()}
    assert made["m"].stop_reasons == ["end", "max_tokens", None] and made["m"].avg_evidence_validity == 0.5
    assert made["n"].stop_reasons == [None] and made["n"].avg_evidence_validity is None
    assert "avg_misattributed" not in made["m"]


def test_run_summary(spark):
    rows = [("m", 1000 * (i + 1), 500, ms, ms > 30_000, False, "end", False) for i, ms in enumerate([400, 100, 100, 31_000])]
    runs = spark.createDataFrame(rows, "model string, input_tokens long, output_tokens long, latency_ms long, "
                                 "timed_out boolean, errored boolean, stop_reason string, parse_error boolean")
    prices = spark.createDataFrame([("m", 5.0, 25.0)], "model string, input_usd double, output_usd double")
    made = evaluate.run_summary(evaluate.with_cost(runs, prices), ["model"]).first()
    assert (made.runs, made.middle_latency_ms, made.max_latency_ms, made.timeouts) == (4, 400, 31_000, 1)
    assert made.avg_cost_usd == pytest.approx(2500 / 1e6 * 5 + 500 / 1e6 * 25)


def test_validity(spark):
    df = spark.createDataFrame([("m", 3, 1), ("m", 1, 0), ("n", 0, 0)], "model string, valid long, rejected long")
    made = {r.model: r.evidence_validity for r in evaluate.evidence_validity(df, ["model"]).collect()}
    assert made == {"m": 0.8, "n": None}
