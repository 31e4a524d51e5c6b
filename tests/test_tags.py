"""Tag engine: parsing, grounding, labels, findings and audits."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from themeloom.corpora import VOCABULARY
from themeloom.model import LabelLimits, PRODUCT_RECORD, REVIEW, TagError
from themeloom.operators import labels, tag_findings, tags

SCOPE = ("category", "C")


def tag(review_id, theme, sentiment="praise", evidence="good"):
    return {"review_id": review_id, "theme": theme, "sentiment": sentiment, "evidence_span": evidence}


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(
        [("r1", "a good lamp", 1), ("r2", "Good but dim", 2), ("r3", "dim", 3)],
        "review_id string, text string, row_pos long").withColumns({
            "review_date": F.lit(dt.date(2026, 1, 1)), "product_id": F.lit("p"), "author": F.lit("A"),
            "verified": F.lit(True), "country": F.lit(None).cast("string")})


def raw(spark, *payloads):
    return spark.createDataFrame([("run", i, p) for i, p in enumerate(payloads)],
                                 "run_id string, batch_id long, payload string")


def gate(spark, reviews, *payloads):
    parsed = tags.parse_responses(raw(spark, *payloads))
    found = tags.entries(parsed)
    valid = tags.validate(found, reviews)
    rows = tags.outcomes(parsed, found, valid).orderBy("batch_id").collect()
    return [(r.entries, r.valid, r.rejected, r.deduped, r.verdict) for r in rows], valid


def test_payload_shapes(spark, reviews):
    ok = json.dumps([tag("r1", "Lamp")])
    made, _ = gate(
        spark, reviews, ok, f"  ```json\n{ok}\n```\n", f"```\n{ok}\n```", "not json", '{"tags": []}', "[]",
        ok + " trailing", "[1", '"text"', "null", "", ok + ok, ok + ", 1", ok + "]", ok + "}", "[]] , [[]",
        ok + ', "x": 1', "[]] x", "[] } x")
    assert [m[4] for m in made] == ["clean"] * 3 + ["unusable"] * 2 + ["clean"] + ["unusable"] * 13
    assert made[5][:4] == (0, 0, 0, 0)


def test_entry_checks(spark, reviews):
    bad = [None, "junk", 7, [], tag("", "x"), tag("r1", "  "), tag("r1", 5), tag(1, "x"), tag("r1", "x", "angry"),
           tag("r1", "x", evidence=""), tag("r9", "x"), tag("r2", "x"), tag("r1", "x", evidence="Good"),
           {"review_id": "r1", "theme": "x", "sentiment": "praise"}]
    good = [tag("r1", " Light  Output "), tag("r1", "light output", evidence="lamp"), tag("r1", "light output", "fault"),
            tag("r2", "Dim", "neutral", "dim")]
    made, valid = gate(spark, reviews, json.dumps(bad + good), json.dumps(bad), json.dumps([tag("r1", "a")]))
    assert made == [(18, 3, 14, 1, "not_strict"), (14, 0, 14, 0, "all_rejected"), (1, 1, 0, 0, "clean")]
    kept = valid.filter("batch_id = 0 and theme_key = 'light output' and sentiment = 'praise'").first()
    assert (kept.theme, kept.evidence, kept.copies) == ("Light  Output", "good", 2)


def test_a_failing_response_takes_only_its_own_tags(spark, reviews):
    twice = json.dumps([tag("r1", "a"), tag("r1", "A")])
    accepted, refused = tags.accept_tags(raw(spark, twice, "oops"), reviews)
    assert [r.batch_id for r in accepted.collect()] == [0]
    assert [(r.batch_id, r.verdict) for r in refused.collect()] == [(1, "unusable")]
    accepted, refused = tags.accept_tags(raw(spark, twice), reviews, strict=True)
    assert accepted.isEmpty() and refused.first().verdict == "not_strict"


def test_tags_of_other_batches_are_rejected(spark, reviews):
    payload = json.dumps([tag("r1", "a"), tag("r2", "b")])
    asked = spark.createDataFrame([(0, "r1"), (1, "r2")], "batch_id long, review_id string")
    accepted, _ = tags.accept_tags(raw(spark, payload), reviews, batches=asked)
    assert [r.review_id for r in accepted.collect()] == ["r1"]


def test_tagger_sees_checked_text_only(spark, reviews):
    assert tags.tagger_input(reviews).columns == ["review_id", "text"]
    text = spark.createDataFrame([("a", "Good in May. Dim at night. From here")], "review_id string, text string")
    made = sorted(map(tuple, tags.keyword_tags(text, VOCABULARY, ["good"], ["dim"]).collect()))
    assert made == [("a", "origin", "neutral", "From here"), ("a", "place", "fault", "Dim at night."),
                    ("a", "place", "praise", "Good in May.")]
    with pytest.raises(TagError, match="repeated_id"):
        tags.keyword_tags(text.unionByName(text), VOCABULARY, ["good"], ["dim"])
    blank = spark.createDataFrame([(" ", "x"), ("b", " ")], "review_id string, text string")
    assert {r.problem for r in tags.input_problems(blank).collect()} == {"blank_id", "blank_text"}


def coverage(spark, selected, batches):
    chosen = spark.createDataFrame([(r, i) for i, r in enumerate(selected)], "review_id string, sel_pos long")
    held = spark.createDataFrame([(b, i, r) for b, rows in enumerate(batches) for i, r in enumerate(rows)],
                                 "batch_id long, pos long, review_id string")
    return sorted((r.problem, r.review_id) for r in tags.coverage_problems(chosen, held).collect())


def test_coverage(spark):
    assert coverage(spark, "abcd", ["ab", "cd"]) == []
    assert coverage(spark, "abcd", ["ab", "d"]) == [("missing", "c")]
    assert coverage(spark, "abc", ["ab", "bc"]) == [("duplicated", "b")]
    assert coverage(spark, "abc", ["ac", "b"]) == [("out_of_order", "b"), ("out_of_order", "c")]
    assert coverage(spark, "abc", ["ba", "a"]) == [("duplicated", "a"), ("missing", "c"), ("out_of_order", "a"), ("out_of_order", "b")]


# -- labels -------------------------------------------------------------------


def label_table(spark, names, scope=SCOPE):
    return spark.createDataFrame([(*scope, n.lower(), n, i) for i, n in enumerate(names)],
                                 "scope_kind string, scope_key string, theme_key string, label string, label_pos long")


def grouping(spark, *chunks):
    return spark.createDataFrame([(*SCOPE, i, g) for i, g in enumerate(chunks)],
                                 "scope_kind string, scope_key string, chunk int, groups array<array<int>>")


@pytest.mark.parametrize("groups, problem", [
    ([[0, 2], [1]], None), ([[0], [1], [2]], None), ([[2, 1, 0]], None), ([[0, 1], [3]], "out_of_range"),
    ([[0, 1], [1, 2]], "repeated"), ([[0, 1]], "not_covered"), ([[0, 1, 2], []], "empty_group"),
    ([[0], [1], [2], []], "more_groups_than_labels"), ([], "no_groups"), ([[0, -1, 1, 2]], "out_of_range"),
    (None, "no_groups"), ([[0, None, 1, 2]], "out_of_range"),
])
def test_groupings_must_partition(spark, groups, problem):
    chunks = labels.chunk_labels(label_table(spark, ["a", "b", "c"]))
    made = [r.problem for r in labels.grouping_problems(grouping(spark, groups), chunks).collect()]
    assert made == ([problem] if problem else [])


def test_a_missing_or_unknown_grouping_is_a_problem(spark):
    chunks = labels.chunk_labels(label_table(spark, ["a", "b", "c"]), LabelLimits(max_labels=2))
    made = {r.chunk: r.problem for r in labels.grouping_problems(grouping(spark, [[0], [1]]), chunks).collect()}
    assert made == {1: "no_groups"}
    small = labels.chunk_labels(label_table(spark, ["a"]))
    made = {r.chunk: r.problem for r in labels.grouping_problems(grouping(spark, [[0]], [[0]]), small).collect()}
    assert made == {1: "unknown_chunk"}


def test_representative_comes_first(spark):
    chunks = labels.chunk_labels(label_table(spark, ["b", "a", "c"]))
    made = labels.apply_grouping(chunks, grouping(spark, [[2, 0], [1]]))
    assert {r.label: r.representative for r in made.collect()} == {"b": "c", "c": "c", "a": "a"}


def test_large_scopes_are_sorted_before_slicing(spark):
    made = labels.chunk_labels(label_table(spark, ["b", "Z", "a"]), LabelLimits(max_labels=2)).collect()
    assert {r.label: (r.chunk, r.idx) for r in made} == {"Z": (0, 0), "a": (0, 1), "b": (1, 0)}


def test_label_limits(spark):
    names = ["ok", " ", "x" * 121, "😀" * 61, "é" * 120]
    chunks = labels.chunk_labels(label_table(spark, names))
    made = {(r.problem, r.label) for r in labels.label_problems(chunks).collect()}
    assert made == {("blank", " "), ("too_long", "x" * 121), ("too_long", "😀" * 61)}
    tight = labels.label_problems(chunks, LabelLimits(max_length=200, max_labels=4, max_bytes=10))
    assert {r.problem for r in tight.collect()} == {"blank", "too_many"}
    twice = labels.chunk_labels(label_table(spark, ["a", "b"])).withColumn("label", F.lit("a"))
    assert [r.problem for r in labels.label_problems(twice).collect()] == ["repeated"]
    body = json.dumps({"labels": ["a", "bc"]}, separators=(",", ":"))
    two = labels.chunk_labels(label_table(spark, ["a", "bc"]))
    assert labels.label_problems(two, LabelLimits(max_bytes=len(body))).isEmpty()
    assert not labels.label_problems(two, LabelLimits(max_bytes=len(body) - 1)).isEmpty()


def halves(chunks):
    """Pairs neighbours: indices 0 and 1, 2 and 3, and so on."""
    pairs = chunks.groupBy("scope_kind", "scope_key", "chunk", F.floor(F.col("idx") / 2).alias("p")).agg(
        F.array_sort(F.collect_list("idx")).alias("m"))
    return pairs.groupBy("scope_kind", "scope_key", "chunk").agg(F.array_sort(F.collect_list("m")).alias("groups"))


def alone(chunks):
    return chunks.groupBy("scope_kind", "scope_key", "chunk").agg(
        F.array_sort(F.collect_list(F.array("idx"))).alias("groups"))


def test_three_levels(spark):
    limits = LabelLimits(max_labels=4)
    names = [f"l{i:02}" for i in range(12)]
    found = label_table(spark, names).unionByName(label_table(spark, ["only"], ("product", "p")))
    made, problems = labels.reconcile(found, halves, limits)
    assert problems.isEmpty()
    assert {r.level for r in made.collect()} == {0, 1, 2}
    assert labels.level_problems(made, limits).isEmpty()
    composed = labels.compose_levels(found, made, limits)
    final = {(r.scope_key, r.label): r.canonical for r in composed.collect()}
    assert [final["C", n] for n in names] == ["l00"] * 8 + ["l08"] * 4 and final["p", "only"] == "only"
    order = labels.canonical_labels(composed).filter("scope_key = 'C'").orderBy("position").collect()
    assert [(r.canonical, r.position) for r in order] == [("l00", 0), ("l08", 1)]


def test_hierarchies_that_cannot_finish(spark):
    limits = LabelLimits(max_labels=4)
    table = label_table(spark, [f"l{i:02}" for i in range(40)], ("category", "deep")).unionByName(
        label_table(spark, [f"l{i}" for i in range(6)], ("category", "stuck"))).unionByName(
        label_table(spark, ["a", "b", "c"], ("category", "spoiled"))).unionByName(
        label_table(spark, ["a", "x" * 121], ("category", "long"))).unionByName(
        label_table(spark, ["a", "b"], ("category", "good")))

    def group(chunks):
        mine = chunks.filter("scope_key <> 'stuck'")
        cut = F.when(F.col("scope_key") == "spoiled", F.slice("groups", 1, 1)).otherwise(F.col("groups"))
        return halves(mine).withColumn("groups", cut).unionByName(alone(chunks.filter("scope_key = 'stuck'")))

    made, problems = labels.reconcile(table, group, limits)
    assert {r.scope_key: r.problem for r in problems.collect()} == {
        "deep": "not done within 3 levels", "stuck": "level 0: merged nothing", "spoiled": "level 0 grouping: not_covered",
        "long": "level 0 labels: too_long"}
    assert {(r.scope_key, r.label, r.representative) for r in made.collect()} == {("good", "a", "a"), ("good", "b", "a")}


def level_map(spark, *rows):
    return spark.createDataFrame([(*SCOPE, *r) for r in rows],
                                 "scope_kind string, scope_key string, level int, label string, representative string")


def test_a_broken_level_is_noticed(spark):
    found = label_table(spark, ["a", "b"])
    composed = labels.compose_levels(found, level_map(spark, (0, "a", "a"), (0, "b", "b"), (1, "a", "b")))
    assert {r.label: r.canonical for r in composed.collect()} == {"a": "b", "b": None}
    assert labels.composition_problems(composed).first().problem == "a level does not map every label"
    deep = level_map(spark, *[(0, str(i), str(i)) for i in range(3)], *[(2, str(i), "0") for i in range(3)])
    made = {r.problem for r in labels.level_problems(deep, LabelLimits(max_labels=2)).collect()}
    assert made == {"merged_nothing", "too_many_levels"}


def scoped(spark, *rows):
    full = [(*SCOPE, r, dt.date(2026, 1, 1), int(r[1:]), i, theme, theme.lower(), mood, proof)
            for i, (r, theme, mood, proof) in enumerate(rows)]
    return spark.createDataFrame(full, "scope_kind string, scope_key string, review_id string, review_date date, "
                                 "row_pos long, entry_pos int, theme string, theme_key string, sentiment string, evidence string")


def test_merged_labels_count_a_review_once(spark):
    tagged = scoped(
        spark, ("r2", "Glow", "praise", "zz"), ("r1", "Light", "praise", "b"), ("r1", "Shine", "praise", "a"),
        ("r3", "Beam", "praise", "q"), ("r3", "Light", "neutral", "q"), ("r2", "Switch", "fault", "s"))
    found = labels.distinct_labels(tagged)
    assert [r.label for r in found.orderBy("label_pos").collect()] == ["Light", "Shine", "Glow", "Switch", "Beam"]
    mapped = level_map(spark, *[(0, n, "Light") for n in ("Light", "Shine", "Glow", "Beam")], (0, "Switch", "Switch"))
    ctags = labels.canonical_tags(tagged, labels.compose_levels(found, mapped))
    assert labels.unmapped_tags(ctags).isEmpty() and tag_findings.mapping_problems(ctags).isEmpty()
    assert {"theme", "theme_key"}.isdisjoint(ctags.columns)
    totals = spark.createDataFrame([(*SCOPE, 8)], "scope_kind string, scope_key string, selected long")
    made = tag_findings.tag_findings(ctags, totals, REVIEW).collect()
    assert [(r.label, r.polarity, r.mentions, r.percent, r.quote, r.review_id) for r in made] == [
        ("Light", "positive", 3, 38, "a", "r1")]
    below = tag_findings.below_threshold(ctags, REVIEW).collect()
    assert [(r.label, r.mentions) for r in below] == [("Switch", 1)]
    records = tag_findings.tag_findings(ctags, totals, PRODUCT_RECORD)
    advice = tag_findings.derived_advice(records, PRODUCT_RECORD).first().advice
    assert advice == "Look into switch: named in 1 of 8 product records."
    same = tag_findings.compare_findings(records, records)
    assert same.isEmpty()
    changed = records.withColumn("percent", F.col("percent") + F.when(F.col("polarity") == "negative", 1).otherwise(0))
    assert tag_findings.compare_findings(records, changed).count() == 1


def test_invented_labels_are_refused(spark):
    tagged = scoped(spark, ("r1", "Light", "praise", "b"))
    found = labels.distinct_labels(tagged)
    composed = labels.compose_levels(found, level_map(spark, (0, "Light", "Radiance")))
    assert labels.composition_problems(composed).first().problem == "a canonical label was never offered"
