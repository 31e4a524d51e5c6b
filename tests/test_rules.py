"""Rule engine, scopes, promotions and briefs on small hand-made rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from themeloom import filters
from themeloom.model import PRODUCT_RECORD, REVIEW, DateWindow, InputError, SelectionError, Theme, vocabulary_from
from themeloom.operators import ingest, promotions, scopes, themes, vocabulary
from themeloom.plans import briefs, report
from themeloom.sources import files, fixtures

SCHEMA = ("row_pos long, review_id string, product_id string, review_date date, rating int, text string, "
          "author string, verified boolean, country string, promotion string, discount_percent double")
THEMES = (Theme("sound", "Sound", ("sound", "bass"), "listen"), Theme("fit", "Fit", ("fit",), "try on"),
          Theme("usb", "USB port", ("usb",), ""))


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(n)


def table(spark, rows):
    full = [(i, f"r{i}", p, d, s, t, None, None, None, promo, disc)
            for i, (p, d, s, t, promo, disc) in enumerate(rows)]
    products = spark.createDataFrame(
        [("a", "Alpha", "C", "Cat"), ("b", "Beta", "C", "Cat"), ("z", "Zeta", "", "")],
        "product_id string, name string, category string, top_category string")
    return spark.createDataFrame(full, SCHEMA), products


def test_representative_row(spark):
    reviews, products = table(spark, [
        ("a", day(5), 4, "sound", None, None), ("a", day(3), 5, "bass sound", None, None),
        ("a", day(2), 5, "sound, BASS", None, None), ("a", day(2), 5, "bass/sound", None, None),
        ("a", day(1), 4, "bass sound", None, None), ("a", day(1), 3, "bass sound", None, None),
        ("a", day(9), 1, "no fit", None, None), ("a", day(8), 2, "a fit", None, None), ("a", day(9), 1, "fit", None, None)])
    found = {(r.scope_kind, r.theme_key, r.polarity): r
             for r in themes.findings(reviews, products, THEMES, REVIEW).collect()}
    best = found["product", "sound", "positive"]
    assert (best.mentions, best.row_pos, best.percent) == (5, 2, 56)
    assert found["product", "fit", "negative"].row_pos == 6
    assert found["category", "sound", "positive"].row_pos == 2
    assert set(found) == {(s, t, p) for s in ("product", "category")
                          for t, p in (("sound", "positive"), ("fit", "negative"))}


def test_threshold_depends_on_the_unit(spark):
    reviews, products = table(spark, [("a", None, 5, "nice usb", None, None), ("b", None, 1, "soundness", None, None)])
    assert themes.findings(reviews, products, THEMES, REVIEW).isEmpty()
    made = themes.findings(reviews, products, THEMES, PRODUCT_RECORD).collect()
    assert sorted((r.scope_key, r.label, r.percent) for r in made) == [("Cat", "USB port", 50), ("a", "USB port", 100)]


def test_theme_in_both_columns_and_order(spark):
    reviews, products = table(spark, [
        ("a", day(1), s, t, None, None) for s, t in
        [(5, "sound fit"), (4, "sound fit usb"), (1, "sound"), (2, "sound. usb"), (1, "usb"), (5, "usb")]])
    made = briefs.rule_briefs(reviews, products, THEMES, REVIEW).filter("scope_key = 'a'").first()
    assert [(f.rank, f.label, f.mentions, f.percent) for f in made.praise] == [
        (1, "Fit", 2, 33), (2, "Sound", 2, 33), (3, "USB port", 2, 33)]
    assert [f.label for f in made.faults] == ["Sound", "USB port"]
    assert made.recommendations == ["listen"]
    assert made.summary == ("6 reviews of Alpha, 3.0★ on average: fit is praised most (2 of 6); "
                            "sound is faulted most (2 of 6).")


def test_summaries(spark):
    def one(rows, unit=REVIEW, window=None):
        reviews, products = table(spark, rows)
        return briefs.rule_briefs(reviews, products, THEMES, unit, window).filter("scope_key = 'a'").first().summary
    single = [("a", None, 5, "usb", None, None)]
    assert one(single, PRODUCT_RECORD) == (
        "One product record of Alpha, rated 5.0★: USB port is praised most. "
        "No complaints have enough support among these product records.")
    assert one(single) == "One review of Alpha, rated 5.0★: no theme has enough support; the reviews differ."
    faults = [("a", day(1), 1, "fit", None, None)] * 2
    assert one(faults) == ("2 reviews of Alpha, 1.0★ on average: fit is faulted most (2 of 2). "
                           "Too little praise has support between these dates.")
    split = [("a", day(1), s, "fit", None, None) for s in (1, 1, 5, 5)]
    assert one(split).endswith("opinions differ most on fit (2 for, 2 against).")
    assert one(single, window=DateWindow(day(0), day(9))) == "No reviews of Alpha were selected."


def test_windows_and_unknown_scopes(spark):
    reviews, products = table(spark, [
        ("a", day(1), 5, "x", None, None), ("b", day(3), 5, "x", None, None), ("a", None, 5, "x", None, None)])
    assert scopes.select_product(reviews, products, "a", DateWindow(day(1), day(1))).count() == 1
    assert scopes.select_product(reviews, products, "a").count() == 2
    assert scopes.select_category(reviews, products, "Cat", DateWindow(day(1), day(3))).count() == 2
    with pytest.raises(SelectionError):
        scopes.select_product(reviews, products, "nope")
    with pytest.raises(SelectionError):
        scopes.select_category(reviews, products, "nope")
    with pytest.raises(SelectionError):
        DateWindow(day(2), day(1))
    asked = spark.createDataFrame([("product", "a"), ("category", "No")], "scope_kind string, scope_key string")
    assert [r.scope_key for r in scopes.unknown_scopes(asked, products).collect()] == ["No"]
    whole = scopes.expand_scopes(reviews.select("review_id", "product_id"), products).filter("scope_kind = 'category'")
    assert scopes.partition_problems(whole, reviews).isEmpty()
    doubled = whole.unionByName(whole.filter("review_id = 'r0'"))
    assert [tuple(r) for r in scopes.partition_problems(doubled, reviews).collect()] == [("r0", 2)]


def test_all_scopes_equal_one_scope(spark):
    rows = fixtures.sample_reviews(spark)
    classified = ingest.classify(rows)
    reviews, products = ingest.accepted(classified), ingest.product_dimension(classified)
    every = themes.findings(reviews, products, fixtures.SAMPLE_VOCABULARY, REVIEW)
    for kind, key, chosen in (
        ("product", "lamp", scopes.select_product(reviews, products, "lamp")),
        ("category", "Home", scopes.select_category(reviews, products, "Home")),
    ):
        alone = themes.findings(chosen, products, fixtures.SAMPLE_VOCABULARY, REVIEW)
        where = (F.col("scope_kind") == kind) & (F.col("scope_key") == key)
        a, b = sorted(every.filter(where).collect()), sorted(alone.filter(where).collect())
        assert a == b and a
    quoted = themes.with_quotes(every, reviews, fixtures.SAMPLE_VOCABULARY)
    joined = quoted.join(reviews.select("review_id", "text"), "review_id")
    assert joined.filter(~F.contains("text", "quote") | (F.col("mentions") > F.col("selected"))).isEmpty()


def test_large_vocabulary_agrees_with_plain_matching(spark):
    rows = spark.createDataFrame(
        [(1, "The MIC-quality is Fine; set up, not setup2"), (2, "mic qualityé café"), (3, "nothing"),
         (4, "Kelvin İn kelvin")], "row_pos long, text string")
    words = ["mic quality", "mic-quality", "set up", "setup", "café", "é", "kelvin", "in", "i", "fine"]
    vocabulary = [Theme(w, w, (w,), "") for w in words]
    made = {(r.row_pos, words[r.theme]) for r in themes.theme_hits(rows, vocabulary).collect()}
    from themeloom.functions.text import matches_keyword
    plain = rows.select("row_pos", *[matches_keyword(F.col("text"), w).alias(str(i)) for i, w in enumerate(words)])
    assert made == {(r.row_pos, w) for r in plain.collect() for i, w in enumerate(words) if r[str(i)]}


def test_fifty_thousand_keywords_against_brute_force(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(3_000)]
    entries = []
    for i in range(6_000):
        own = {" ".join(r.choices(words, k=r.choice([1, 1, 2, 3]))) for _ in range(9)}
        own |= {r.choice(words).upper() + "-" + r.choice(words)} if i % 5 == 0 else set()
        entries.append(Theme(f"t{i}", f"T{i}", tuple(own), ""))
    assert sum(len(t.keywords) for t in entries) > 50_000
    texts = ["".join(w + r.choice([" ", " ", ", ", "-", "  ", "9 "]) for w in r.choices(words, k=60)).title() for _ in range(40)]
    made = themes.theme_hits(spark.createDataFrame(list(enumerate(texts)), "row_pos long, text string"), entries)
    # All runs of up to four words of a text with what stands between them; a keyword is found if it is one of these.
    want = set()
    for row, text in enumerate(texts):
        spans = [m.span() for m in re.finditer("[a-z0-9]+", text.lower())]
        runs = {text.lower()[a[0]:b[1]] for i, a in enumerate(spans) for b in spans[i:i + 4]}
        want |= {(row, i, n) for i, t in enumerate(entries) if (n := sum(k.lower() in runs for k in t.keywords))}
    assert {(x.row_pos, x.theme, x.n) for x in made.collect()} == want and want


def test_the_plan_does_not_grow_with_the_vocabulary(spark):
    reviews, products = table(spark, [("a", day(1), 5, "one two three", None, None)])
    def size(n):
        vocabulary = [Theme(f"k{i}", f"l{i}", (f"word{i}", f"two words{i}"), "") for i in range(n)]
        found = themes.findings(reviews, products, vocabulary, REVIEW)
        return len(themes.recommendations(found, vocabulary)._jdf.queryExecution().executedPlan().toString())
    assert abs(size(2_000) - size(3)) < 400  # the numbers of a few masks


def test_more_keywords_than_a_vocabulary_may_have(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "MAX_KEYWORDS", 2)
    with pytest.raises(InputError):
        vocabulary.indexed(spark, [Theme("a", "a", ("x", "y", "z"), "")])


def test_a_filter_of_keys_misses_none(spark):
    rows = spark.range(5_000).selectExpr("if(id % 9 = 0, null, concat('k', id)) AS k", "id AS v")
    for bits in (filters.BLOCK_BITS, filters.MAX_BITS):
        chosen = rows.filter("v % 7 = 0").select("k")
        kept = {x.v for x in filters.among(rows, "k", chosen, 700, bits).collect()}
        want = {v for v in range(0, 5_000, 7) if v % 9}
        assert want <= kept and all(v % 9 for v in kept) and len(kept) < 1.15 * len(want)
    assert filters.among(rows, "k", rows.limit(0).select("k"), 0).isEmpty()


def test_an_empty_vocabulary_is_refused(spark):
    with pytest.raises(InputError):
        themes.theme_hits(spark.createDataFrame([("x",)], "text string"), ())


def test_vocabulary_table(spark):
    df = spark.createDataFrame([("k", "L", ["a", "b"], "r")],
                               "theme_key string, label string, keywords array<string>, recommendation string")
    assert vocabulary_from(df) == (Theme("k", "L", ("a", "b"), "r"),)


def test_promotions(spark):
    reviews, products = table(spark, [
        ("a", day(1), 5, "x", " B ", None), ("a", day(1), 4, "x", "a", 0.0), ("a", day(1), 3, "x", None, 5.0),
        ("a", day(1), 4, "x", " ", 0.0), ("b", day(1), 3, "x", None, None), ("z", day(1), 2, "x", "s", None)])
    made = {(r.scope_kind, r.scope_key): r for r in promotions.promotions(reviews, products).collect()}
    assert set(made) == {("product", "a"), ("category", "Cat"), ("product", "z")}
    a = made["product", "a"]
    assert (a.promo_count, a.full_price_count, a.promo_average, a.rating_delta, a.promotions) == (
        3, 1, 4.0, 0.0, ["a", "B"])
    assert "no visible difference" in a.note
    assert made["category", "Cat"].rating_delta == 0.5 and "0.5★ higher" in made["category", "Cat"].note
    alone = made["product", "z"]
    assert not alone.comparable and alone.rating_delta == 0.0 and alone.full_price_average == 0.0


def test_report_shows_a_quote_once(spark):
    reviews, products = table(spark, [("a", day(1), 5, "sound and fit", "x", None)] * 2)
    made = report.report(briefs.rule_briefs(reviews, products, THEMES, REVIEW, DateWindow(day(0), day(9))),
                         dt.date(2026, 8, 2), REVIEW)
    text = made.filter("scope_key = 'a'").first().report
    assert text.count('- Quote: "sound and fit" (Buyer)') == 1 and text.count("- Support: 2 of 2 reviews (100%)") == 2
    assert "Window: Jan 1, 2026 to Jan 10, 2026" in text and "- Seen: x" in text
    empty = made.filter("scope_key = 'z'").first().report
    assert "No strength had enough support." in empty and "## Promotions" not in empty
    assert "hides single complaints" in report.no_action_reason(PRODUCT_RECORD, report.RATING)
    assert "recurring issues" in report.no_action_reason(REVIEW, report.RATING)


def test_a_scope_with_a_hundred_thousand_findings(spark):
    """Each quote is shown where it comes first, praise before faults, whatever the number of findings."""
    entry = "struct(cast(i + 1 as int) as rank, concat('L', i) as label, 2L as mentions, 1 as percent, {} as quote, 'who' as quote_author)"
    made = spark.sql(f"""SELECT 'product' AS scope_kind, 'p' AS scope_key, 'P' AS subject, date'2026-01-01' AS window_start, date'2026-02-01' AS window_end,
        9L AS review_count, 4.0D AS average_rating, true AS dated, 's' AS summary, array('do') AS recommendations,
        transform(sequence(0, 59999), i -> {entry.format("concat(' q', i % 50000, ' ')")}) AS praise,
        transform(sequence(0, 39999), i -> {entry.format("if(i % 4 = 0, '', concat('q', i + 30000))")}) AS faults""")
    rows = report.finding_rows(made)
    seen, shown = set(), 0
    for i in range(100_000):
        quote = f"q{i % 50000}" if i < 60_000 else "" if (i - 60_000) % 4 == 0 else f"q{i - 30_000}"
        shown += bool(quote) and quote not in seen
        seen.add(quote)
    assert rows.count() == 100_000 and rows.filter("shown").count() == shown
    text = report.report(made, dt.date(2026, 8, 2), REVIEW).first().report
    assert text.count("- Quote:") == shown and text.count("### L") == 100_000
    assert text.index("### L59999") < text.index("## Issues") < text.index("### L0\n", text.index("## Issues"))


def test_results_are_written_by_scope_kind(spark, tmp_path):
    df = spark.createDataFrame([("product", "a"), ("category", "b")], "scope_kind string, scope_key string")
    fixtures.write_results(df, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"scope_kind=product", "scope_kind=category"}


def test_source_decides_the_unit():
    assert ingest.unit_for(files.PRODUCT_EXPORT) is PRODUCT_RECORD and ingest.unit_for("uploaded") is REVIEW
