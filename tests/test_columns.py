"""Column helpers on the edge cases of text cells."""

import pytest
from pyspark.sql import functions as F

from themeloom.functions import category, dates, numbers, text
from themeloom.plans.report import short_label


def values(spark, column, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").select("v").collect()]


def test_trimming_knows_unicode_spaces(spark):
    assert values(spark, text.trimmed, [" ﻿ a b 　\n", None, "  "]) == ["a b", "", ""]
    assert values(spark, text.label_key, ["  Battery    LIFE\t"]) == ["battery life"]


def test_ratings(spark):
    cells = ["4", "4.0", " 5 ", "0", "6", "3.5", "", "4d", "inf", "NaN", "4e0", "+3", None, "0x4"]
    assert values(spark, numbers.star_rating, cells) == [
        4, 4, 5, None, None, None, None, None, None, None, 4, 3, None, None]
    assert values(spark, numbers.rounded_rating, ["3.5", "2.4", "0.4", "5.5", "5.4", "|", "", "1e9"]) == [
        4, 2, None, None, 5, None, None, None]


def test_amounts_and_discounts(spark):
    assert values(spark, numbers.amount, ["₹1,099", "64%", "24,269", "", "n/a", " 1 000 ", "₹", "1e999"]) == [
        1099.0, 64.0, 24269.0, None, None, 1000.0, None, None]
    assert values(spark, numbers.discount, ["10%", "10", "101", "-1", "", "x", "0", " 5.5 %", "100"]) == [
        10.0, 10.0, None, None, None, None, 0.0, 5.5, 100.0]


def test_rounding_goes_up_on_ties(spark):
    row = spark.sql("select -2.5d a, 2.5d b, -0.05d c, 1d x, 8d y").select(
        numbers.round_half_up(F.col("a")), numbers.round_half_up(F.col("b")),
        numbers.round_half_up(F.col("c"), 1), numbers.share_percent(F.col("x"), F.col("y"))).first()
    assert tuple(row) == (-2, 3, 0.0, 13)


def test_dates_are_strict(spark):
    cells = ["2026-02-30", "2026-13-01", "2023-02-29", "2024-02-29", "2026-2-3", "", "2026-04-31", "x"]
    made = values(spark, dates.strict_date, cells)
    assert [str(v) if v else None for v in made] == [None, None, None, "2024-02-29"] + [None] * 4
    shown = spark.sql("select date'2026-03-04' d").select(dates.short_date(F.col("d"))).first()[0]
    assert shown == "Mar 4, 2026"


def test_category_paths(spark):
    cells = ["Home&Kitchen| Home  Decor |Lamps", "Electronics", "|", "  ", None]
    assert values(spark, category.top_category, cells) == ["Home&Kitchen", "Electronics", "", "", ""]
    assert values(spark, category.leaf_category, cells) == ["Lamps", "Electronics", "", "", ""]
    assert values(spark, category.category_path, cells)[0] == ["Home&Kitchen", "Home Decor", "Lamps"]


@pytest.mark.parametrize("keyword, cell, hit", [
    ("clean", "easy to CLEAN", True), ("clean", "cleaner teeth", False), ("clean", "un_clean_ed", True),
    ("clean", "clean2", False), ("well-made", "a Well-Made bag", True), ("well-made", "well made", False),
    ("set up", "set up.", True), ("set up", "set  up", False), ("c++", "I like c++!", True),
    ("a.b", "axb", False), ("won't pair", "it WON'T PAIR", True), ("é", "café x", False), ("É", "un é x", True), ("  ", "a", False),
])
def test_keywords_have_boundaries(spark, keyword, cell, hit):
    assert values(spark, lambda c: text.matches_keyword(c, keyword), [cell]) == [hit]


def test_sentences_keep_their_closing_mark(spark):
    cell = "Bright lamp!  Switch broke. Sent back"
    assert values(spark, text.sentences, [cell]) == [["Bright lamp!", "Switch broke.", "Sent back"]]
    quote = lambda c: text.first_sentence_with(text.sentences(c), c, ["switch"])
    assert values(spark, quote, [cell, " no such word "]) == ["Switch broke.", "no such word"]


def test_labels_inside_a_sentence(spark):
    cells = ["Sound quality", "USB port", "GaN charger", "5G radio", "X", "Battery LIFE"]
    assert values(spark, text.lower_first, cells) == [
        "sound quality", "USB port", "GaN charger", "5G radio", "x", "battery LIFE"]


def test_attribution(spark):
    df = spark.createDataFrame(
        [("Ann", True, "US"), (None, True, "US"), (None, None, None), ("", False, "")],
        "a string, v boolean, c string")
    made = [r[0] for r in df.select(text.attribution(F.col("a"), F.col("v"), F.col("c"))).collect()]
    assert made == ["Ann", "Verified buyer · US", "Buyer", "Buyer"]


def test_short_labels(spark):
    long = "Northwind Braided Charging Cable (Light Blue, 2 m, with pouch) for phones and tablets of any make"
    run_on = "WORD" * 30
    no_cut = "Borealis Mini 4, " + "longwordhere " * 8
    nested = "Northwind Charger (for home (and car), with case) and more words - extra parts for anyone at all"
    made = values(spark, short_label, ["Short  title", long, run_on, None, no_cut, nested, ") stray, " + "w" * 30 + " with much more text behind it, and more"])
    assert made[0] == "Short title" and made[3] is None
    assert made[1] == "Northwind Braided Charging Cable"
    assert made[2] == "WORD" * 15 + "WOR" + "…"
    assert made[4].endswith("…") and len(made[4]) <= 64
    assert made[5] == "Northwind Charger (for home (and car), with case) and more words"
    assert made[6] == ") stray, " + "w" * 30
