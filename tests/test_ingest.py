"""Reading files, rejecting rows, and the dimension and counts."""

import pytest
from pyspark.sql import functions as F

from themeloom.model import InputError
from themeloom.operators import ingest
from themeloom.sources import files, fixtures

HEADER = "review_id, product_id ,product_name,category,rating,review_text"


def write(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf8")
    return str(path)


def reasons(spark, path):
    rows = ingest.classify(files.read_feedback(spark, path)).orderBy("row_pos").collect()
    return [(r.row_pos, r.review_id, r.reject_reason) for r in rows]


def test_first_reason_and_duplicates(spark, tmp_path):
    path = write(
        tmp_path, "a.csv", HEADER + ",review_date",
        "a,p1,P,C,9,bad first,2026-01-01", "a,p1,P,C,4,good second,2026-01-02",
        "a,,P,C,9,bad late copy,nonsense", ",p1,P,C,4,x,2026-01-01", "b,,P,C,4,x,2026-01-01",
        "c,p1,P,C,4,x,2026-02-30", "d,p1,P,C,3.5,x,2026-01-01", "e,p1,P,C,4.0,,2026-01-01", "",
        'f,p2,,"","5","said ""wow"", twice\nand again",2026-01-03', "g,p2", "h,p2,Named,X|Y,1,z,2026-01-04")
    assert reasons(spark, path) == [
        (1, "a", "invalid_rating"), (2, "a", None), (3, "a", "duplicate_review_id"),
        (4, "", "missing_review_id"), (5, "b", "missing_product_id"), (6, "c", "invalid_date"),
        (7, "d", "invalid_rating"), (8, "e", "missing_review_text"), (9, "f", None),
        (10, "g", "invalid_date"), (11, "h", None)]
    rows = ingest.classify(files.read_feedback(spark, path))
    stats = ingest.load_stats(rows).first()
    assert (stats.parsed, stats.accepted, stats.skipped) == (11, 3, 8)
    assert sum(r.rows for r in ingest.skip_reasons(rows).collect()) == stats.skipped
    products = {r.product_id: r for r in ingest.product_dimension(rows).collect()}
    assert (products["p2"].name, products["p2"].top_category) == ("p2", "Uncategorized")
    text = ingest.accepted(rows).filter("review_id = 'f'").first().text
    assert text == 'said "wow", twice\nand again'


def test_undated_files_keep_every_row(spark, tmp_path):
    path = write(tmp_path, "u.csv", HEADER, "a,p,P,C,4,x", "b,p,P,C,2,y")
    rows = ingest.accepted(ingest.classify(files.read_feedback(spark, path)))
    assert rows.filter("review_date is null").count() == 2
    assert ingest.dataset_span(rows).first().has_dates is False
    assert ingest.dataset_span(rows.limit(0)).first().has_dates is False


def test_rows_are_numbered_across_files(spark, tmp_path):
    one = write(tmp_path, "1.csv", HEADER, *[f"a{i},p,P,C,4,x" for i in range(30)])
    two = write(tmp_path, "2.csv", HEADER, *[f"b{i},p,P,C,4,x" for i in range(7)])
    rows = files.read_reviews(spark, [two, one]).orderBy("row_pos").select("row_pos", "review_id").collect()
    assert [r.row_pos for r in rows] == list(range(1, 38))
    assert [r.review_id for r in rows] == [f"a{i}" for i in range(30)] + [f"b{i}" for i in range(7)]


def test_unusable_files(spark, tmp_path):
    with pytest.raises(InputError, match="rating, review_text"):
        files.read_reviews(spark, write(tmp_path, "m.csv", "review_id,product_id,product_name,category", "a,b,c,d"))
    with pytest.raises(InputError, match="neither"):
        files.read_feedback(spark, write(tmp_path, "n.csv", "x,y", "1,2"))
    with pytest.raises(InputError):
        ingest.require_accepted(ingest.classify(files.read_feedback(spark, write(tmp_path, "h.csv", HEADER))))


EXPORT = "product_id,product_name,category,discounted_price,actual_price,discount_percentage,rating,rating_count,review_content,user_name"


def test_product_export(spark, tmp_path):
    path = write(
        tmp_path, "e.csv", EXPORT,
        'P1,Cable,Computers|Cables,₹399,"₹1,099",64%,3.5,"24,269","Fast, firm.",x', ",Cable,C,,,,4,,t,x",
        "P2,Cable,C,,,,|,,t,x", "P3,Cable,C,,,,4,, ,x", "P1,Cable,Computers|Cables,bad,,,2.4,,again,x")
    raw = files.read_csv(spark, path)
    first = files.product_records(raw).orderBy("row_pos").first()
    assert (first.review_id, first.rating, first.source_rating) == ("amz-0001", 4, 3.5)
    assert (first.discounted_price, first.actual_price, first.rating_count) == (399.0, 1099.0, 24269.0)
    assert first.raw.actual_price == "₹1,099" and first.category_path == ["Computers", "Cables"]
    assert reasons(spark, path) == [
        (1, "amz-0001", None), (2, "amz-0002", "missing_product_id"), (3, "amz-0003", "invalid_rating"),
        (4, "amz-0004", "missing_review_text"), (5, "amz-0005", None)]
    rows = ingest.accepted(ingest.classify(files.route(raw)))
    assert {r.source for r in rows.collect()} == {"product_export"}
    assert rows.filter("promotion is not null or discount_percent is not null or review_date is not null").isEmpty()
    assert files.prune_export(raw).columns == list(files.EXPORT_KEPT)
    files.write_pruned_export(spark, path, str(tmp_path / "kept"), "csv")
    again = files.read_csv(spark, str(tmp_path / "kept"))
    assert "user_name" not in again.columns and again.count() == 5
    wide = spark.range(1).select(F.lit(12345).cast("long").alias("n")).select(
        F.format_string(files.RECORD_ID_FORMAT, "n")).first()[0]
    assert wide == "amz-12345"


def test_review_shape_wins_a_tie(spark, tmp_path):
    path = write(tmp_path, "t.csv", HEADER + ",review_content", "a,p,P,C,4,x,y")
    assert files.read_feedback(spark, path).first().source == "uploaded"


def test_preferred_source_marks_the_stand_in(spark, tmp_path):
    path = write(tmp_path, "s.csv", HEADER, "a,p,P,C,4,x")
    assert fixtures.preferred(spark, path, path, "real").first().is_synthetic is False
    row = fixtures.preferred(spark, str(tmp_path / "absent.csv"), path, "real").first()
    assert row.is_synthetic and row.dataset_label == fixtures.STAND_IN_LABEL


def test_category_summary_leaves_out_blank_categories(spark):
    reviews = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "product_id string")
    products = spark.createDataFrame(
        [("a", "X"), ("b", "X"), ("c", ""), ("d", "Y")], "product_id string, top_category string")
    made = sorted(map(tuple, ingest.category_summary(reviews, products).collect()))
    assert made == [("X", 2, 3), ("Y", 1, 0)]


def test_sample_stops_at_the_first_row_that_does_not_fit(spark):
    from themeloom.model import SampleLimits
    rows = spark.createDataFrame(
        [(1, "a", "x" * 10), (2, "a", "y"), (3, " ", "z"), (4, "b", ""), (5, "c", "x" * 10), (6, "d", "x" * 30),
         (7, "e", "x")], "row_pos long, review_id string, text string")
    limits = SampleLimits(max_rows=5, max_text_bytes=25)
    made = fixtures.size_bounded_sample(rows, limits).orderBy("row_pos").collect()
    assert [(r.review_id, r.total_bytes) for r in made] == [("a", 10), ("c", 20)]


def test_labelled_sets(spark, tmp_path):
    path = write(tmp_path, "mixed.json", '{"reviews": [', '{"id": "m1", "text": "good but bad", "kind": "mixed",',
                 '"praiseClause": "good", "faultClause": "awful"}]}')
    mixed = fixtures.read_mixed_labels(spark, path)
    assert mixed.first().praise_clause == "good"
    assert [r.review_id for r in fixtures.mislabelled(mixed).collect()] == ["m1"]
    path = write(tmp_path, "c.json", '{"reviews": [{"id": "c1", "text": "t", "cluster": "k"}]}')
    assert fixtures.read_cluster_labels(spark, path).first().cluster == "k"
