"""What the physical plans must and must not contain, and skewed inputs."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import TINY
from themeloom import filters, storage
from themeloom.corpora import VOCABULARY, document_reviews, document_rows
from themeloom.model import DateWindow, REVIEW
from themeloom.operators import ingest, scopes, tags, themes
from themeloom.sources import files
from themeloom.storage import settle, with_position
from verification import inputs, queries
from verification.queries import QUERIES, WINDOW


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "ingest_rows", "scopes_all", "themes_findings", "themes_quotes", "promotions_by_scope", "tags_valid",
    "tags_outcomes", "sizing_density", "evaluate_stability"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, TINY))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_text_is_not_shuffled(spark):
    made = themes.scope_tallies(themes.mentions(document_reviews(spark, TINY)[0], VOCABULARY),
                                document_reviews(spark, TINY)[1])
    tree = made._jdf.queryExecution().executedPlan()
    text = tree.toString()
    assert "SortAggregate" not in text.split("BroadcastExchange")[0]
    for line in text.splitlines():
        if "HashAggregate(keys=[product_id" in line:
            assert "text" not in line
    assert text.count("regexp_extract_all") == 1


def exchanged(df):
    """The columns that each shuffle of a plan carries."""
    text = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\n]*)\]", text)


def test_quotes_exchange_no_text(spark, monkeypatch):
    """The text of a review goes from its scan to the cut sentence within one stage, in the plans that are written too."""
    shuffles = []

    def watched(df, name):
        shuffles.extend(exchanged(df))
        return settle(df, name)

    for module in (themes, filters):
        monkeypatch.setattr(module, "settle", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # however many winners there are
    try:
        shuffles += exchanged(QUERIES["themes_quotes"](spark, TINY))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(shuffles) > 5 and any("quote#" in x for x in shuffles)
    assert not any("text#" in x for x in shuffles)


def test_buckets_spare_the_texts_an_exchange(spark):
    entries = tags.entries(tags.parse_responses(inputs.responses(spark, TINY)))
    reviews = document_reviews(spark, TINY)[0].select("review_id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = exchanged(tags.validate(entries, reviews))
        stored = exchanged(tags.validate(entries, storage.bucketed(reviews, "review_id", "reviews", 6)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("text#" in x for x in plain)
    assert stored and not any("text#" in x for x in stored)


def test_csv_files_are_read_once(spark, tmp_path, monkeypatch):
    spark.range(500).selectExpr("id", "concat('t', id) AS t").repartition(4).write.option("header", True).csv(str(tmp_path / "c"))
    written = []

    def watched(df, name):
        written.append(plan(df))
        return settle(df, name)

    monkeypatch.setattr(files, "settle", watched)
    rows = files.read_csv(spark, str(tmp_path / "c"))
    assert sum("FileScan csv" in x for x in written) == 1 and "FileScan csv" not in plan(rows) and exchanged(rows) == []
    assert sorted(r.row_pos for r in rows.collect()) == list(range(1, 501))


def test_rows_of_an_id_that_occurs_once_are_not_exchanged(spark):
    """Typed rows are written once; of the second pass only rows that the filter admits are joined."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ingest.classify(inputs.raw_reviews(spark, TINY))
        lines = plan(made)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    single, matched = lines.split("SortMergeJoin")[0], lines.split("SortMergeJoin")[1]
    assert "Exchange hashpartitioning(review_id" in matched and "Exchange hashpartitioning(review_id" not in single
    assert "regexp" not in lines and lines.count("FileScan parquet") == 5


def test_scans_read_only_what_they_need(spark):
    rows = document_reviews(spark, TINY)[0]
    assert "text" not in plan(ingest.product_stats(rows)).split("ReadSchema")[1].split("\n")[0]


def test_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    document_rows(spark, TINY).write.parquet(path)
    text = plan(scopes.in_window(spark.read.parquet(path), WINDOW))
    assert "GreaterThanOrEqual(review_date" in text and "LessThanOrEqual(review_date" in text


def test_positions_under_skew(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"),
        (F.col("id") * 7919 % 30_011).alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = with_position(df, ["g"], ["o"], "p")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert made.count() == 30_000
    wrong = made.withColumn("q", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1).filter("p <> q")
    assert wrong.isEmpty()


def test_positions_take_one_shuffle(spark, monkeypatch):
    """Rows are exchanged once, as they are numbered; later plans only read them."""
    written = []

    def watched(df, name):
        written.append((name, len(exchanged(df))))
        return settle(df, name)

    monkeypatch.setattr(storage, "settle", watched)
    made = with_position(document_rows(spark, TINY).select("product_id", "row_pos", "review_date"), ["product_id"], ["review_date", "row_pos"])
    assert dict(written)["slices"] == 1 and exchanged(made) == []
    assert exchanged(QUERIES["scopes_selection_order"](spark, TINY)) == []


@pytest.mark.parametrize("rows", (1, 7, 10_000))
def test_positions_across_arrow_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        df = spark.range(200).selectExpr("if(id < 90, null, cast(id div 40 as string)) AS g", "id % 2 AS h", "id * 17 % 200 AS o").repartition(3)
        made = with_position(df, ["g", "h"], ["o"], "p").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in sorted(made, key=lambda r: r.o):
        groups.setdefault((r.g, r.h), []).append(r.p)
    assert len(made) == 200 and all(p == list(range(len(p))) for p in groups.values())


def test_a_local_folder_is_no_shared_one(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            storage.shared_folder(Session())


def test_positions_without_groups_and_with_nulls(spark):
    df = spark.createDataFrame([(None, 3), ("b", 2), (None, 1), ("a", 4)], "d string, o int")
    made = with_position(df, [], ["d", "o"], "p").orderBy("p").collect()
    assert [(r.d, r.o, r.p) for r in made] == [(None, 1, 0), (None, 3, 1), ("a", 4, 2), ("b", 2, 3)]


def test_a_mass_of_blank_ids_is_spread(spark):
    cells = {c: F.lit("x") for c in ("product_id", "product_name", "category", "review_text")}
    raw = spark.range(20_000).select(
        F.col("id").alias("row_pos"), F.when(F.col("id") % 2 == 0, "").otherwise(F.lit("same")).alias("review_id"),
        F.lit("4").alias("rating"), *[v.alias(k) for k, v in cells.items()])
    from themeloom.sources.files import as_reviews
    counts = {r.reject_reason: r.rows for r in ingest.skip_reasons(ingest.classify(as_reviews(raw))).collect()}
    assert counts == {"missing_review_id": 10_000, "duplicate_review_id": 9_999}


def test_one_hot_product(spark):
    rows = document_rows(spark, TINY).withColumn("product_id", F.lit("hot"))
    products = ingest.product_dimension(rows)
    made = themes.findings(rows, products, VOCABULARY, REVIEW, DateWindow(WINDOW.start, WINDOW.end))
    own = {(r.theme_key, r.polarity): (r.mentions, r.row_pos) for r in made.filter("scope_kind = 'product'").collect()}
    wide = {(r.theme_key, r.polarity): (r.mentions, r.row_pos) for r in made.filter("scope_kind = 'category'").collect()}
    assert own == wide and own


def test_csv_files_of_queries_follow_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_folder", lambda spark: str(tmp_path))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("13", "false"), strict=True):
            spark.conf.set(k, v)
        rows = queries.sources_csv_rows(spark, TINY).collect()
        queries.sources_export_files(spark, TINY)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [len(list(d.glob("part-*.csv"))) for d in tmp_path.glob("csv-*")] == [13, 13]
    assert sorted(r["row_pos"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect())
