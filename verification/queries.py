"""One registered query per operator or report; each reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.corpora import VOCABULARY, document_reviews, document_rows, sale_rows, table
from themeloom.functions.category import category_path, leaf_category, top_category
from themeloom.functions.dates import short_date
from themeloom.functions.text import attribution, label_key, lower_first
from themeloom.model import DateWindow, InputError, LabelLimits, PRODUCT_RECORD, REVIEW, SelectionError, Sizing
from themeloom.operators import evaluate, ingest, labels, promotions, scopes, sizing, tag_findings, tags, themes
from themeloom.plans import briefs, report
from themeloom.sources import files, fixtures
from themeloom.storage import bucketed, settle, shared_folder, with_position
from verification import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WINDOW = DateWindow(date(2026, 2, 1), date(2026, 4, 30))
TWO_LEVELS = LabelLimits(max_labels=8)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- ingest -------------------------------------------------------------------


@query
def ingest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.classify(inputs.raw_reviews(spark, sf)).select(
        "row_pos", "review_id", "product_id", "product_name", "category", "rating", "review_date",
        "title", "verified", "country", "promotion", "discount_percent", "reject_reason",
        F.char_length("text").cast("long").alias("text_length"))


@query
def sources_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows written as CSV files in order, then read back by header; files count rows from 1."""
    raw = inputs.raw_reviews(spark, sf).select(
        "row_pos", "review_id", "product_id", "product_name", "category", F.col("stars_value").alias("rating"),
        "review_text", "review_date", "review_title", "verified_purchase", "country", "promotion", "discount_percent")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    raw.repartitionByRange("row_pos").sortWithinPartitions("row_pos").drop("row_pos").write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return ingest.classify(files.read_feedback(spark, path)).select(
        (F.col("row_pos") - 1).alias("row_pos"), "review_id", "product_id", "rating", "review_date", "reject_reason",
        F.md5("text").alias("text_md5"))


@query
def ingest_skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.skip_reasons(ingest.classify(inputs.raw_reviews(spark, sf)))


@query
def ingest_load_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.load_stats(ingest.classify(inputs.raw_reviews(spark, sf)))


@query
def ingest_products(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.product_dimension(ingest.classify(inputs.raw_reviews(spark, sf)))


@query
def ingest_category_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.category_summary(*document_reviews(spark, sf))


@query
def ingest_product_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.product_stats(document_rows(spark, sf))


@query
def ingest_dataset_span(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.dataset_span(document_rows(spark, sf))


@query
def ingest_rating_polarity(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.rating_polarity(document_rows(spark, sf))


@query
def ingest_product_records(spark: SparkSession, sf: str) -> DataFrame:
    records = files.product_records(inputs.raw_export(spark, sf))
    return records.select(
        "row_pos", "review_id", "product_id", "product_name",
        F.array_join("category_path", ">").alias("category_path"), "category", "rating", "source_rating",
        "discounted_price", "actual_price", "discount_percent", "rating_count", "source_reason",
        F.col("raw.rating").alias("raw_rating"))


@query
def ingest_export_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.classify(files.route(inputs.raw_export(spark, sf)))
    return rows.select("row_pos", "review_id", "product_id", "category", "rating", "source_rating",
                       "review_date", "promotion", "discount_percent", "reject_reason")


@query
def ingest_pruned_export(spark: SparkSession, sf: str) -> DataFrame:
    return files.prune_export(inputs.raw_export(spark, sf))


@query
def ingest_text_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_rows(spark, sf).select("row_pos", F.col("product_id").alias("review_id"), "text")
    return fixtures.size_bounded_sample(rows).select("row_pos", "review_id", "text_bytes", "total_bytes")


@query
def ingest_text_sample_of_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The sample over the documents' own ids, so that the row and byte limits decide."""
    return fixtures.size_bounded_sample(document_rows(spark, sf).select("row_pos", "review_id", "text")).select(
        "row_pos", "review_id", "text_bytes", "total_bytes")


@query
def ingest_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a selection of raw rows can be analysed at all: all of them, and those without an id."""
    raw = inputs.raw_reviews(spark, sf)

    def judged(name: str, rows: DataFrame) -> DataFrame:
        classified = settle(ingest.classify(rows), "judged-selection")
        try:
            ingest.require_accepted(classified)
            usable = True
        except InputError:
            usable = False
        return ingest.load_stats(classified).select(F.lit(name).alias("selection"), F.lit(usable).alias("usable"), "parsed", "accepted")

    return judged("all", raw).unionByName(judged("without_id", raw.filter("trim(review_id) = ''")))


def _written(df: DataFrame, form: str, **options: object) -> str:
    path = f"{shared_folder(df.sparkSession)}/{form}-{uuid.uuid4().hex}"
    df.write.options(**options).format(form).save(path)
    return path


@query
def sources_export_files(spark: SparkSession, sf: str) -> DataFrame:
    """A product export as CSV files in order, read back by header; listings count from 1."""
    raw = inputs.raw_export(spark, sf).repartitionByRange("row_pos").sortWithinPartitions("row_pos").drop("row_pos")
    path = _written(raw, "csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = ingest.classify(files.read_product_export(spark, path))
    return rows.select("row_pos", "review_id", "product_id", "category", "rating", "source_rating",
                       "review_date", "promotion", "discount_percent", "reject_reason")


@query
def sources_preferred(spark: SparkSession, sf: str) -> DataFrame:
    """The real file where it is there, else the stand-in, which says so."""
    path = _written(inputs.raw_export(spark, sf).drop("row_pos"), "csv", header=True, escape='"')
    there = fixtures.preferred(spark, path, "nowhere", "Parts")
    missing = fixtures.preferred(spark, f"{path}-missing", path, "Parts")
    return there.unionByName(missing).groupBy("dataset_label", "is_synthetic").agg(
        F.count("*").alias("rows"), F.countDistinct("product_id").alias("products"))


@query
def sources_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The sample rows beside the documents, by the unit their source decides."""
    rows = ingest.accepted(ingest.classify(fixtures.sample_reviews(spark))).select("source", "rating").unionByName(
        document_rows(spark, sf).select("source", "rating"))
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("rating").cast("long").alias("stars"))


@query
def sources_labelled_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as labelled JSON files, a part each, read back; every eleventh fault clause is not of its text."""
    d, half = F.col("doc_id"), F.floor(F.char_length("text") / 2).cast("int")
    entry = F.struct(
        F.concat(F.lit("d"), d).alias("id"), "text", inputs.pick(d % 3, "mixed", "praise-only", "fault-only").alias("kind"),
        F.substring("text", F.lit(1), half).alias("praiseClause"),
        F.concat(F.substring("text", half + 1, F.char_length("text")), F.when(d % 11 == 0, "#~").otherwise("")).alias("faultClause"),
        F.col("lang").alias("cluster"))
    parts = table(spark, sf, "documents").groupBy(F.expr("doc_id div 100").alias("part")).agg(
        F.to_json(F.struct(F.collect_list(entry).alias("reviews"))).alias("value"))
    path = f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    parts.write.partitionBy("part").text(path)
    mixed, clusters = fixtures.read_mixed_labels(spark, path), fixtures.read_cluster_labels(spark, path)
    wrong = fixtures.mislabelled(mixed).withColumn("wrong", F.lit(True))
    return mixed.join(clusters.select("review_id", "cluster"), "review_id").join(wrong, "review_id", "left").select(
        "review_id", "kind", "cluster", F.md5("praise_clause").alias("praise_md5"), F.coalesce("wrong", F.lit(False)).alias("wrong"))


@query
def sources_results(spark: SparkSession, sf: str) -> DataFrame:
    """Findings stored by scope kind and read again."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    fixtures.write_results(_findings(spark, sf).drop("theme"), path)
    return spark.read.parquet(path)


# -- scopes -------------------------------------------------------------------


@query
def scopes_one_product(spark: SparkSession, sf: str) -> DataFrame:
    return scopes.select_product(*document_reviews(spark, sf), "src1", WINDOW).select(
        "review_id", "review_date", "rating")


@query
def scopes_one_category(spark: SparkSession, sf: str) -> DataFrame:
    return scopes.select_category(*document_reviews(spark, sf), "en", WINDOW).select(
        "review_id", "product_id", "review_date", "rating")


@query
def scopes_all(spark: SparkSession, sf: str) -> DataFrame:
    reviews, products = document_reviews(spark, sf)
    return scopes.expand_scopes(
        reviews.select("row_pos", "review_id", "product_id", "review_date"), products
    ).select("scope_kind", "scope_key", "review_id")


@query
def scopes_selection_order(spark: SparkSession, sf: str) -> DataFrame:
    reviews, products = document_reviews(spark, sf)
    rows = scopes.expand_scopes(
        reviews.select("row_pos", "review_id", "product_id", "review_date"), products)
    return with_position(rows, ["scope_kind", "scope_key"], scopes.selection_order(), "sel_pos").select(
        "scope_kind", "scope_key", "review_id", "sel_pos")


@query
def scopes_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Every language and source of the documents, asked for as product and as category."""
    products = document_reviews(spark, sf)[1]
    docs = table(spark, sf, "documents").select("lang", "source").distinct()
    kinds = F.explode(F.array(F.lit("product"), F.lit("category")))
    asked = docs.select(F.explode(F.array("lang", "source")).alias("scope_key")).distinct().select(
        kinds.alias("scope_kind"), "scope_key")
    return scopes.unknown_scopes(asked, products)


@query
def scopes_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the middle half of the dates, and what becomes of the same window upside down."""
    rows = document_rows(spark, sf)
    first, last = ingest.dataset_span(rows).select("first_date", "last_date").first()
    quarter = (last - first) // 4

    def selected(name: str, start: date, end: date) -> DataFrame:
        try:
            chosen = scopes.in_window(rows, DateWindow(start, end)).agg(F.count("*").alias("rows"))
        except SelectionError:
            chosen = rows.limit(1).select(F.lit(None).cast("long").alias("rows"))
        return chosen.select(F.lit(name).alias("window"), "rows")

    return selected("upright", first + quarter, last - quarter).unionByName(selected("inverted", last - quarter, first + quarter))


@query
def scopes_partition_check(spark: SparkSession, sf: str) -> DataFrame:
    reviews, products = document_reviews(spark, sf)
    chosen = scopes.expand_scopes(
        scopes.in_window(reviews, WINDOW).select("review_id", "product_id"), products
    ).filter("scope_kind = 'category'")
    return scopes.partition_problems(chosen, reviews)


# -- rule engine --------------------------------------------------------------


@query
def themes_hits(spark: SparkSession, sf: str) -> DataFrame:
    return themes.theme_hits(document_rows(spark, sf).select("row_pos", "text"), VOCABULARY).withColumnRenamed("n", "hits")


def _findings(spark: SparkSession, sf: str, window: DateWindow | None = None) -> DataFrame:
    return themes.findings(*document_reviews(spark, sf), VOCABULARY, REVIEW, window)


@query
def themes_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).drop("theme")


@query
def themes_findings_in_window(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf, WINDOW).drop("theme")


@query
def themes_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return themes.with_quotes(_findings(spark, sf), document_reviews(spark, sf)[0], VOCABULARY).select(
        "scope_kind", "scope_key", "polarity", "rank", "label", "review_id", "quote", "quote_author")


@query
def themes_combined(spark: SparkSession, sf: str) -> DataFrame:
    return themes.combined_themes(_findings(spark, sf)).select(
        "scope_kind", "scope_key", "overall_rank", "label", "polarity", "mentions")


@query
def themes_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return themes.recommendations(_findings(spark, sf), VOCABULARY)


@query
def themes_scope_summary(spark: SparkSession, sf: str) -> DataFrame:
    return themes.selection_summary(themes.scope_totals(*document_reviews(spark, sf)))


@query
def themes_record_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Product records: undated, one record is enough evidence."""
    rows = ingest.classify(files.route(inputs.raw_export(spark, sf)))
    return themes.findings(
        ingest.accepted(rows), ingest.product_dimension(rows), inputs.PART_VOCABULARY, PRODUCT_RECORD).drop("theme")


@query
def promotions_by_scope(spark: SparkSession, sf: str) -> DataFrame:
    sales = sale_rows(spark, sf)
    return promotions.promotions(sales, ingest.product_dimension(sales)).withColumn(
        "promotions", F.array_join("promotions", ", "))


@query
def promotions_labels(spark: SparkSession, sf: str) -> DataFrame:
    return promotions.promotion_labels(*document_reviews(spark, sf))


def _flat(found: str) -> F.Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(
        ":", f["rank"].cast("string"), f["label"], f["mentions"].cast("string"), f["percent"].cast("string"),
        f["quote_author"])), "|").alias(found)


def _flat_briefs(made: DataFrame) -> DataFrame:
    extra = [F.col("promotion.note").alias("promotion_note")] if "promotion" in made.columns else []
    return made.select(
        "scope_kind", "scope_key", "subject", "review_count", "average_rating", "summary",
        _flat("praise"), _flat("faults"), F.array_join("recommendations", "|").alias("recommendations"), *extra)


def _rule_briefs(spark: SparkSession, sf: str, window: DateWindow | None = None) -> DataFrame:
    return briefs.rule_briefs(*document_reviews(spark, sf), VOCABULARY, REVIEW, window)


@query
def briefs_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_briefs(_rule_briefs(spark, sf))


@query
def briefs_reports(spark: SparkSession, sf: str) -> DataFrame:
    made = report.report(_rule_briefs(spark, sf, WINDOW), date(2026, 8, 2), REVIEW)
    return made.select("scope_kind", "scope_key", "report")


@query
def briefs_record_actions(spark: SparkSession, sf: str) -> DataFrame:
    """The last section of the reports on product records, of which each rating is an average."""
    rows = ingest.classify(files.route(inputs.raw_export(spark, sf)))
    made = briefs.rule_briefs(ingest.accepted(rows), ingest.product_dimension(rows), inputs.PART_VOCABULARY, PRODUCT_RECORD)
    text = report.report(made, date(2026, 8, 2), PRODUCT_RECORD, report.RATING)
    return text.select("scope_kind", "scope_key", F.regexp_extract(
        "report", r"(?s)## Recommended checks\n\n(.*)\n\n---\n\nMade on", 1).alias("actions"))


# -- tag engine ---------------------------------------------------------------


def _entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parsed = tags.parse_responses(inputs.responses(spark, sf))
    return parsed, tags.entries(parsed)


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return tags.validate(_entries(spark, sf)[1], document_reviews(spark, sf)[0], inputs.asked(spark, sf))


@query
def tags_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf)[1].drop("run_id")


@query
def tags_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of responses that were stored as text files, one each, and as lines of JSON."""
    raw = settle(inputs.responses(spark, sf), "responses")
    as_text = F.col("batch_id") % 25 == 3
    path = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    raw.filter(as_text).write.partitionBy("run_id", "batch_id").text(path)
    read = fixtures.read_responses(spark, path, "text").unionByName(
        fixtures.read_responses(spark, _written(raw.filter(~as_text), "json"), "json"))
    return tags.entries(tags.parse_responses(read)).drop("run_id")


@query
def tags_valid_from_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Valid tags, of reviews that are stored in buckets of their id: no text is exchanged to ground a tag."""
    reviews = bucketed(document_reviews(spark, sf)[0].select("review_id", "text"), "review_id", "reviews_by_id")
    return tags.validate(_entries(spark, sf)[1], reviews, inputs.asked(spark, sf)).drop("run_id")


@query
def tags_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _valid(spark, sf).drop("run_id")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    parsed, found = _entries(spark, sf)
    return tags.outcomes(parsed, found, _valid(spark, sf))


@query
def tags_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).drop("run_id")


@query
def tags_input_problems(spark: SparkSession, sf: str) -> DataFrame:
    raw = inputs.raw_reviews(spark, sf).select("review_id", F.col("review_text").alias("text"))
    return tags.input_problems(raw)


@query
def tags_by_keyword(spark: SparkSession, sf: str) -> DataFrame:
    found = tags.keyword_tags(document_rows(spark, sf), VOCABULARY, ["the", "le", "el", "der"], ["of", "les", "los", "das"])
    return found.groupBy("review_id", "theme", "sentiment").agg(
        F.count("*").alias("tags"), F.sum(F.char_length("evidence")).alias("evidence_chars"))


@query
def tags_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Batches that lose every 97th row and repeat every 89th."""
    placed = with_position(
        document_rows(spark, sf).select("review_id", "row_pos", "review_date"), [],
        scopes.selection_order(), "sel_pos")
    times = F.when(F.col("sel_pos") % 97 == 5, 0).when(F.col("sel_pos") % 89 == 3, 2).otherwise(1)
    held = placed.select(
        F.floor(F.col("sel_pos") / 12).alias("batch_id"), F.col("sel_pos").alias("pos"), "review_id",
        F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")
    return tags.coverage_problems(placed.select("review_id", "sel_pos"), held)


@query
def tags_coverage_order(spark: SparkSession, sf: str) -> DataFrame:
    """Complete batches in which each pair of neighbours of every tenth place is swapped."""
    placed = with_position(
        document_rows(spark, sf).select("review_id", "row_pos", "review_date"), [],
        scopes.selection_order(), "sel_pos")
    swapped = F.when(F.col("sel_pos") % 10 == 0, F.col("sel_pos") + 1).when(
        F.col("sel_pos") % 10 == 1, F.col("sel_pos") - 1).otherwise(F.col("sel_pos"))
    held = placed.select(F.floor(swapped / 12).alias("batch_id"), swapped.alias("pos"), "review_id")
    return tags.coverage_problems(placed.select("review_id", "sel_pos"), held)


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    return briefs.scoped_tags(_valid(spark, sf), *document_reviews(spark, sf))


@query
def labels_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return labels.distinct_labels(_scoped(spark, sf))


@query
def labels_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return labels.chunk_labels(labels.distinct_labels(_scoped(spark, sf)), TWO_LEVELS).select(
        "scope_kind", "scope_key", "label", "chunk", "idx")


@query
def labels_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Line items' status words and whole conversation texts offered as labels."""
    said = table(spark, sf, "conversations").select(
        F.lit("category").alias("scope_kind"), F.col("role").alias("scope_key"), F.col("text").alias("label"),
        F.floor(F.col("conv_id") / 50).cast("int").alias("chunk"))
    return labels.label_problems(said, LabelLimits(max_labels=100, max_length=120, max_bytes=30_000)).withColumn(
        "label", F.md5(F.coalesce("label", F.lit(""))))


@query
def labels_grouping_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Groupings spoiled differently per scope: an index lost, doubled or out of range."""
    chunks = settle(labels.chunk_labels(labels.distinct_labels(_scoped(spark, sf)), TWO_LEVELS), "chunks")
    kind = F.pmod(F.ascii(F.right("scope_key", F.lit(1))), F.lit(5))
    good = inputs.group_by_first_word(chunks)
    first = F.array(F.array(F.lit(0)))
    spoiled = good.withColumn(
        "groups",
        F.when(kind == 0, F.slice("groups", 2, 100)).when(kind == 1, F.concat("groups", first))
        .when(kind == 2, F.concat(F.slice("groups", 2, 100), F.array(F.array(F.lit(99)))))
        .when(kind == 3, F.concat("groups", F.array(F.array().cast("array<int>"))))
        .otherwise(F.col("groups")))
    return labels.grouping_problems(spoiled, chunks)


@query
def labels_map(spark: SparkSession, sf: str) -> DataFrame:
    found = settle(labels.distinct_labels(_scoped(spark, sf)), "labels")
    return labels.reconcile(found, inputs.group_by_first_word, TWO_LEVELS)[0]


@query
def labels_failed_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Some products offer one label of 130 characters, others are grouped wrongly; the rest are complete."""
    found = labels.distinct_labels(_scoped(spark, sf))
    kind = F.when(F.col("scope_kind") == "product", F.pmod(F.ascii(F.right("scope_key", F.lit(1))), F.lit(5))).otherwise(4)
    long = (kind == 0) & (F.col("label_pos") == 0)
    offered = settle(found.withColumn("label", F.when(long, F.rpad("label", 130, "!")).otherwise(F.col("label"))), "labels")

    def group(chunks: DataFrame) -> DataFrame:
        return inputs.group_by_first_word(chunks).withColumn(
            "groups", F.when(kind == 1, F.concat("groups", F.array(F.array(F.lit(99))))).otherwise(F.col("groups")))

    mapped, problems = labels.reconcile(offered, group, LabelLimits(max_labels=100))
    sizes = offered.groupBy("scope_kind", "scope_key").agg(F.count("*").alias("offered"))
    done = mapped.groupBy("scope_kind", "scope_key").agg(F.count("*").alias("mapped"))
    key = ["scope_kind", "scope_key"]
    return sizes.join(done, key, "left").join(problems, key, "left").select(
        *key, "offered", F.coalesce("mapped", F.lit(0).cast("long")).alias("mapped"), "problem")


@query
def labels_composed(spark: SparkSession, sf: str) -> DataFrame:
    found = settle(labels.distinct_labels(_scoped(spark, sf)), "labels")
    mapped = settle(labels.reconcile(found, inputs.group_by_first_word, TWO_LEVELS)[0], "map")
    return labels.compose_levels(found, mapped, TWO_LEVELS).select(
        "scope_kind", "scope_key", "label", "canonical")


@query
def labels_level_problems(spark: SparkSession, sf: str) -> DataFrame:
    """A label map with a level added on which nothing merges, against a tighter limit."""
    found = settle(labels.distinct_labels(_scoped(spark, sf)), "labels")
    first = found.select("scope_kind", "scope_key", F.lit(0).alias("level"), "label", F.lower("label").alias("representative"))
    last = first.withColumn("level", F.lit(2)).withColumn("representative", F.split(F.lower("label"), " ")[0])
    return labels.level_problems(first.unionByName(last), LabelLimits(max_labels=6))


@query
def labels_canonical(spark: SparkSession, sf: str) -> DataFrame:
    found = settle(labels.distinct_labels(_scoped(spark, sf)), "labels")
    mapped = settle(labels.reconcile(found, inputs.group_by_first_word)[0], "map")
    return labels.canonical_labels(labels.compose_levels(found, mapped))


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    scoped = settle(_scoped(spark, sf), "scoped_tags")
    return briefs.reconciled_tags(scoped, inputs.group_by_first_word)[0]


@query
def labels_canonical_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _canonical(spark, sf).select(
        "scope_kind", "scope_key", "review_id", "entry_pos", "sentiment", "canonical_theme",
        "canonical_key", "raw_theme", "raw_key")


def _tag_findings(spark: SparkSession, sf: str) -> DataFrame:
    totals = themes.scope_totals(*document_reviews(spark, sf))
    return tag_findings.tag_findings(_canonical(spark, sf), totals, REVIEW)


@query
def tag_findings_by_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _tag_findings(spark, sf)


@query
def tag_findings_below_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """With a threshold of eight rows, so that many themes miss it."""
    return tag_findings.below_threshold(_canonical(spark, sf), replace(REVIEW, min_evidence=8))


@query
def tag_findings_scarce(spark: SparkSession, sf: str) -> DataFrame:
    """With a threshold that themes of small scopes miss."""
    return tag_findings.below_threshold(_canonical(spark, sf), replace(REVIEW, min_evidence=60))


@query
def tag_findings_mapping_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical tags of which the neutral ones were relabelled by mistake."""
    spoiled = _canonical(spark, sf).withColumn(
        "canonical_key", F.when(F.col("sentiment") == "neutral", F.concat("canonical_key", F.lit("!")))
        .otherwise(F.col("canonical_key")))
    return tag_findings.mapping_problems(spoiled)


@query
def tag_findings_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Tag findings against rule findings: where the two engines differ."""
    quoted = themes.with_quotes(_findings(spark, sf), document_reviews(spark, sf)[0], VOCABULARY)
    return tag_findings.compare_findings(_tag_findings(spark, sf), quoted).select(
        "scope_kind", "scope_key", "polarity", "rank", F.col("left.label").alias("tag_label"),
        F.col("left.mentions").alias("tag_mentions"), F.col("right.label").alias("rule_label"),
        F.col("right.mentions").alias("rule_mentions"))


@query
def briefs_tags_of_few(spark: SparkSession, sf: str) -> DataFrame:
    """Only documents in German were tagged: all other scopes have nothing found, and say so."""
    german = table(spark, sf, "documents").filter("lang = 'de'").select(F.concat(F.lit("d"), F.col("doc_id")).alias("review_id"))
    return _flat_briefs(briefs.tag_briefs(
        _valid(spark, sf).join(german, "review_id", "left_semi"), *document_reviews(spark, sf), inputs.group_by_first_word, REVIEW))


@query
def briefs_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_briefs(briefs.tag_briefs(
        _valid(spark, sf), *document_reviews(spark, sf), inputs.group_by_first_word, REVIEW))


# -- sizing -------------------------------------------------------------------


@query
def sizing_density(spark: SparkSession, sf: str) -> DataFrame:
    return sizing.row_density(sizing.text_sizes(*document_reviews(spark, sf)))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    reviews, products = document_reviews(spark, sf)
    sized = reviews.select("review_id", "product_id", "review_date", "row_pos",
                           F.octet_length("text").cast("long").alias("text_bytes"))
    return sizing.bounded_batches(scopes.expand_scopes(sized, products).drop("product_id"), slice_rows=40)


@query
def sizing_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _batches(spark, sf)


@query
def sizing_estimates(spark: SparkSession, sf: str) -> DataFrame:
    sizes = sizing.text_sizes(*document_reviews(spark, sf))
    made = sizing.run_estimates(sizes, sizing.batch_counts(_batches(spark, sf)), Sizing())
    return made.withColumns({c: F.round(c, 8) for c in ("tagging_usd", "label_usd", "retry_usd", "total_usd",
                                                        "tokens_per_row")})


# -- evaluation ---------------------------------------------------------------


@query
def evaluate_validity(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.evidence_validity(_outcomes(spark, sf), ["run_id"])


@query
def evaluate_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.mixed_recall(_valid(spark, sf), inputs.mixed_labels(spark, sf))


@query
def evaluate_merging(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.merge_rates(_valid(spark, sf), inputs.clusters(spark, sf))


def _run_keys(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("review_id"), F.col("source").alias("model"),
        F.col("lang").alias("fixture"), (F.col("doc_id") % 3).alias("run"))
    return _valid(spark, sf).select("review_id", "theme_key").join(docs, "review_id")


@query
def evaluate_stability(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.theme_stability(_run_keys(spark, sf), ["model", "fixture"]).withColumn("stability", F.round("stability", 9))


@query
def evaluate_stability_of_sound_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Of runs that did not time out or fail: some documents stand for a run that did."""
    runs = table(spark, sf, "documents").groupBy(
        F.col("source").alias("model"), F.col("lang").alias("fixture"), (F.col("doc_id") % 3).alias("run")).agg(
        F.bool_or(F.col("doc_id") % 500 == 7).alias("timed_out"), F.bool_or(F.col("doc_id") % 700 == 9).alias("errored"))
    keys = evaluate.scorable(_run_keys(spark, sf), runs, ["model", "fixture"])
    return evaluate.theme_stability(keys, ["model", "fixture"]).withColumn("stability", F.round("stability", 9))


@query
def evaluate_run_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Stop reasons and means of the figures that some runs lack."""
    timed, prices = inputs.runs(spark, sf)
    n = F.col("input_tokens")
    scored = evaluate.with_cost(timed, prices).withColumns({
        "evidence_validity": F.when(n % 3 > 0, n % 11 / 10), "distinct_themes": n % 17,
        "mixed_recall": F.when(n % 4 == 0, n % 2 / 2), "misattributed": F.when(n % 5 == 0, n % 3)})
    made = evaluate.run_summary(scored, ["model", "fixture"])
    return made.select("model", "fixture", F.array_join("stop_reasons", ",").alias("stop_reasons"), *[
        F.round(f"avg_{c}", 9).alias(f"avg_{c}") for c in ("evidence_validity", "distinct_themes", "mixed_recall", "misattributed")])


@query
def evaluate_runs(spark: SparkSession, sf: str) -> DataFrame:
    timed, prices = inputs.runs(spark, sf)
    made = evaluate.run_summary(evaluate.with_cost(timed, prices), ["model", "fixture"]).drop("stop_reasons")
    return made.withColumn("avg_cost_usd", F.round("avg_cost_usd", 9))


# -- columns ------------------------------------------------------------------


@query
def columns_phrases(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    label = inputs.pick(d % 5, "Sound  quality", "USB port", "GaN charger", " fit ", "X")
    path = F.concat(F.lit(" "), "lang", F.lit("| a  b ||"), "source", F.lit("|"))
    return table(spark, sf, "documents").select(
        "doc_id", lower_first(label).alias("inside_sentence"), label_key(label).alias("label_key"),
        short_date(F.date_add(F.lit("2026-01-01").cast("date"), d.cast("int"))).alias("short_date"),
        F.array_join(category_path(path), ">").alias("path"), top_category(path).alias("top"),
        leaf_category(path).alias("leaf"),
        attribution(F.when(d % 4 == 0, "Ann"), d % 3 == 0, F.when(d % 2 == 0, F.upper("lang"))).alias("credit"),
        report.counted(d, PRODUCT_RECORD).alias("counted"))


@query
def columns_short_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", report.short_label("text").alias("short_label"))
