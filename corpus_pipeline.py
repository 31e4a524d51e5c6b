"""From raw documents to packed training sequences: ``run`` applies ``STAGES`` in order.

Each stage takes the session, the documents its predecessor kept, and the folder of the tables.
All but the last return the columns of ``documents``, and no others. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import exact, language, packing, secrets, simhash
from themeloom.llm.queries import TOKENIZER
from themeloom.storage import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Runs of text whose ids a worker remembers when it packs. Here its memory comes on top of what earlier stages left in the executor.
REMEMBERED = 250_000
#: Texts whose best language has a smaller share than this are rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with that language in ``lang``.

    Rejected are null texts, texts without a letter, and those with a score under ``LEAST_SCORE``.
    Without labelled documents no language can be learned: then texts with a letter stay as they are.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    judged = language.predict(docs.select(*COLUMNS), model)
    return (judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
            .withColumn("lang", F.col("lang_pred")).select(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that with the smallest ``doc_id``; null counts as empty, a null id as the largest."""
    return exact.first_of_equal(docs.select(*COLUMNS)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest ``doc_id``.

    Near copies share four fifths of their five-word shingles or more: see ``simhash.similar_texts``.
    Rows without a ``doc_id`` stay, and rows that share one stay or go together.
    """
    groups = simhash.similar_texts(docs)
    others = settle(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct(), "near-copies")
    return docs.join(others, F.col("doc_id") == F.col("_copy"), "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced; ``n_chars`` counts the new text.

    Null texts become empty; repeated rows, and rows without an id, are kept like any other.
    """
    found = secrets.scan(docs.select(*COLUMNS), secrets.train(docs))
    return found.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, null texts being empty, and their places in sequences; other columns go."""
    return packing.pack(docs, TOKENIZER, remembered=REMEMBERED)


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Learned models, tokens and transitive closures are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder as Parquet and read again by the next.

    ``storage.release`` deletes what was written, once the result is not needed any more.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
