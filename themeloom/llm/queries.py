"""Registered queries of this subpackage, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from themeloom.llm import (
    binary_packing, bpe, exact, html_text, language, merkle, order_minhash, packing, prefix_trie, secrets, simhash, surrogates, urls,
)
from themeloom.llm.batches import table

#: The tokenizer of all queries.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The key of the surrogates of the registered query; a secret elsewhere.
SURROGATE_KEY = "key of the registered query"


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = language.train(documents)
    return language.predict(documents.select("doc_id", "text"), model).drop("text")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), urls.rule_table(spark, urls.RULES))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.compare(table(spark, folder, "documents"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.groups(table(spark, folder, "documents"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.train(pages))


def op7_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace(table(spark, folder, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), TOKENIZER)


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return secrets.scan(documents, secrets.train(documents)).drop("text", "clean_text")


def op11_binary_packing(spark: SparkSession, folder: str) -> DataFrame:
    return binary_packing.pack(table(spark, folder, "documents"), TOKENIZER)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_url_filter, op3_best_fit_packing, op4_order_minhash, op5_exact_dedup, op6_html_text, op7_surrogates, op8_bpe_round_trip, op9_simhash_near_dedup, op10_secret_scan,
    op11_binary_packing, op12_prefix_trie, op13_merkle_manifest)}
ORACLE: dict[str, str] = {
    "op2_url_filter": urls.oracle(), "op5_exact_dedup": exact.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_merkle_manifest": merkle.oracle()}
