"""The pipeline's stages against plain versions, each on what the stage before it kept."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from themeloom.llm import packing, secrets, simhash
from themeloom.llm.batches import bounded
from themeloom.llm.queries import TOKENIZER

TINY = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    extra = [(900_001, None, "en", "s", None), (900_002, "!!! 123", "en", "s", 7), (900_003, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    sizes = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, TINY).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = docs.collect()
        sizes[name] = len(after)
        if name != "best_fit_packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            after = {r["doc_id"]: r for r in after}
        if name == "language_id":
            assert set(before) - set(after) == {900_001, 900_002, 900_003}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]["text"]), i)
            assert set(after) == set(first.values())
            assert all(after[i] == before[i] for i in after)
        elif name == "secret_scan":
            assert set(after) == set(before)
            assert not any(secrets.base_spans(r["text"]) for r in after.values() if "[SECRET]" in r["text"])
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "best_fit_packing":
            assert {r["doc_id"] for r in after} == set(before)


def test_near_copies_leave_one(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text + " end"), (9, text.replace("word7 ", "word8 ")), (4, "something else altogether, with other words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, TINY).collect()) == [3, 4]


def kept_by_brute_force(rows, least=0.8):
    """Smallest ids of the components of all pairs that share ``least`` of their five-word shingles."""
    sets = {}
    for i, text in sorted(rows):
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    label = {i: i for i in sets}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return {i for i, x in label.items() if i == x}


@pytest.mark.parametrize(("most_chars", "band_rows"), ((simhash.COMPARED_CHARS, simhash.BAND_ROWS), (9_000, 7)))
def test_similar_texts_against_brute_force(spark, most_chars, band_rows):
    r = random.Random(11)
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    for n in range(25):  # groups of edits, of which some pairs are just above and some just below
        words = [f"w{r.randint(0, 3000)}" for _ in range(150)]
        for k in range(12 if n else 60):
            edited = list(words)
            for _ in range(k % 6):
                edited[r.randrange(150)] = f"v{r.randint(0, 3000)}"
            rows.append((1_000_000 + 100 * n + k, " ".join(edited)))
    made = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), most_chars=most_chars, band_rows=band_rows).collect()
    assert sorted(x["doc_id"] for x in made) == sorted(i for i, _ in rows)
    assert {x["component_id"] for x in made} == kept_by_brute_force(rows)


@pytest.mark.parametrize("words", (120, 1_500))
def test_share_of_links_that_become_candidates(spark, words):
    """Pairs of similarity 0.8 to 0.85, of short and of long texts."""
    r, rows = random.Random(words), []
    for n in range(400):
        a = [r.randint(0, 1 << 40) for _ in range(words)]
        b = list(a)
        while (same := len({*zip(*(a[i:] for i in range(5)))} & {*zip(*(b[i:] for i in range(5)))}) / (words - 4)) > 0.92:  # noqa: B905
            b[r.randrange(words)] = r.randint(0, 1 << 40)
        if same / (2 - same) >= 0.8:
            for k, x in enumerate((a, b)):
                found = simhash.shingle_set(" ".join(map(str, x)), 5)
                rows.append((2 * n + k, simhash.fingerprint_of_set(found), simhash.bands_of(found).tolist()))
    edges = simhash.near_in_bands(spark.createDataFrame(rows, "code long, print long, bands array<long>")).distinct().collect()
    assert all(e["a"] // 2 == e["b"] // 2 for e in edges)
    assert len(edges) >= 0.99 * len(rows) / 2 > 50


def test_near_dedup_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, TINY).collect()}
    assert kept == kept_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TINY)
    assert docs.collect() == []


def test_language_is_predicted_once(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    plan = corpus_pipeline.language_id(spark, docs, TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_workers_get_small_batches(spark):
    """A batch is in a worker several times, and two workers stand beside an executor's heap."""
    bounded(spark)
    texts = spark.range(4_000, numPartitions=1).select(F.repeat(F.lit("word "), 400).alias("text"))
    sizes = texts.mapInPandas(lambda batches: (pd.DataFrame({"n": [int(b["text"].str.len().sum())]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 4_000 * 2_000
    assert max(r["n"] for r in sizes) <= 2_500_000


def test_packing_remembers_few_words(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(200)
    few, all_of_them = (sorted(map(tuple, packing.pack(docs, TOKENIZER, remembered=n).collect())) for n in (20, 700_000))
    assert few == all_of_them
