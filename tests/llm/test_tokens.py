"""Encoding against the tokenizers library, and packing against exhaustive search."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from themeloom.llm import bpe, packing
from themeloom.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", (2, 7, bpe.LEAF))
def test_tree_concatenation_is_exact(library, leaf):
    coder, r = bpe.Bpe(TOKENIZER, leaf), random.Random(leaf)
    texts = ["".join(r.choice(["th", "in", "e", "ing", "s", "ti", "on", "aa"]) for _ in range(r.randint(1, 900))) for _ in range(60)]
    texts += ["!" * 700, "a" * 1025, "ha" * 600, "é" * 333, "漢字" * 300]
    for t in texts:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids(library, t)


def test_odd_texts(library):
    coder, r = bpe.Bpe(TOKENIZER), random.Random(5)
    bits = list("aZ Σς İ'9²\x1c\x85　&\t\n") + ["é", "'s", "'RE", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "ẛ̣", "🙂", "漢"]
    for _ in range(1500):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        made = coder.encode(t)
        assert np.frombuffer(made, "<u4").tolist() == ids(library, t), repr(t)
        assert coder.decode(made) == library.decode(ids(library, t), skip_special_tokens=False)


def test_segments_of_long_texts(spark, library):
    rows = [(1, "the long text of many words\n" * 40), (2, "the long text of many words\n" * 40), (3, "unsplit" * 100), (4, "short")]
    made = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, segment=50).collect()
    assert len(made) == 4
    for row in made:
        want = ids(library, dict(rows)[row["doc_id"]])
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_copies_of_a_long_text_are_cut_once(spark):
    text = "the long text of many words\n" * 40
    rows = spark.createDataFrame([(f"key {i % 2}", text) for i in range(60)], "_key string, _text string").repartition(4)
    made = sorted(map(tuple, bpe.cut(rows, 50).collect()))
    assert [(k, at) for k, at, _ in made] == [(f"key {i}", at) for i in (0, 1) for at in range(len(made) // 2)]
    assert "".join(part for k, _, part in made if k == "key 1") == text


def test_long_runs_without_white_space(spark, library, monkeypatch):
    """Long words are cut anywhere and joined in a tree of more than one round; other words, special tokens and copies among them."""
    monkeypatch.setattr(bpe, "FAN", 3)
    r = random.Random(3)
    word = "".join(r.choice(["th", "in", "e", "ing", "s", "ti", "on", "aa", "é"]) for _ in range(20_000))
    rows = [(1, word), (2, f"some words, {word.upper()}<|endoftext|>42!{word[:9000]}\u00a0and more {'!' * 5000}x {'a' * 3333}"), (3, word),
            (4, "e\u0301" * 4000), (5, "漢字123abc" * 900), (6, "<|startoftext|>" * 300)]
    made = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, segment=500).collect()
    assert sorted(row["doc_id"] for row in made) == [1, 2, 3, 4, 5, 6]
    for row in made:
        want = ids(library, dict(rows)[row["doc_id"]])
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), row["doc_id"]
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_registered_round_trip(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    made = QUERIES["op8_bpe_round_trip"](spark, TINY).collect()
    assert len(made) == len(texts)
    for row in made:
        want = ids(library, texts[row["doc_id"]])
        decoded = library.decode(want, skip_special_tokens=False)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def fewest(items, capacity):
    """Fewest sequences, by dynamic programming over subsets."""
    best = {0: (1, 0)}
    for mask in range(1 << len(items)):
        used, load = best[mask]
        for i, x in enumerate(items):
            if not mask >> i & 1:
                found = (used, load + x) if load + x <= capacity else (used + 1, x)
                if found < best.get(mask | 1 << i, (99, 0)):
                    best[mask | 1 << i] = found
    return best[(1 << len(items)) - 1][0] if items else 0


def test_dominating_sets_lose_nothing():
    r = random.Random(2)
    for _ in range(120):
        capacity = r.choice([10, 19, 40])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        fixed, left = packing.dominating(Counter(items), capacity)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(b.count for b in fixed) + fewest(rest, capacity) == fewest(items, capacity), (items, capacity)


def test_registered_packing(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    placed, parts = defaultdict(list), defaultdict(dict)
    for row in QUERIES["op3_best_fit_packing"](spark, TINY).collect():
        placed[row["sequence_id"]].append((row["offset"], row["length"]))
        parts[row["doc_id"]][row["piece"]] = row
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = 0
    for doc_id, text in texts.items():
        whole = np.array([*ids(library, text), packing.END_OF_TEXT], "<u4")
        total += len(whole)
        for piece, start in enumerate(range(0, len(whole), packing.CAPACITY)):
            row, cut = parts[doc_id][piece], whole[start:start + packing.CAPACITY]
            assert (row["start"], row["length"], row["ids_crc32"]) == (start, len(cut), zlib.crc32(cut.tobytes()))
    assert len(parts) == len(texts)
    assert len(placed) <= -(-total // packing.CAPACITY) + 1


def test_packing_forgets_its_words(spark):
    df = SimpleNamespace(sparkSession=spark, select=lambda *a: SimpleNamespace(mapInPandas=lambda cut, schema: cut))
    texts = [f"qzxjvw unheardof{i} qzxjvw." for i in range(40)]
    made = list(packing.pieces(df, TOKENIZER)(iter([pd.DataFrame({"doc_id": range(40), "text": texts})])))
    assert len(made[0]) == 40
    coder = packing.loaded(TOKENIZER)
    assert not any("qzxjvw" in c for c in (coder.word_ids, coder.chunk_ids, getattr(coder, "_known", ())))
