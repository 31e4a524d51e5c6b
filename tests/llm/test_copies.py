"""Exact and near copies, components and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from themeloom.llm import components, exact, order_minhash, simhash
from themeloom.llm.queries import QUERIES

TINY = "/root/testdata/sf0.001"


def roots(codes):
    """Smallest position that links of at most three bits reach, by repeated minima over all pairs."""
    c = np.array(codes, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(c[:, None] ^ c[None, :]) <= simhash.MOST_BITS
    label = np.arange(len(c))
    while True:
        least = np.where(near, label[None, :], len(c)).min(axis=1)
        if (least == label).all():
            return label.tolist()
        label = least


def test_bloom_filter_misses_no_copy(spark):
    texts = [(i, f"text {i % 700}") for i in range(1_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for bits in (exact.BLOCK_BITS, exact.MAX_BITS):
        made = {r["doc_id"]: r for r in exact.groups(df, max_bits=bits).collect()}
        for i, _ in texts:
            assert (made[i]["keep_id"], made[i]["kept"]) == (i % 700, i < 700)
            assert made[i]["group_size"] == (2 if i % 700 < 300 else 1)


def test_whole_rows_that_stay(spark):
    df = spark.createDataFrame([(3, "a b", "x"), (1, "a  b", "y"), (2, "c", "z"), (1, "a  b", "w")], "doc_id long, text string, note string")
    assert sorted(map(tuple, exact.first_of_equal(df).collect())) == [(1, "a  b", "w"), (2, "c", "z")]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)]
    parent = {}
    for a, b in edges + [(b, a) for a, b in edges] * 1:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    made = dict(map(tuple, components.components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "a long, b long")).collect()))
    assert made == {n: p for n, p in parent.items() if n in made}
    assert set(made) == {n for e in edges if e[0] != e[1] for n in e}


@pytest.mark.parametrize("key_rows", (simhash.KEY_ROWS, 2))
def test_trie_join_links_all(spark, key_rows):
    r = np.random.default_rng(key_rows)
    codes = {0}
    for base in map(int, r.integers(-2**63, 2**63 - 1, 40)):
        code = base
        for _ in range(12):
            codes.add(code)
            for k in r.integers(0, 64, r.integers(1, 5)):
                code = ((code ^ (1 << int(k))) + 2**63) % 2**64 - 2**63
    codes = sorted(codes)
    edges = simhash.near_fingerprints(spark.createDataFrame([(c,) for c in codes], "code long"), key_rows)
    root = dict(map(tuple, components.components(edges).collect()))
    ours, theirs = [root.get(c, c) for c in codes], [codes[i] for i in roots(codes)]
    assert len(set(zip(ours, theirs, strict=True))) == len(set(ours)) == len(set(theirs))


def test_large_group_costs_no_pairs():
    codes = np.unique(np.random.default_rng(0).integers(0, 1 << 14, 9_000).astype(np.uint64))
    label = simhash.trie_links(codes, np.array([[0, len(codes), 0, len(codes), 0]]), 48)
    assert set(label) == {0}


def test_registered_near_copies(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{TINY}/documents.parquet").collect())
    codes = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        codes.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = roots(np.array(codes, dtype=np.uint64).view(np.int64))
    made = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_near_dedup"](spark, TINY).collect()}
    assert made == {i: (f"{c:016x}", rows[k][0]) for (i, _), c, k in zip(rows, codes, root, strict=True)}


def plain_fingerprint(text):
    """All numbered k-mers by a dictionary, and each order by sorting all of them."""
    padded, seen, numbered = "\0" * (order_minhash.K - 1) + text, {}, []
    for i in range(len(text)):
        k = padded[i:i + order_minhash.K]
        seen[k] = seen.get(k, 0) + 1
        numbered.append((k, seen[k]))
    assert len(set(zip(numbered, order_minhash.numbered_kmers(text).tolist(), strict=True))) == len(text)
    hashes, out = order_minhash.numbered_kmers(text).astype(object), []
    for flip, spread in zip(order_minhash._FLIP[:, 0].tolist(), order_minhash._SPREAD[:, 0].tolist(), strict=True):
        order = sorted(range(len(text)), key=lambda i: ((int(hashes[i]) ^ flip) * spread % 2**32, i))
        out.append(tuple(int(hashes[i]) for i in sorted(order[:order_minhash.CHOSEN])))
    return out


def test_order_minhash_against_sorting():
    r = random.Random(3)
    texts = ["", "a", "ab", "banana " * 30, "".join(r.choice("abcd ") for _ in range(2500))]
    texts.append(texts[-1][:1800] + texts[-1][2000:])
    for a in texts:
        for b in texts[-3:]:
            plain = np.mean([x == y for x, y in zip(plain_fingerprint(a), plain_fingerprint(b), strict=True)])
            assert abs(order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b)) - plain) < 0.02


def test_registered_order_minhash(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()), reverse=True)
    made = {r["doc_id"]: r for r in QUERIES["op4_order_minhash"](spark, TINY).collect()}
    assert len(made) == len(rows)
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        third = len(text) // 3
        other = text[:len(text) - third] + following[:third]
        a, b, c = map(order_minhash.fingerprint, (text, other, following))
        row = made[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (order_minhash.written(a), order_minhash.written(b))
        assert (row["near_edited"], row["near_next"]) == (order_minhash.likeness(a, b), order_minhash.likeness(a, c))


def test_order_matters_more_than_content():
    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(1200))
    swapped = a[600:] + a[:600]
    changed = a[:590] + "zz" + a[592:]
    near = lambda x: order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(x))
    assert near(changed) > 0.8 > 0.75 > near(swapped)


def test_digest_column(spark):
    row = spark.createDataFrame([("a \t\n b c",)], "text string").select(exact.digest().alias("d")).first()
    assert row["d"] == hashlib.sha256("a b c".encode()).hexdigest()
    assert spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0] == hashlib.sha256(b"").hexdigest()
