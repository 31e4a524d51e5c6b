"""Near duplicates by SimHash, found with a binary-trie self-join.

Fingerprints are the keys of a binary trie. A pair of nodes is traversed together: its children
are paired, differing bits add up, and pairs over the error budget are pruned. Over 64 random
bits the upper levels of such a traversal prune nothing, so four rotations of the fingerprint
are joined instead, each with no budget for its first 16 bits: of four blocks at most three can
hold one of three errors, so every link shows in at least one rotation. Equal first blocks are
then a shuffle key, and each task joins the tries below its keys.

What a task finds is returned as a forest, one edge per fingerprint at most, and node pairs whose
fingerprints are all linked already are skipped, so a large group of near copies costs neither
pairs nor rows in the square of its size. A key with very many fingerprints is split: its trie
is cut some levels further down, and the pairs of nodes there that stay within the budget become
keys of their own.

``similar_texts`` finds near copies by the Jaccard similarity of their shingles instead. Texts of
similarity 0.8 are some ten of 64 bits apart, too many for blocks without errors, and blocks of bits
would also bring more unrelated texts together the larger the corpus is. Its keys are therefore
bands of minima of the shingles' hashes, which only texts that share shingles have in common,
whatever the size; below each key the fingerprints meet in the same trie join, with a budget of
their own. What this connects is only a candidate: links are confirmed by the exact similarity of
the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from themeloom.llm.batches import bounded, filled, give_back
from themeloom.llm.components import components
from themeloom.storage import settle

SHINGLE, MOST_BITS, SEED = 3, 3, 42
BLOCK, BLOCKS = 16, 4
#: Fingerprints below one key in one task; more are split at deeper nodes.
KEY_ROWS = 50_000
#: Rows of one join partition, and node pairs that are traversed at once.
PARTITION_ROWS, PAIRS = 200_000, 1 << 16
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAVES = 64
_HASHED = 1 << 14
#: Of ``similar_texts``: words of a shingle, least similarity, bits that two fingerprints may differ in.
SIMILAR_SHINGLE, SIMILAR, SIMILAR_BITS = 5, 0.8, 18
#: Minima of a band, and bands: of pairs with similarity 0.8, 1 - (1 - 0.8^5)^16 = 99.8 % share one.
MINIMA, BANDS = 5, 16
#: Texts below one band that are compared by fingerprint; of more, all are candidates.
BAND_ROWS = 4_000
#: Code points of the texts that one task compares exactly.
COMPARED_CHARS = 1 << 20


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, signed: a bit is 1 if it is 1 in over half of the shingle hashes; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, runs)), ">u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _HASHED):
        part = hashes[at:at + _HASHED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")


def hex16(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


class _Linked:
    """Components of the positions of an array; ``label`` is the smallest position of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._changes: np.ndarray | None = None

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up
            self._changes = None

    def done(self, pairs: np.ndarray) -> np.ndarray:
        """Whether all positions of both ranges of a pair belong to one component."""
        if self._changes is None:
            self._changes = np.concatenate([[0, 0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(1, int)
        a, a1, b, b1 = pairs[:, 0], pairs[:, 1] - 1, pairs[:, 2], pairs[:, 3] - 1
        c, one = self._changes, self.label
        return (one[a] == one[b]) & (c[a1 + 1] == c[a + 1]) & (c[b1 + 1] == c[b + 1])


def trie_links(keys: np.ndarray, roots: np.ndarray, bits: int, budget: int = MOST_BITS) -> np.ndarray:
    """Smallest linked position of each of ``keys``, by traversing node pairs from ``roots`` down.

    A node is a range of ``keys`` with a common prefix, sorted by the remaining ``bits``; a root is
    a pair of nodes and the errors so far: (from, to, from, to, errors). Equal ranges pair a node
    with itself. Positions that stay alone are their own label.
    """
    linked = _Linked(len(keys))
    ones: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (keys >> np.uint64(bits - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
        return hi - (ones[depth][hi] - ones[depth][lo])

    def compare(pairs: np.ndarray) -> None:
        wide = pairs[:, 3] - pairs[:, 2]
        each = (pairs[:, 1] - pairs[:, 0]) * wide
        row = np.repeat(np.arange(len(pairs)), each)
        at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        a, b = pairs[row, 0] + at // wide[row], pairs[row, 2] + at % wide[row]
        near = np.bitwise_count(keys[a] ^ keys[b]) + pairs[row, 5] <= budget
        linked.link(a[near], b[near])

    # Column 5: errors above the bits in ``keys``, which a comparison of leaves does not see.
    todo = [(0, np.column_stack([roots, roots[:, 4]]).astype(np.int64))] if len(roots) else []
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > PAIRS:
            todo.append((depth, pairs[PAIRS:]))
            pairs = pairs[:PAIRS]
        pairs = pairs[~linked.done(pairs)]
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAVES
        if depth == bits:
            small[:] = True
        compare(pairs[small])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        a, a1, b, b1, errors, above = pairs.T
        am, bm = middle(a, a1, depth), middle(b, b1, depth)
        same = a == b
        straight = [np.column_stack(x) for x in ((a, am, b, bm, errors, above), (am, a1, bm, b1, errors, above))]
        crossed = [np.column_stack((a, am, bm, b1, errors + 1, above)),
                   np.column_stack((am, a1, b, bm, errors + 1, above))[~same]]
        for found in (np.concatenate(crossed), np.concatenate(straight)):  # fewer errors are traversed first
            found = found[(found[:, 0] < found[:, 1]) & (found[:, 2] < found[:, 3]) & (found[:, 4] <= budget)]
            if len(found):
                todo.append((depth + 1, found))
    return linked.label


def _join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links below the keys of one partition: rows sorted by key, side and the bits after the first block."""
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    key = rows[["turn", "block", "node", "mask"]].to_numpy(np.int64)
    side, mask = rows["side"].to_numpy(), key[:, 3]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    ends = np.append(starts[1:], len(rows))
    first = np.concatenate([[0], np.cumsum(side == 0)])
    cut = starts + first[ends] - first[starts]
    own = mask[starts] == 0
    roots = np.column_stack([
        starts, np.where(own, ends, cut), np.where(own, starts, cut), ends,
        np.where(own, 0, np.bitwise_count(mask[starts].astype(np.uint64)))])
    roots = roots[(roots[:, 1] - roots[:, 0] > 0) & (roots[:, 3] - roots[:, 2] > 0) & (ends - starts > 1)]
    rest = rows["rest"].to_numpy(np.int64).astype(np.uint64)
    label = trie_links(rest, roots, 64 - BLOCK)
    found = np.flatnonzero(label != np.arange(len(label)))
    code = rows["code"].to_numpy(np.int64)
    yield pd.DataFrame({"a": code[found], "b": code[label[found]]})


def near_fingerprints(codes: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints at ``MOST_BITS`` or fewer differing bits.

    ``codes`` holds distinct fingerprints in the column ``code``. Edges are within components, not
    all links: what they connect is what the links connect.
    """
    def turned(i: int) -> Column:
        code = F.col("code")
        return code if i == 0 else F.shiftleft(code, BLOCK * i).bitwiseOR(F.shiftrightunsigned(code, 64 - BLOCK * i))

    low = (1 << (64 - BLOCK)) - 1
    turns = codes.select("code", F.explode(F.array(*[
        F.struct(F.lit(i).alias("turn"), F.shiftrightunsigned(turned(i), 64 - BLOCK).alias("block"),
                 turned(i).bitwiseAND(F.lit(low)).alias("rest")) for i in range(BLOCKS)])).alias("t")).select("code", "t.*")
    # At most BLOCKS rows per ``key_rows`` fingerprints.
    large = turns.groupBy("turn", "block").count().filter(F.col("count") > key_rows).select(
        "turn", "block", F.ceil(F.log2(F.col("count") / key_rows)).cast("int").alias("levels"))
    sized = turns.join(settle(large, "large-keys"), ["turn", "block"], "left").withColumn("levels", F.least(F.coalesce("levels", F.lit(0)), F.lit(16)))
    masks = F.filter(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("levels")).cast("int") - 1), lambda m: F.bit_count(m) <= MOST_BITS)
    node = F.expr(f"shiftright(rest, {64 - BLOCK} - levels)").cast("int")
    dealt = (sized.withColumn("at", node).withColumn("mask", F.explode(masks))
             .withColumn("other", F.col("at").bitwiseXOR(F.col("mask")))
             .select("turn", "block", F.least("at", "other").alias("node"), "mask",
                     (F.col("at") > F.col("other")).cast("int").alias("side"), "levels", "rest", "code")
             # The cut levels are spent: below them the trie starts anew.
             .withColumn("rest", F.expr(f"rest & (shiftleft(1L, {64 - BLOCK} - levels) - 1)")).drop("levels"))
    key = ["turn", "block", "node", "mask"]
    spark = codes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-BLOCKS * codes.count() // PARTITION_ROWS))
    return (dealt.repartition(parts, *key).sortWithinPartitions(*key, "side", "rest", "code")
            .mapInPandas(_join, "a long, b long"))


def near_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint in hex, component_id.

    Null text counts as empty; texts without words have fingerprint zero, linked like any other.
    ``component_id`` is the smallest ``doc_id`` that links reach, nulls left out; repeated rows are
    rows of the same component. Other columns are not carried; an empty table gives no rows.
    """
    bounded(df.sparkSession)
    rows = settle(df.select(F.col(doc_id).alias("doc_id"), fingerprint(filled(text)).alias("code")), "fingerprints")
    codes = settle(rows.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    roots = settle(components(near_fingerprints(codes.select("code"), key_rows)), "code-roots")
    rooted = settle(codes.join(roots, F.col("code") == F.col("node"), "left").select(
        "code", "first", F.coalesce("root", "code").alias("root")), "rooted-codes")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settle(rooted.join(least, "root").select(F.col("code").alias("_code"), "component_id"), "code-components")
    return rows.join(named, F.col("code") == F.col("_code")).select("doc_id", hex16("code").alias("fingerprint"), "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``shingle`` words, in order; of all words, if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words] if words else []
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, runs)), np.uint64))


def fingerprint_of_set(shingles: np.ndarray) -> int:
    """64-bit SimHash of a shingle set, signed."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _HASHED):
        ones += np.unpackbits(shingles[at:at + _HASHED, None].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view("<i8")[0])


_ODD_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, (MINIMA * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(6).integers(0, 1 << 63, (BANDS, MINIMA + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each band of minima of a shingle set; that of no shingles has bands of its own."""
    least = np.full(MINIMA * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[None, at:at + 1024] * _ODD_FACTORS).min(axis=1), out=least)
    h = ((least >> np.uint64(16)).reshape(BANDS, MINIMA) * _BAND[:, 1:]).sum(axis=1, dtype=np.uint64) + _BAND[:, 0]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _band_join(batches: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """Links below the bands of one partition, rows sorted by band and fingerprint; a run of whole bands at a time."""
    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        band, code = rows["band"].to_numpy(), rows["code"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        ends = np.append(starts[1:], len(rows))
        roots = np.column_stack([starts, ends, starts, ends, np.zeros_like(starts)])[ends - starts > 1]
        label = trie_links(rows["print"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63), roots, 64, budget)
        found = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": code[found], "b": code[label[found]]})

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = int(np.searchsorted(held["band"].to_numpy(), held["band"].iloc[-1])) if len(held) else 0
        if last:
            yield linked(held.iloc[:last])
            held = held.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield linked(held)


def near_in_bands(sets: DataFrame, band_rows: int = BAND_ROWS, budget: int = SIMILAR_BITS) -> DataFrame:
    """Candidate edges ``(a, b)`` of ``sets`` (code, print, bands): those that share a band and are within ``budget`` bits.

    What they connect is what all candidates connect. Of a band with more than ``band_rows`` sets, which is one
    large group of near copies or a very common passage, all are candidates of each other, whatever their
    bits: that adds candidates and loses none, and its rows are never gathered in one task.
    """
    each = sets.select(F.explode("bands").alias("band"), "print", "code")
    # At most BANDS rows per ``band_rows`` sets.
    large = settle(each.groupBy(F.col("band").alias("_band")).agg(F.count("*").alias("n"), F.min("code").alias("_least"))
                   .filter(F.col("n") > band_rows).drop("n"), "large-bands")
    met = each.join(large, F.col("band") == F.col("_band"), "left")
    stars = met.filter("_least < code").select(F.col("code").alias("a"), F.col("_least").alias("b"))
    small = met.filter("_band IS NULL").select("band", "print", "code")
    return (small.repartition("band").sortWithinPartitions("band", "print", "code")
            .mapInPandas(partial(_band_join, budget=budget), "a long, b long").unionByName(stars))


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A forest over the positions of ``sets`` that connects all pairs of Jaccard similarity ``least`` or more."""
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    alone, links = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        todo = [root] if alone[root] else []
        alone[root] = False
        while todo:
            i = todo.pop()
            lo, hi = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], "right")
            each = hi - lo
            at = np.arange(each.sum()) + np.repeat(lo - np.cumsum(each) + each, each)
            both = np.bincount(owner[at], minlength=len(sets))
            found = np.flatnonzero(alone & (both / np.maximum(sizes + sizes[i] - both, 1) >= least))
            alone[found] = False
            todo += found.tolist()
            links += [(i, j) for j in found.tolist()]
    return links


def _confirmed(tiles: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges ``(a, b)`` of texts of one ``tile`` (root, x, y) that connect all similar ones in it."""
    def linked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("code")
        code = group["code"].to_numpy()
        links = np.array(similar_links([shingle_set(t, shingle) for t in group["text"]], least), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": code[links[:, 0]], "b": code[links[:, 1]]})

    return tiles.groupBy("root", "x", "y").applyInPandas(linked, "a long, b long")


def _similar_among(texts: DataFrame, shingle: int, least: float, most_chars: int) -> DataFrame:
    """Edges that connect all similar texts of each candidate group ``root``; ``texts`` are distinct by ``code``.

    Texts of a large group are dealt over parts at random, twice. Most of it is connected within
    these parts; only the texts that are not in its largest component then meet all of its parts.
    """
    def part(turn: int, of: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(turn), "code"), F.col(of)).cast("int")

    def parts_of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("root").agg(F.ceil(F.sum(F.length("text") + 1) / most_chars).alias(name))

    sized = texts.join(settle(parts_of(texts, "parts"), "group-parts"), "root")
    turns = F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda t: (t == 0) | (F.col("parts") > 1)))
    first = sized.withColumn("x", turns).withColumn("y", F.when(F.col("x") == 0, part(0, "parts")).otherwise(part(1, "parts")))
    edges = settle(_confirmed(first, shingle, least), "similar")
    large = sized.filter("parts > 1")
    if large.isEmpty():
        return edges
    known = settle(components(edges), "similar-roots").withColumnsRenamed({"node": "code", "root": "own"})
    placed = settle(large.join(known, "code", "left").withColumn("own", F.coalesce("own", "code")), "large-groups")
    main = placed.groupBy("root", "own").count().groupBy("root").agg(F.max(F.struct("count", "own")).alias("main")).select("root", "main.own")
    left = settle(placed.join(main, ["root", "own"], "left_anti"), "left-over")
    if left.isEmpty():
        return edges
    counted = placed.join(settle(parts_of(left, "rest"), "left-over-parts"), "root")
    of_all = counted.select("root", "code", "text", part(0, "parts").alias("y"), F.explode(F.sequence(F.lit(0), F.col("rest").cast("int") - 1)).alias("x"))
    of_left = counted.join(left.select("code"), "code", "left_semi").select(
        "root", "code", "text", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("y"), part(2, "rest").alias("x"))
    return edges.unionByName(settle(_confirmed(of_all.unionByName(of_left), shingle, least), "similar"))


def similar_texts(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SIMILAR_SHINGLE, least: float = SIMILAR,
                  budget: int = SIMILAR_BITS, band_rows: int = BAND_ROWS,
                  most_chars: int = COMPARED_CHARS) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest ``doc_id`` that links reach, nulls left out.

    Texts are linked if the Jaccard similarity of their shingle sets is ``least`` or more. Links
    come from bands and fingerprints, so one may be missed, but none is made that is not there. Texts of the
    same shingles are one text; null text counts as empty, and texts without words are the same.
    """
    bounded(df.sparkSession)

    @F.pandas_udf("code long, print long, bands array<long>")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch]
            yield pd.DataFrame({"code": np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64),
                                "print": np.array([fingerprint_of_set(s) for s in sets], np.int64), "bands": list(map(bands_of, sets))})
        give_back()

    whole = df.select(F.col(doc_id).alias("doc_id"), filled(text).alias("text"))
    rows = settle(whole.select("doc_id", F.xxhash64("text").alias("key"), printed("text").alias("made")).select("doc_id", "key", "made.*"), "shingle-sets")
    codes = settle(rows.groupBy("code").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.first("print").alias("print"), F.first("bands").alias("bands")), "distinct-sets")
    groups = settle(components(near_in_bands(codes.select("code", "print", "bands"), band_rows, budget)), "candidate-groups")
    members = settle(codes.join(groups, F.col("code") == F.col("node")).select("code", F.col("key").alias("_key"), "root"), "candidates")
    texts = settle(whole.select("text", F.xxhash64("text").alias("key")).join(members, F.col("key") == F.col("_key"))
                   .groupBy("code").agg(F.first("root").alias("root"), F.first("text").alias("text")), "candidate-texts")
    roots = settle(components(_similar_among(texts, shingle, least, most_chars)), "similar-roots")
    rooted = settle(codes.join(roots, F.col("code") == F.col("node"), "left").select("code", "first", F.coalesce("root", "code").alias("root")), "rooted-sets")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settle(rooted.join(smallest, "root").select(F.col("code").alias("_code"), "component_id"), "set-components")
    return rows.join(named, F.col("code") == F.col("_code")).select("doc_id", "component_id")
