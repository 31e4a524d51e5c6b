"""Order MinHash fingerprints, whose likeness falls with the edit distance of two texts.

A text's k-mers of code points are numbered by occurrence, so that repeats count. Each of
``SKETCHES`` random orders selects its ``CHOSEN`` smallest numbered k-mers; they are put back into
text order and hashed as a tuple. Two texts agree on a tuple if they share those k-mers *and*
have them in the same order. The start of a text is padded, so that a text of n code points has
n k-mers, however short it is.

Texts are compared with the next document in descending order of id. That order is one range
shuffle; each task walks through its rows once, holding two of them, and only the first and the
last row of each partition meet their neighbours in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.batches import bounded, filled
from themeloom.storage import settle

K, SKETCHES, CHOSEN = 12, 64, 2
_BLOCK = 1024
_SEEDS = np.random.default_rng(2019)
_FLIP = _SEEDS.integers(0, 1 << 32, (SKETCHES, 1), dtype=np.uint32)
_SPREAD = _SEEDS.integers(0, 1 << 32, (SKETCHES, 1), dtype=np.uint32) | np.uint32(1)
_BASE, _OCCURRENCE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE_2, _BASE_4 = (np.uint64(pow(int(_BASE), n, 1 << 64)) for n in (2, 4))
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes, so that close inputs do not give close outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered_kmers(text: str) -> np.ndarray:
    """A 32-bit hash of each k-mer and its occurrence number, in text order."""
    n = len(text)
    c = np.zeros(n + K - 1, np.uint64)
    c[K - 1:] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c[K - 1:] += np.uint64(1)
    two = c[:-1] * _BASE + c[1:]
    four = two[:-2] * _BASE_2 + two[2:]
    eight = four[:-4] * _BASE_4 + four[4:]
    h = eight[:n] * _BASE_4 + four[8:8 + n]
    s = np.sort(h)
    repeated = s[1:][s[1:] == s[:-1]]
    if len(repeated):
        at = np.searchsorted(repeated, h)
        again = np.flatnonzero(repeated[np.minimum(at, len(repeated) - 1)] == h)
        order = again[np.argsort(h[again], kind="stable")]
        same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
        place = np.arange(len(order))
        first = np.maximum.accumulate(np.where(same, 0, place))
        h[order] += (place - first).astype(np.uint64) * _OCCURRENCE
    return (_mixed(h) >> np.uint64(32)).astype(np.uint32)


def _smallest(kmers: np.ndarray, start: int, state: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Values and positions of the smallest k-mers in each order, of those in ``state`` and ``kmers[start:]``."""
    rows = np.arange(SKETCHES)
    for at in range(start, len(kmers), _BLOCK):
        values = (kmers[None, at:at + _BLOCK] ^ _FLIP) * _SPREAD
        best, where = [], []
        for _ in range(min(CHOSEN, values.shape[1])):
            i = values.argmin(axis=1)
            best.append(values[rows, i].astype(np.int64))
            where.append(i + at)
            values[rows, i] = 0xFFFFFFFF
        v, p = np.column_stack(best), np.column_stack(where)
        if state is not None:
            v, p = np.column_stack([state[0], v]), np.column_stack([state[1], p])
            order = np.argsort(v, axis=1, kind="stable")[:, :CHOSEN]
            v, p = np.take_along_axis(v, order, 1), np.take_along_axis(p, order, 1)
        state = v, p
    return state


def _tuples(kmers: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """16 bits of each tuple of selected k-mers in text order; zero without k-mers."""
    if state is None:
        return np.zeros(SKETCHES, np.uint16)
    h = np.arange(SKETCHES, dtype=np.uint64)
    for column in np.sort(state[1], axis=1).T:
        h = _mixed(h * _BASE + kmers[column] + np.uint64(1))
    return (h >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str) -> np.ndarray:
    kmers = numbered_kmers(text)
    return _tuples(kmers, _smallest(kmers, 0, None))


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last third replaced by the beginning of the next one, and how much is kept."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third], len(text) - third


def _both(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and its edited text, whose common beginning is looked at once."""
    other, kept = edited(text, following)
    a, b = numbered_kmers(text), numbered_kmers(other)
    common = _smallest(a[:kept], 0, None)
    return _tuples(a, _smallest(a, kept, common)), _tuples(b, _smallest(b, kept, common)), other


def written(tuples: np.ndarray) -> str:
    return tuples.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _row(doc_id, text: str, following: str, next_tuples: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The result of a document, and its own tuples."""
    own, changed, other = _both(text, following)
    return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), written(own),
            written(changed), likeness(own, changed), likeness(own, next_tuples)), own


_COLUMNS = ROW.replace(",", "").split()[::2]


def compare(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: fingerprints of its text and edited text, and how near they and the next document's are.

    Documents are in descending order of ``doc_id``, null last, equal ids by text; after the last
    comes the first. Null text counts as empty and has the fingerprint zero; a single document is
    its own next one; other columns are not carried; an empty table gives no rows.
    """
    bounded(df.sparkSession)
    # Rows are read backwards, so each is complete when it arrives: its next document came before it.
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").desc()]
    rows = (df.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text"))
            .repartitionByRange(order[0]).sortWithinPartitions(*order))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        names = [*_COLUMNS, "part", "edge", "text"]
        last = None
        for batch in batches:
            out = []
            for key, own in zip(batch["doc_id"].astype("Int64").array, batch["text"], strict=True):
                if last is None:
                    out.append((key, *[None] * 6, part, "first", own))
                    tuples = fingerprint(own)
                else:
                    made, tuples = _row(key, own, last[1], last[2])
                    out.append((*made, part, None, None))
                last = key, own, tuples
            yield _framed(out, names)
        if last is not None:
            yield _framed([(last[0], *[None] * 6, part, "last", last[1])], names)

    walked = settle(rows.mapInPandas(walk, ROW + ", part int, edge string, text string"), "order-minhash")
    # Two rows per partition: the first of each still lacks its next document, the last of the partition before it.
    lasts = walked.filter("edge = 'last'").select("part", F.col("text").alias("following"))
    firsts = walked.filter("edge = 'first'").select("doc_id", "text", "part")
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    parts = lasts.select("part", F.lag("part").over(every).alias("before"),
                         F.max("part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    pairs = (firsts.join(parts, "part").withColumn("_from", F.coalesce("before", "end"))
             .join(lasts.withColumnRenamed("part", "_from"), "_from"))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _framed([
                _row(key, own, following, fingerprint(following))[0] for key, own, following
                in zip(batch["doc_id"].astype("Int64").array, batch["text"], batch["following"], strict=True)], _COLUMNS)

    closed = pairs.select("doc_id", "text", "following").mapInPandas(edges, ROW)
    return walked.filter("edge IS NULL").select(*_COLUMNS).unionByName(closed)


def _framed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=names)
    return made.astype({"doc_id": "Int64", "n_chars": "Int64", "near_edited": "float64", "near_next": "float64"})
