"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens, in parallel. How many pieces there
are of each length is all that packing needs: at most ``capacity`` numbers, however large the
corpus. The driver solves that compressed instance: it fixes sets that provably dominate every
alternative, and packs the rest by best fit, decreasing. The outcome is a list of runs ("pieces
number a to b of length n go to sequences from s on"), which tasks look up by the rank of a
piece among those of its length. Ranks come from one range shuffle of narrow rows; texts and ids
are never shuffled.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batch_bpe import REMEMBERED, loaded, runs
from themeloom.llm.batches import bounded, filled, give_back
from themeloom.storage import settle

CAPACITY, END_OF_TEXT = 4096, 1
#: Code points of the texts that are encoded at once.
TOGETHER = 1 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_RANK_BITS = 44


@dataclass
class Bins:
    """``count`` sequences with the same content: (length, how many of it, offset of the first)."""

    count: int
    free: int
    content: list[tuple[int, int, int]] = field(default_factory=list)

    def filled(self, count: int, length: int, each: int, capacity: int) -> Bins:
        return Bins(count, self.free - length * each, [*self.content, (length, each, capacity - self.free)])


def dominating(counts: dict[int, int], capacity: int) -> tuple[list[Bins], dict[int, int]]:
    """Sequences that dominate all alternatives, and the pieces that are left.

    With ``w`` the longest piece and ``k`` the longest one that fits beside it, {w} is fixed if
    nothing fits; {w, k} if only one more piece can fit, if it fills the sequence, or if at most
    two more can fit and no two together exceed k. In each of these cases, whatever shares a
    sequence with w in a solution can be exchanged for k without using more sequences. Then the
    next shorter length is tried, and all again until nothing changes.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[Bins] = []

    def fix(count: int, *lengths: int) -> None:
        made = Bins(count, capacity)
        for n in dict.fromkeys(lengths):
            made = made.filled(count, n, lengths.count(n), capacity)
            left[n] -= count * lengths.count(n)
            if not left[n]:
                del left[n]
                sizes.pop(bisect_left(sizes, n))
        fixed.append(made)

    changed = True
    while changed:
        changed = False
        sizes = sorted(left)
        for w in sizes[::-1]:
            while w in left:
                spare = capacity - w
                others = [n for n in sizes[:4] for _ in range(min(3, left[n] - (n == w)))][:3]
                if not others or others[0] > spare:
                    fix(left[w], w)
                    changed = True
                    break
                i = bisect_left(sizes, spare + 1) - 1
                while i >= 0 and sizes[i] == w and left[w] < 2:
                    i -= 1
                k = sizes[i]
                two = len(others) > 1 and others[0] + others[1] <= spare
                three = len(others) > 2 and sum(others) <= spare
                if not (k == spare or not two or (not three and _longest_pair(left, sizes, w, spare) <= k)):
                    break
                fix(left[w] // 2 if k == w else min(left[w], left[k]), w, k)
                changed = True
    return fixed, left


def _longest_pair(left: dict[int, int], sizes: list[int], w: int, spare: int) -> int:
    """The largest total of two pieces, other than one of length ``w``, that is at most ``spare``."""
    best, i, j = 0, 0, len(sizes) - 1
    there = lambda n: left[n] - (n == w)
    while i <= j:
        a, b = sizes[i], sizes[j]
        if a + b > spare or not there(b):
            j -= 1
        elif not there(a) or (i == j and there(a) < 2):
            i += 1
        else:
            best = max(best, a + b)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Best fit, decreasing: each piece goes to the fullest sequence that has room for it.

    Equal pieces and equal sequences are handled together. The sequence that took a piece has the
    least room of those that can take one more, so it is filled before the next one is begun.
    """
    by_room: dict[int, list[Bins]] = defaultdict(list)
    rooms: list[int] = []

    def keep(bins: Bins) -> None:
        if bins.count:
            if bins.free not in by_room or not by_room[bins.free]:
                insort(rooms, bins.free)
            by_room[bins.free].append(bins)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                bins = by_room[rooms[i]].pop()
                if not by_room[bins.free]:
                    rooms.pop(i)
            else:
                bins = Bins(-(-todo // (capacity // length)), capacity)
            each = bins.free // length
            whole = min(bins.count, todo // each)
            keep(bins.filled(whole, length, each, capacity))
            todo -= whole * each
            rest = bins.count - whole
            if todo and rest:  # fewer than one sequence takes
                keep(bins.filled(1, length, todo, capacity))
                rest, todo = rest - 1, 0
            keep(Bins(rest, bins.free, bins.content))
    return [b for kept in by_room.values() for b in kept]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, pieces a sequence, first offset) and the number of sequences."""
    fixed, left = dominating(counts, capacity)
    ranks: dict[int, int] = defaultdict(int)
    runs, used = [], 0
    for bins in fixed + best_fit(left, capacity):
        for length, each, offset in bins.content:
            runs.append((length, ranks[length], used, each, offset))
            ranks[length] += bins.count * each
        used += bins.count
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), used


def pieces(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           remembered: int = REMEMBERED) -> DataFrame:
    """Token pieces of each document: its ids, then the end-of-text id, cut where longer than ``capacity``.

    A worker remembers the ids of about ``remembered`` runs of text; fewer take less memory and more time.
    """
    bounded(df.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end, size = loaded(path), struct.pack("<I", END_OF_TEXT), 4 * capacity
        coder.remembered = remembered
        try:
            for batch in batches:
                rows, keys = [], iter(batch["doc_id"].astype("Int64").array)
                for run in runs(batch["text"].tolist(), TOGETHER):
                    for ids, key in zip(coder.encode_all(run), keys, strict=False):  # ids first: a run takes its own keys only
                        ids += end
                        rows += [(key, at // size, at // 4, len(part := ids[at:at + size]) // 4, zlib.crc32(part))
                                 for at in range(0, len(ids), size)]
                made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield made.astype({"doc_id": "Int64"})
        finally:
            coder.forget()  # Spark keeps the worker for what comes next, which has its own memory
            give_back()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text")).mapInPandas(cut, PIECE)


def pack(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
         remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty (one end-of-text token); a null or repeated ``doc_id`` is kept, each
    row being a document of its own; other columns are not carried; an empty table gives no rows.
    Pieces of equal length are dealt in the order of doc_id, piece and content, so the result does
    not depend on partitions. Rows equal in all of these can be exchanged for each other.
    """
    cut = settle(pieces(df, path, text, doc_id, capacity, remembered), "pieces")
    order = ["length", "doc_id", "piece", "start", "ids_crc32"]
    numbered = settle(
        cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "pieces-in-order")
    # A length and slice each: at most ``capacity`` rows more than there are partitions.
    spans = (numbered.groupBy("length", F.shiftright("_at", 33).alias("slice"))
             .agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("length", "slice").toPandas())
    before = (spans.groupby("length")["n"].cumsum() - spans["n"]).to_numpy(np.int64)
    totals = spans.groupby("length")["n"].sum()
    runs, _ = plan({int(k): int(v) for k, v in totals.items()}, capacity)
    firsts = np.sort(spans["first"].to_numpy(np.int64))
    starts = before[np.argsort(spans["first"].to_numpy(np.int64), kind="stable")]
    keys = runs[:, 0] << _RANK_BITS | runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        at, length = at.to_numpy(np.int64), length.to_numpy(np.int64)
        span = np.searchsorted(firsts, at, "right") - 1
        rank = at - firsts[span] + starts[span]
        run = runs[np.searchsorted(keys, length << _RANK_BITS | rank, "right") - 1]
        i = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + i // run[:, 3], "offset": run[:, 4] + i % run[:, 3] * length})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered.withColumn("_to", place("length", "_at")).select(*columns, "_to.*")
