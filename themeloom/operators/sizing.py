"""What tagging a selection would take: bytes, tokens, batches, cost and a verdict."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.numbers import round_half_up
from themeloom.model import BatchLimits, CostModel, RunCeiling, Sizing
from themeloom.operators.labels import SCOPE
from themeloom.operators.scopes import in_scopes, selection_order
from themeloom.storage import settle, with_position

SIZED = ("rows", "text_bytes")


def text_sizes(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Rows and UTF-8 text bytes per scope, summed per product first."""
    per_product = reviews.groupBy("product_id").agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("text_bytes"))
    return in_scopes(per_product, products).groupBy(*SCOPE).agg(*[F.sum(c).alias(c) for c in SIZED])


def output_tokens(rows: Column, text_bytes: Column, cost: CostModel) -> Column:
    return round_half_up(rows * cost.output_tokens_per_row + text_bytes * cost.output_tokens_per_byte)


def row_density(sizes: DataFrame, cost: CostModel = CostModel()) -> DataFrame:
    """Estimated output tokens per scope and per row; zero for an empty scope."""
    tokens = output_tokens(F.col("rows"), F.col("text_bytes"), cost)
    return sizes.withColumn("output_tokens", tokens).withColumn(
        "tokens_per_row",
        F.when(F.col("rows") > 0, F.col("output_tokens") / F.col("rows")).otherwise(F.lit(0.0)))


#: Positions that one pass of filling covers, and slices that are composed at once; batches depend on neither.
SLICE_ROWS, FAN = 10_000, 64
_KEY = [*SCOPE, "slice"]


def _whole_slices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Runs of whole slices of frames sorted by slice, and where each begins and ends."""
    held = None
    for frame in chain(frames, [None]):
        if frame is not None:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if held is None or not len(held):
            continue
        new = np.zeros(len(held), bool)
        for c in _KEY:
            v = held[c]
            new[1:] |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy()[1:]
        starts = np.flatnonzero(new | (np.arange(len(held)) == 0))
        upto = len(held) if frame is None else int(starts[-1])
        if upto:
            starts = starts[starts < upto]
            yield held.iloc[:upto], starts, np.append(starts[1:], upto)
            held = held.iloc[upto:].reset_index(drop=True)


def _batch_ends(sizes: np.ndarray, ends: np.ndarray, limits: BatchLimits) -> np.ndarray:
    """Where a batch that begins at each row ends, at the latest at ``ends``; the first row is taken however large it is."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    by_size = np.searchsorted(total, total[:-1] + limits.max_bytes, "right") - 1
    return np.maximum(np.minimum(np.minimum(by_size, at + limits.max_rows), ends), at + 1)


def _composed(ways: DataFrame, most: int) -> DataFrame:
    """The ways of ``FAN`` consecutive slices as an ordered list, and what they are one after the other."""
    nothing = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.struct(e.alias("leaves"), F.lit(0).cast("long").alias("batches")))
    grouped = ways.groupBy(*SCOPE, F.expr(f"slice div {FAN}").alias("group")).agg(
        F.array_sort(F.collect_list(F.struct("slice", "way"))).alias("ways"))

    def after(done: Column, one: Column) -> Column:
        return F.transform(done, lambda x: F.struct(
            F.get(one["way"], x["leaves"])["leaves"].alias("leaves"), (x["batches"] + F.get(one["way"], x["leaves"])["batches"]).alias("batches")))

    return grouped.select(*SCOPE, F.col("group").alias("slice"), "ways", F.aggregate("ways", nothing, after).alias("way"))


def _entered(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Where each slice of a group is entered, and the batches before it, given that of the group."""
    known = entries.select(*[F.col(c).alias(f"_{c}") for c in _KEY], "entry", "before")
    kind = "struct<entry:int,before:bigint,done:array<struct<slice:bigint,entry:int,before:bigint>>>"
    begin = F.struct("entry", "before", F.array().cast("array<struct<slice:bigint,entry:int,before:bigint>>").alias("done")).cast(kind)

    def onward(s: Column, one: Column) -> Column:
        way = F.get(one["way"], s["entry"])
        return F.struct(way["leaves"].alias("entry"), (s["before"] + way["batches"]).alias("before"), F.concat(
            s["done"], F.array(F.struct(one["slice"].alias("slice"), s["entry"].alias("entry"), s["before"].alias("before")))).alias("done"))

    return groups.select(*_KEY, "ways").join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _KEY]).select(
        *SCOPE, F.explode(F.aggregate("ways", begin, onward, lambda s: s["done"])).alias("_s")).select(*SCOPE, "_s.*")


def bounded_batches(
    selection: DataFrame, limits: BatchLimits = BatchLimits(), slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Batches in selection order within the row and byte limits.

    ``selection`` has (scope, review_date, row_pos, review_id, text_bytes), no text.
    A row larger than a whole batch goes alone and is flagged. Where a batch begins
    depends on all rows before it, but a slice of positions can be entered at one of
    ``max_rows`` places only: it is a function from its entry to that of the next slice and
    a number of batches. All slices are filled from all entries in parallel; functions of
    ``FAN`` slices are composed into one, and these again, in a tree, which then hands the true
    entries down; and every slice is filled from its own. No task sees more of a scope than that.
    """
    rows = max(slice_rows, limits.max_rows)
    placed = settle(with_position(selection, SCOPE, selection_order(), "sel_pos").select(
        *SCOPE, F.floor(F.col("sel_pos") / rows).alias("slice"), "sel_pos", "review_id", "text_bytes"), "placed")
    # The last batch of a slice may need the first rows of the next one.
    ahead = placed.filter((F.col("slice") > 0) & (F.col("sel_pos") % rows < limits.max_rows)).withColumn("slice", F.col("slice") - 1)
    in_order = lambda df: df.repartition(*_KEY).sortWithinPartitions(*_KEY, "sel_pos")
    most = limits.max_rows

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts, stops in _whole_slices(frames):
            number, at_row = part["slice"].to_numpy()[starts], part["sel_pos"].to_numpy()
            own = np.add.reduceat(at_row < (np.repeat(number, stops - starts) + 1) * rows, starts)
            ends = _batch_ends(part["text_bytes"].to_numpy(), np.repeat(stops, stops - starts), limits)
            entry = np.arange(most)[None, :]
            possible = (entry <= own[:, None]) & ((entry == 0) | (number > 0)[:, None])
            stop = np.where(possible, (starts + own)[:, None], -1)
            at, batches = starts[:, None] + entry, np.zeros(possible.shape, np.int64)
            while (going := at < stop).any():
                at[going] = ends[at[going]]
                batches += going
            leaves = at - (starts + own)[:, None]
            keys = part.iloc[starts]
            yield pd.DataFrame({
                **{c: keys[c].to_numpy() for c in _KEY},
                "leaves": [x[p].tolist() for x, p in zip(leaves, possible, strict=True)],
                "batches": [x[p].tolist() for x, p in zip(batches, possible, strict=True)]})

    found = in_order(placed.unionByName(ahead)).mapInPandas(
        enter, "scope_kind string, scope_key string, slice long, leaves array<int>, batches array<long>")
    ways = settle(found.select(*_KEY, F.arrays_zip("leaves", "batches").alias("way")), "slice-ways")
    groups, last = [], ways.agg(F.max("slice")).first()[0] or 0
    while last > 0:
        groups.append(settle(_composed(groups[-1] if groups else ways, most), "composed-ways"))
        last //= FAN
    top = (groups[-1] if groups else ways).select(*_KEY)
    entered = top.select(*_KEY, F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))
    for group in reversed(groups):
        entered = settle(_entered(group, entered), "slice-entries")
    keyed = entered.select(*[F.col(c).alias(f"_{c}") for c in _KEY], "entry", "before")
    known = placed.join(keyed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _KEY]).drop(*[f"_{c}" for c in _KEY])

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts, stops in _whole_slices(frames):
            sizes = part["text_bytes"].to_numpy()
            ends = _batch_ends(sizes, np.repeat(stops, stops - starts), limits)
            begins, at = np.zeros(len(part), np.int64), starts + part["entry"].to_numpy()[starts]
            while (going := at < stops).any():
                begins[at[going]] = 1
                at[going] = ends[at[going]]
            upto = np.cumsum(begins)
            in_slice = upto - np.repeat(upto[starts] - begins[starts], stops - starts)
            yield part[[*SCOPE, "sel_pos", "review_id", "text_bytes"]].assign(
                batch_no=part["before"].to_numpy() + in_slice - 1, oversized=sizes > limits.max_bytes)

    return in_order(known).mapInPandas(
        fill, "scope_kind string, scope_key string, sel_pos long, review_id string, text_bytes long, batch_no long, oversized boolean")


def batch_counts(batches: DataFrame) -> DataFrame:
    return batches.groupBy(*SCOPE).agg((F.max("batch_no") + 1).alias("filled_batches"))


def _ceil(value: Column) -> Column:
    return F.ceil(value).cast("long")


def run_estimates(sizes: DataFrame, filled: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    """Cost ceiling and verdict per scope.

    Reconciling is priced level by level, down to the deepest one allowed, each level
    as columns of its own.
    """
    cost, ceiling, most = sizing.cost, sizing.ceiling, sizing.labels.max_labels
    zero = F.lit(0).cast("long")
    out = row_density(sizes.join(filled, SCOPE, "left"), cost).withColumn(
        "filled_batches", F.coalesce("filled_batches", zero))
    out = out.withColumn("batches", F.when(F.col("rows") == 0, zero).otherwise(F.greatest(
        _ceil(F.col("rows") / cost.careful_rows_per_batch), F.col("filled_batches"))))
    out = out.withColumn("labels_0", F.when(F.col("output_tokens") > 0, _ceil(
        F.col("output_tokens") / cost.output_tokens_per_tag * cost.distinct_label_ratio)).otherwise(zero))
    depth = sizing.labels.max_levels
    for level in range(depth):
        labels = F.col(f"labels_{level}")
        out = out.withColumn(f"requests_{level}", _ceil(labels / most))
        left = _ceil(labels * cost.surviving_label_ratio)
        goes_on = (F.col(f"requests_{level}") > 1) & (left < labels)
        out = out.withColumn(f"labels_{level + 1}", F.when(goes_on, left).otherwise(zero))
    total = lambda name: sum((F.col(f"{name}_{i}") for i in range(1, depth)), F.col(f"{name}_0"))
    stuck = (F.col("labels_0") > 0) & ~_any_single(depth)
    label_input = total("labels") * cost.input_tokens_per_label + total("requests") * cost.prompt_tokens
    label_output = total("labels") * cost.output_tokens_per_label
    price = lambda i, o: i / 1e6 * cost.input_usd + o / 1e6 * cost.output_usd
    tag_input = F.col("text_bytes") * cost.input_tokens_per_byte + F.col("batches") * cost.prompt_tokens
    priced = out.withColumns({
        "label_requests": total("requests"),
        "labels_fit": ~stuck,
        "tagging_usd": price(tag_input, F.col("output_tokens")),
        "label_usd": price(label_input, label_output),
    })
    priced = priced.withColumn("retry_usd", F.col("tagging_usd") * cost.retry_share)
    priced = priced.withColumn("total_usd", F.col("tagging_usd") + F.col("label_usd") + F.col("retry_usd"))
    return priced.withColumn("decision", decision(ceiling)).select(
        *SCOPE, *SIZED, "output_tokens", "tokens_per_row", "batches",
        F.col("labels_0").alias("labels"), "label_requests", "labels_fit",
        "tagging_usd", "label_usd", "retry_usd", "total_usd", "decision")


def _any_single(depth: int) -> Column:
    """Whether some level fits one request."""
    single = F.col("requests_0") == 1
    for level in range(1, depth):
        single = single | (F.col(f"requests_{level}") == 1)
    return single


def decision(ceiling: RunCeiling) -> Column:
    """What may happen to a run, first reason first."""
    return (
        F.when(F.col("rows") == 0, "empty")
        .when(F.col("rows") > ceiling.max_rows, "refuse_rows")
        .when(~F.col("labels_fit"), "refuse_labels")
        .when(F.col("total_usd") > ceiling.confirm_above_usd, "confirm")
        .otherwise("go")
    )
