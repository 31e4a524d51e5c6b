"""Trie of conversation prefixes by van Emde Boas recursion.

Conversations are sequences of turns. A forest of height 2h is built by cutting its sequences at
depth h: the cut prefixes are *named*, which gives the leaves of the upper forest, and the names
are the roots of the lower forests, which are built at the same time; both have height h and are
cut in turn. All pieces of one height are one step, so there are as many steps as the longest
conversation has binary digits, each a constant number of shuffles, where a walk along the turns
would take one for each turn.

A prefix is named by its smallest member. Which prefixes are equal is told by the name of the
piece's root and a digest of the half between, 128 bits that are doubled bottom-up before the
recursion starts: the digest of 2h turns is made of those of its halves.

Totals of subtrees are *grafted* on the way back: a piece of height 2h adds to each node of its
upper half the totals of the lower roots below it, which are reached along the turns of the
conversation that names them. Each step adds at most one number per conversation and upper
turn, and sums are combined before they are shuffled.

Turns are 128-bit digests of role and text from the first step on; no text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import bounded, filled
from themeloom.llm.checks import crc32_sql
from themeloom.storage import settle, with_position

#: Conversations that may share the turns of one, the first of them; and below how many turns they do.
FAMILY, SHARED = 20, 4
#: Ids that are put together before they are hashed in order.
IDS = 1024

# A word, and the digest of the empty text.
_WORD = r"[^\x20\x09-\x0D]+"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, words and the digest (d1, d2) of each turn; null role and text are empty.

    The digest is that of the SHA-256 of role and text, with the length of the role before them.
    """
    role, text = filled("role"), filled("text")
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sha.alias("_sha"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", "words", *_both(F.col("_sha")))


def _both(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), *parts).alias(f"d{k}") for k in (1, 2)]


def shared_turns(conv_id: str) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, at, words, d1, d2) of the rebuilt conversations, and (conv_id, size) of all of them.

    Turns are in the order of ``turn``, null first, equal ones by digest. A family is so many
    conversations at most that a donor's first turns are read by a bounded number of rows.
    """
    placed = settle(with_position(turns(df), ["conv_id"], ["turn", "d1", "d2"], "_at"), "trie-turns")
    sizes = settle(placed.groupBy("conv_id").agg(F.count("*").alias("_own")), "trie-sizes")
    donors = sizes.select(F.col("conv_id").alias("_donor"), F.col("_own").alias("_there"))
    plan = (sizes.withColumn("_h", shared_turns("conv_id")).withColumn("_from", F.expr(f"conv_id - conv_id % {FAMILY}"))
            .join(donors, F.col("_from") == F.col("_donor"), "left")
            .withColumn("_taken", F.least("_h", F.coalesce("_there", F.lit(0)))))
    plan = settle(plan.select("conv_id", "_own", "_h", "_from", "_taken"), "trie-plan")
    turn = ["words", "d1", "d2"]
    first = placed.filter(F.col("_at") < SHARED).select(F.col("conv_id").alias("_donor"), F.col("_at").cast("long").alias("at"), *turn)
    taken = first.join(plan.filter("_taken > 0"), (F.col("_from") == F.col("_donor")) & (F.col("at") < F.col("_taken")))
    moved = plan.select(F.col("conv_id").alias("_c"), "_h", "_taken")
    own = (placed.join(moved, F.col("conv_id") == F.col("_c")).filter(F.col("_at") >= F.col("_h"))
           .withColumn("at", F.col("_at") - F.col("_h") + F.col("_taken")))
    rows = taken.select("conv_id", "at", *turn).unionByName(own.select("conv_id", "at", *turn))
    size = F.col("_taken") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))
    return settle(rows, "trie-rebuilt"), settle(plan.select("conv_id", size.cast("long").alias("size")), "trie-ends")


def blocks(rows: DataFrame, levels: int) -> list[DataFrame]:
    """For each j, the digests of the whole blocks of 2^j turns: (conv_id, at) with ``at`` the number of the block."""
    steps = [rows.select("conv_id", "at", "d1", "d2")]
    for _ in range(levels):
        right = F.col("at") % 2 == 1
        halves = [F.max(F.when(right, F.col(d)) if side else F.when(~right, F.col(d))).alias(f"_{d}{side}") for d in ("d1", "d2") for side in (0, 1)]
        pair = steps[-1].groupBy("conv_id", F.shiftright("at", 1).alias("_at")).agg(F.count("*").alias("_n"), *halves).filter("_n = 2")
        steps.append(settle(pair.select("conv_id", F.col("_at").alias("at"), *_both(*[F.col(f"_{d}{s}") for s in (0, 1) for d in ("d1", "d2")])), "trie-blocks"))
    return steps


def named(rows: DataFrame, ends: DataFrame, least: int | None, levels: int) -> DataFrame:
    """(conv_id, depth, name) of each prefix of each conversation, the empty one too; the name is its smallest member.

    ``least`` is the smallest conversation, which names the root. Pieces of height 2^(j+1) stand at the multiples of it; their cut prefixes end 2^j below.
    """
    digests = blocks(rows, max(levels - 1, 0))
    root = F.lit(least).cast("long")
    steps = [ends.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("name"))]
    for j in range(levels - 1, -1, -1):
        # The depths of roots of this height are even multiples of 2^j, and those of their cuts the odd ones.
        half = digests[j].filter("at % 2 = 0").select(F.col("conv_id").alias("_c"), F.shiftleft("at", j).alias("_root"), "d1", "d2")
        roots = _union(steps).filter(F.col("depth") % (2 << j) == 0)
        cut = settle(roots.join(half, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_root")))
                     .select("conv_id", "depth", F.col("name").alias("root"), "d1", "d2"), "trie-cuts")
        same = ["depth", "root", "d1", "d2"]
        first = cut.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.min("conv_id").alias("name"))
        match = F.lit(True)
        for c in same:
            match = match & (F.col(c) == F.col(f"_{c}"))
        steps.append(settle(cut.join(settle(first, "trie-first"), match)
                            .select("conv_id", (F.col("depth") + (1 << j)).alias("depth"), "name"), "trie-names"))
    return _union(steps)


def _union(steps: list[DataFrame]) -> DataFrame:
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out


def grafted(own: DataFrame, names: DataFrame, levels: int, totals: list[str]) -> DataFrame:
    """Sums of ``totals`` over the subtree of each node of ``own`` (name, depth, and what each adds itself)."""
    now = own
    for j in range(levels):
        # A piece of height 2^(j+1) has its upper half where bit j of the depth is unset; lower roots stand 2^j below its root.
        lower = now.filter(F.col("depth") % (2 << j) == (1 << j)).select(
            F.col("name").alias("_by"), F.shiftright("depth", j + 1).alias("_piece"), *totals)
        above = names.filter(F.shiftright("depth", j) % 2 == 0).withColumn("_of", F.shiftright("depth", j + 1))
        added = above.join(lower, (F.col("conv_id") == F.col("_by")) & (F.col("_of") == F.col("_piece"))).select("name", "depth", *totals)
        now = settle(now.select("name", "depth", *totals).unionByName(added)
                     .groupBy("name", "depth").agg(*[F.sum(t).alias(t) for t in totals]), "trie-totals")
    return now


def ordered_digests(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """SHA-256 of the values of each key, ascending, comma-joined, as ``name``.

    A hash over many ids can only be made one after the other. So that the one task which does it for
    a large key has little to do, tasks of a range partitioning put ids together first, ``IDS`` at
    a time; both steps stream over sorted rows and hold one such part.
    """
    bounded(df.sparkSession)
    order = [*keys, value]
    kinds = ", ".join(f"{k} long" for k in keys)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids = None, []
        for batch in batches:
            out = []
            for *k, v in zip(*[batch[c].tolist() for c in order], strict=True):
                if ids and (k != key or len(ids) >= IDS):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(v)
            yield pd.DataFrame(out, columns=[*keys, "_first", "_part"])
        if ids:
            yield pd.DataFrame([(*key, ids[0], ",".join(map(str, ids)))], columns=[*keys, "_first", "_part"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for batch in batches:
            out = []
            for *k, part in zip(*[batch[c].tolist() for c in (*keys, "_part")], strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(part.encode("ascii"))
            yield pd.DataFrame(out, columns=[*keys, name])
        if state is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*keys, name])

    parts = (df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
             .mapInPandas(joined, f"{kinds}, _first long, _part string"))
    return (parts.repartition(*keys).sortWithinPartitions(*keys, "_first")
            .mapInPandas(hashed, f"{kinds}, {name} string"))


def trie(df: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` are rebuilt first, see ``rebuilt``; one whose rebuilt form has no turns ends at the
    root. Rows without ``conv_id`` belong to no conversation and are left out; repeated rows are turns
    of their own; other columns count for nothing; an empty table gives no rows.
    """
    rows, ends = rebuilt(df)
    deepest, least = ends.agg(F.max("size"), F.min("conv_id")).first()
    levels = (deepest or 0).bit_length()
    names = settle(named(rows, ends, least, levels), "trie-prefixes")
    members = names.groupBy("name", "depth").agg(F.count("*").alias("n_convs"))
    # A node's smallest member tells its last turn and its parent.
    own = names.filter("conv_id = name").select(F.col("name").alias("_n"), F.col("depth").alias("_d"))
    last = rows.select(F.col("conv_id").alias("_n"), (F.col("at") + 1).alias("_d"), "words")
    upper = names.select(F.col("conv_id").alias("_n"), (F.col("depth") + 1).alias("_d"), F.col("name").alias("parent_conv_id"))
    nodes = settle(
        own.join(last, ["_n", "_d"], "left").join(upper, ["_n", "_d"], "left")
        .join(members, (F.col("_n") == F.col("name")) & (F.col("_d") == F.col("depth")))
        .select("name", "depth", "parent_conv_id", "n_convs", F.coalesce("words", F.lit(0)).alias("words")), "trie-nodes")
    children = (nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("_p"), (F.col("depth") - 1).alias("_d"))
                .agg(F.count("*").alias("n_children")))
    nodes = settle(
        nodes.join(children, (F.col("name") == F.col("_p")) & (F.col("depth") == F.col("_d")), "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("_p", "_d"), "trie-nodes")
    each = nodes.select("name", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = grafted(each, names, levels, ["n_leaves", "saved_tokens"])
    ending = names.join(ends.select(F.col("conv_id").alias("_c"), "size"), (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("size")))
    digests = settle(ordered_digests(ending.select("name", "depth", "conv_id"), ["name", "depth"], "conv_id", "ends_sha256"), "trie-digests")
    return (nodes.join(totals, ["name", "depth"]).join(digests, ["name", "depth"], "left").select(
        F.col("name").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))


ORACLE = rf"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
    SELECT conv_id, count(*) AS n, {crc32_sql('conv_id')} % 4 AS h, conv_id - conv_id % 20 AS d FROM own GROUP BY conv_id),
rebuilt AS (
    SELECT s.conv_id, o.pos, r, t FROM sizes s JOIN own o ON o.conv_id = s.d AND o.pos < s.h
    UNION ALL
    SELECT s.conv_id, o.pos - s.h + least(s.h, coalesce(x.n, 0)), r, t
    FROM sizes s JOIN own o ON o.conv_id = s.conv_id AND o.pos >= s.h LEFT JOIN sizes x ON x.conv_id = s.d),
prefixes AS (
    SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM sizes
    UNION ALL
    SELECT conv_id, pos + 1, string_agg(sha256(length(r) || ':' || r || t), '') OVER (PARTITION BY conv_id ORDER BY pos),
           len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) FROM rebuilt),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM prefixes),
nodes AS (
    SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM ended GROUP BY depth, key),
parents AS (
    SELECT n.*, p.key AS above, q.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
    LEFT JOIN nodes q ON q.depth = p.depth AND q.key = p.key),
children AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT p.*, coalesce(c.n_children, 0) AS n_children FROM parents p LEFT JOIN children c ON c.depth = p.depth AND c.key = p.key),
totals AS (
    SELECT p.depth, p.key, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved_tokens
    FROM whole w JOIN prefixes p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.depth, p.key)
SELECT w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, t.n_leaves::BIGINT AS n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN totals t ON t.depth = w.depth AND t.key = w.key
"""
