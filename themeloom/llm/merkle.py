"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf of the tree of its language, every eight consecutive nodes become their hash,
and the roots of the languages are the leaves of one more tree. Nodes have labels, (level, place),
in which children come before parents. In *time-forward processing* a node does not look up its
children: they send their digests ahead, into a priority queue ordered by label, and the node
takes what lies there for it when its turn comes.

The queue is external: within a slab of ``FANOUT ** LEVELS`` consecutive nodes of a tree it is a
heap in a task, and between slabs it is Spark's shuffle, which brings the digests of slabs to the
slab of the next sweep. Each sweep settles ``LEVELS`` levels of all trees at once, so a tree of
a billion leaves takes three, and no task holds more than one slab.

The sweep back runs through the labels from the highest to the lowest: each node sends its
children the *proof suffix*, the siblings on the way from them to the root. Slabs get one message
each; leaves hash what reaches them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.checks import crc32_sql
from themeloom.storage import settle, with_position

#: Children of a node, and levels that one sweep settles. A slab has FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 8, 4
#: Every n-th document (by the CRC of its id) is tampered with.
TAMPERED = 3
#: The one tree above those of the languages.
_TOP = "top"

# The letters that tampering makes small.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height(nodes: int, fanout: int = FANOUT) -> int:
    """Levels above ``nodes`` leaves until one node remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def sweep(digests: list[str], levels: int, fanout: int = FANOUT) -> dict[tuple[int, int], list[str]]:
    """The digests that reach each inner node of a slab, by label, up to ``levels`` above ``digests``.

    The last label is the top, whose children are the only ones that a slab of several nodes ends with.
    """
    queue: list[tuple[tuple[int, int], int, str]] = []
    for i, digest in enumerate(digests if levels else ()):
        heappush(queue, ((1, i // fanout), i, digest))
    reached: dict[tuple[int, int], list[str]] = {}
    while queue:
        label = queue[0][0]
        children = reached[label] = []
        while queue and queue[0][0] == label:
            children.append(heappop(queue)[2])
        level, at = label
        if level < levels:
            heappush(queue, ((level + 1, at // fanout), at, _digest("".join(children))))
    return reached


def top_of(reached: dict[tuple[int, int], list[str]], digests: list[str], levels: int) -> str:
    """The digest that a slab hands on: that of its only node ``levels`` above ``digests``."""
    return _digest("".join(reached[levels, 0])) if levels else digests[0]


#: A proof suffix: what stands left and right of a node among its siblings, and the suffix of its parent.
Suffix = tuple[str, str, "Suffix"] | None


def sweep_back(reached: dict[tuple[int, int], list[str]], count: int, levels: int, above: Suffix, fanout: int = FANOUT) -> list[Suffix]:
    """The proof suffix of each of ``count`` nodes of a slab whose top has the suffix ``above``."""
    if not levels:
        return [above] * count
    queue: list[tuple[tuple[int, int], int, Suffix]] = []
    heappush(queue, ((-levels, 0), 0, above))
    out: list[Suffix] = [None] * count
    while queue:
        (level, at), _, suffix = heappop(queue)
        level, at = -level, -at
        children = reached[level, at]
        for i in range(len(children)):
            own = ("".join(children[:i]), "".join(children[i + 1:]), suffix)
            place = at * fanout + i
            if level == 1:
                out[place] = own
            else:
                heappush(queue, ((1 - level, -place), 0, own))
    return out


def links(suffix: Suffix) -> Iterator[tuple[str, str]]:
    while suffix is not None:
        left, right, suffix = suffix
        yield left, right


def written(suffix: Suffix) -> str:
    return ",".join(f"{left}:{right}" for left, right in links(suffix))


def read(text: str) -> Suffix:
    suffix: Suffix = None
    for link in reversed(text.split(",") if text else []):
        suffix = (*link.split(":"), suffix)
    return suffix


def proof(suffix: Suffix) -> str:
    """Hash of all siblings, level by level, left to right."""
    return _digest("".join(left + right for left, right in links(suffix)))


def folded(digest: str, suffix: Suffix) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in links(suffix):
        digest = _digest(left + digest + right)
    return digest


def _of_slab(n: int, levels: int, fanout: int) -> int:
    """Levels that a slab of a tree with ``n`` nodes is raised by."""
    return min(levels, height(n, fanout))


def raised(nodes: DataFrame, most: int, levels: int = LEVELS, fanout: int = FANOUT) -> list[DataFrame]:
    """``nodes`` (tree, n, index, digest) and what each sweep makes of the one before; the last has one row per tree.

    ``n`` is the number of nodes of the tree, ``most`` the largest of them.
    """
    slab = fanout ** levels

    def up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("index")
        n, digests = int(group["n"].iloc[0]), group["digest"].tolist()
        rise = _of_slab(n, levels, fanout)
        return pd.DataFrame([(group["tree"].iloc[0], -(-n // slab), int(group["index"].iloc[0]) // slab,
                              top_of(sweep(digests, rise, fanout), digests, rise))], columns=["tree", "n", "index", "digest"])

    steps = [nodes]
    while most > 1:
        nodes = _slabs(steps[-1].select("tree", "n", "index", "digest"), slab)
        steps.append(settle(nodes.applyInPandas(up, "tree string, n long, index long, digest string"), "merkle-nodes"))
        most = -(-most // slab)
    return steps


def _slabs(step: DataFrame, slab: int):
    return step.withColumn("_slab", F.expr(f"index div {slab}")).groupBy("tree", "_slab")


#: What the sweep back sends to a slab: the suffix of its top, and the two roots.
MESSAGE = "tree string, index long, suffix string, subroot string, root string"


def lowered(step: DataFrame, above: DataFrame, make: Callable[[pd.DataFrame, list[Suffix], str, str], pd.DataFrame], kind: str,
            levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """What ``make`` returns of each slab of ``step``, the proof suffixes of its nodes, and the two roots, given the messages ``above``."""
    def down(group: pd.DataFrame, message: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("index")
        rise = _of_slab(int(group["n"].iloc[0]), levels, fanout)
        reached = sweep(group["digest"].tolist(), rise, fanout)
        found = sweep_back(reached, len(group), rise, read(message["suffix"].iloc[0]), fanout)
        return make(group, found, message["subroot"].iloc[0], message["root"].iloc[0])

    return _slabs(step, fanout ** levels).cogroup(above.groupBy("tree", "index")).applyInPandas(down, kind)


def _onward(group: pd.DataFrame, suffixes: list[Suffix], subroot: str, root: str) -> pd.DataFrame:
    """The messages to the slabs that the nodes of this one stand for."""
    return pd.DataFrame({"tree": group["tree"], "index": group["index"], "suffix": list(map(written, suffixes)), "subroot": subroot, "root": root})


def _to_trees(group: pd.DataFrame, suffixes: list[Suffix], subroot: str, root: str) -> pd.DataFrame:
    """The messages from the leaves of the topmost tree to the trees of languages."""
    return pd.DataFrame({"tree": group["of"], "index": 0, "suffix": list(map(written, suffixes)), "subroot": group["digest"], "root": root})


#: A row of the manifest; ``doc_id`` is text, so that no null makes floats of the ids of a slab.
ROW = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _to_rows(group: pd.DataFrame, suffixes: list[Suffix], subroot: str, root: str) -> pd.DataFrame:
    changed = group["tampered"].where(group["tampered"].notna(), group["digest"])
    return pd.DataFrame({
        "doc_id": group["doc_id"], "leaf": group["digest"], "subroot": subroot, "root": root, "proof_sha256": list(map(proof, suffixes)),
        "folded_root": list(map(folded, changed, suffixes))})


def field(column: Column) -> Column:
    """A value as part of a leaf: ``-`` for null, else its bytes in UTF-8, counted, and a colon between."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def small_letters(text: str) -> Column:
    """The text with A-Z lower-cased; text of ASCII alone takes the faster function, which does the same to it."""
    c = F.col(text)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _CAPITALS, _CAPITALS.lower()))


def leaves(df: DataFrame) -> DataFrame:
    """doc_id, tree, leaf, and the leaf of the tampered row where there is one."""
    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf(F.col("text")).alias("leaf"),
        F.when(tampered, leaf(small_letters("text"))).alias("tampered"))


def manifest(df: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a language ascend by ``doc_id``, null first, equal ids by leaf; rows equal in all columns
    have equal leaves at places of their own. Documents without a language have a tree of their own,
    the first. Texts are read once and never shuffled; columns other than doc_id, source, lang,
    n_chars and text count for nothing. The only document, or the only one of its language, is its own
    subroot; a proof without siblings is the hash of the empty text. An empty table gives no rows.
    """
    made = settle(leaves(df), "merkle-leaves")
    # One row per language.
    sizes = settle(made.groupBy(F.col("tree").alias("_tree")).agg(F.count("*").alias("n")), "merkle-trees")
    most, trees = sizes.agg(F.max("n"), F.count("*")).first()
    placed = settle(
        with_position(made, ["tree"], ["doc_id", "leaf"], "index").join(sizes, F.col("tree") == F.col("_tree"))
        .select("tree", "n", "index", F.col("leaf").alias("digest"), F.col("doc_id").cast("string").alias("doc_id"), "tampered"), "merkle-places")
    steps = raised(placed, most or 0, levels, fanout)
    top = settle(with_position(steps[-1].select("tree", "digest"), [], ["tree"], "index").select(
        F.lit(_TOP).alias("tree"), F.lit(trees).cast("long").alias("n"), "index", "digest", F.col("tree").alias("of")), "merkle-top")
    tops = raised(top, trees, levels, fanout)
    above = tops[-1].select("tree", "index", F.lit("").alias("suffix"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for step in tops[-2:0:-1]:
        above = settle(lowered(step, above, _onward, MESSAGE, levels, fanout), "merkle-suffixes")
    above = settle(lowered(top, above, _to_trees, MESSAGE, levels, fanout), "merkle-suffixes")
    for step in steps[-2:0:-1]:
        above = settle(lowered(step, above, _onward, MESSAGE, levels, fanout), "merkle-suffixes")
    rows = lowered(placed, above, _to_rows, ROW, levels, fanout)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8, above: int = 3) -> str:
    """DuckDB SQL of the manifest, one step per level: up to 8^levels documents a language and 8^above languages."""
    def raise_all(name: str, n: int) -> list[str]:
        return [f"""{name}{k} AS (
            SELECT tree, pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
                   (any_value(n) + 7) // 8 AS n, any_value(n) = 1 AS over
            FROM {name}{k - 1} GROUP BY tree, pos // 8)""" for k in range(1, n + 1)]

    def fold(name: str, n: int, start: str) -> list[str]:
        """Siblings of each document pos each level, and what its own hash folds to."""
        return [f"""{start}{name}{k} AS (
            SELECT p.doc, p.tree, p.pos // 8 AS pos,
                   CASE WHEN any_value(m.n) > 1 THEN sha256(coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < p.pos), '') || any_value(p.f)
                        || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > p.pos), '')) ELSE any_value(p.f) END AS f,
                   any_value(p.proof) || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos <> p.pos), '') AS proof
            FROM {start}{name}{k - 1} p JOIN {name}{k - 1} m ON m.tree = p.tree AND m.pos = p.pos
            JOIN {name}{k - 1} s ON s.tree = p.tree AND s.pos // 8 = p.pos // 8 GROUP BY p.doc, p.tree, p.pos)""" for k in range(1, n + 1)]

    def part(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"

    small = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    head = " || ".join(map(part, ("doc_id", "source", "lang", "n_chars")))
    steps = [
        f"""leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {part('text')}) AS leaf,
                   CASE WHEN coalesce({crc32_sql('doc_id')} % 3 = 0, false)
                        THEN sha256({head} || {part(small)}) ELSE sha256({head} || {part('text')}) END AS f
            FROM documents)""",
        """placed AS (
            SELECT row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS doc, doc_id, tree, leaf, f,
                   row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY tree) AS n FROM leaves)""",
        "a0 AS (SELECT tree, pos, leaf AS h, n FROM placed)", *raise_all("a", levels),
        f"""b0 AS (SELECT 'top' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n, tree AS lang FROM a{levels})""",
        *raise_all("b", above),
        "fa0 AS (SELECT doc, tree, pos, f, '' AS proof FROM placed)", *fold("a", levels, "f"),
        f"fb0 AS (SELECT p.doc, 'top' AS tree, b0.pos, p.f, p.proof FROM fa{levels} p JOIN b0 ON b0.lang = p.tree)", *fold("b", above, "f"),
    ]
    return f"""WITH {", ".join(steps)}
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(z.proof) AS proof_sha256, z.f AS folded_root, z.f = r.h AS verified
FROM placed p JOIN b0 s ON s.lang = p.tree JOIN fb{above} z ON z.doc = p.doc JOIN b{above} r ON r.tree = 'top'"""
