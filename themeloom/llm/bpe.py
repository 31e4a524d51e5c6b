"""BPE encoding and decoding by tree concatenation.

A tokenizer file states a vocabulary and ranked merges; this module applies them. Texts are cut
into words by the file's own pattern. A word of many symbols is *unsplit text*: its halves are
encoded on their own, down to leaves of ``LEAF`` symbols, and joined pairwise up the tree. At a
join, a window around it is encoded anew and grown until its outer tokens are those that both
sides have there already. A token sequence is the encoding of its text exactly if each adjacent
pair is the encoding of that pair's text; the window's inner pairs hold because it was encoded,
the outer ones because they were there before, so the joined sequence is exact.

Texts longer than ``SEGMENT`` code points are cut at white space, which no word crosses; the
segments are encoded in parallel tasks and concatenated in order. A segment that is still long holds
a run without white space: it is cut between words, and a word of more than ``SEGMENT`` symbols
anywhere. Its parts are encoded in parallel tasks, too, and joined by windows in a tree of shuffles,
``FAN`` neighbours in each task, pair by pair.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import bounded, filled

#: Symbols that are encoded at once; longer words are halved.
LEAF = 256
#: Code points of a text that one task encodes; longer texts are cut at white space.
SEGMENT = 32_768
#: Parts of one word that a task joins before its result meets those of other tasks.
FAN = 256
#: Words and runs between white space that a worker remembers before it starts anew.
WORD_CACHE, RUN_CACHE = 600_000, 200_000

# White space of Unicode, the word pattern and the word end of the tokenizer file.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"

#: Characters that Python's split() takes for white space and Unicode does not.
_ODD = regex.compile("[\x1c-\x1f]")
_GAPS = regex.compile(f"[{WHITE}]+")
_NONE = 1 << 30


def byte_letters() -> dict[int, str]:
    """Printable letter for each byte: itself where it is visible, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class _Remembered(dict):
    """A dictionary that makes missing values, and forgets all when it holds too many."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Bpe:
    """Encoder and decoder of a tokenizer file with word ends (lower case, NFC, white space dropped)."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        self.leaf = leaf
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = {vocab[letters[b]]: vocab[letters[b] + WORD_END] for b in range(256)}
        self.merged, self.ranks = [], {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            a, b, both = vocab[a], vocab[b], vocab[a + b]
            self.ranks[a << 16 | b] = rank
            self.merged.append(both)
            self.parts.setdefault(both, (a, b))
        self.words = regex.compile(WORDS)
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.specials = regex.compile(f"({'|'.join(names)})") if names else None
        self.word_ids = _Remembered(self._word, WORD_CACHE)
        self.chunk_ids = _Remembered(self._chunk, RUN_CACHE)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges to ``symbols`` in place, lowest rank first, leftmost first among equals."""
        get = self.ranks.get
        ranks = [get(a << 16 | b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == _NONE:
                break
            i = ranks.index(rank)
            both = symbols[i] = self.merged[rank]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(both << 16 | symbols[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(symbols[i - 1] << 16 | both, _NONE)
        return symbols

    def spread(self, tokens: list[int]) -> list[int]:
        """The symbols that ``tokens`` were merged from."""
        out, todo = [], tokens[::-1]
        while todo:
            token = todo.pop()
            if token in self.parts:
                a, b = self.parts[token]
                todo += (b, a)
            else:
                out.append(token)
        return out

    def tree(self, symbols: list[int]) -> list[int]:
        """Encoding of ``symbols``: of a leaf at once, else of both halves, joined."""
        if len(symbols) <= self.leaf:
            return self.merge(list(symbols))
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def window(self, left, right) -> tuple[int, list[int], int]:
        """How many tokens at the join are replaced on the left, by what, and how many on the right.

        The window is encoded anew and grown until its outer tokens are those that both sides have.
        """
        a = b = 4
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merge(self.spread([*map(int, left[-a:]), *map(int, right[:b])]))
            before = a == len(left) or window[0] == left[-a]
            after = b == len(right) or window[-1] == right[b - 1]
            if before and after and (len(window) > 1 or (a == len(left) and b == len(right))):
                return a, window, b
            if not before or len(window) < 2:
                a *= 2
            if not after or len(window) < 2:
                b *= 2

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the text of both."""
        a, window, b = self.window(left, right)
        return left[:-a] + window + right[b:]

    def joined(self, parts: list[np.ndarray]) -> np.ndarray:
        """Encoding of the text of neighbouring parts, joined pair by pair."""
        while len(parts) > 1:
            pairs = []
            for left, right in zip(parts[::2], parts[1::2], strict=False):
                a, window, b = self.window(left, right)
                pairs.append(np.concatenate([left[:-a], np.array(window, "<u4"), right[b:]]))
            parts = pairs + parts[len(pairs) * 2:]
        return parts[0]

    def pieces(self, text: str, size: int) -> Iterator[tuple[str, int, bytes]]:
        """``(kind, word, content)`` of a text's pieces, each of at most about ``size`` symbols, in order.

        Kind ``words`` holds whole words, kind ``ids`` what is a token already, and kind ``part`` symbols
        of a long word, whose parts all state the number of its first piece as ``word``.
        """
        words, held, at = [], 0, 0
        inner = np.array(self.inner, "<u4")
        for chunk in _GAPS.split(text) if _ODD.search(text) else text.split():
            for bit in self.specials.split(chunk) if self.specials else [chunk]:
                found = [] if bit in self.special else self.words.findall(self._normal(bit))
                for word in [None] if bit in self.special else found:
                    raw = b"" if word is None else word.encode("utf-8", "surrogatepass")
                    whole = word is not None and len(raw) <= size
                    if words and (not whole or held + len(raw) > size):
                        yield "words", at, " ".join(words).encode("utf-8", "surrogatepass")
                        words, held, at = [], 0, at + 1
                    if whole:
                        words.append(word)
                        held += len(raw)
                    elif word is None:
                        yield "ids", at, struct.pack("<I", self.special[bit])
                        at += 1
                    else:
                        symbols = inner[np.frombuffer(raw, "u1")]
                        symbols[-1] = self.final[int(symbols[-1])]
                        first = at
                        for start in range(0, len(symbols), size):
                            yield "part", first, symbols[start:start + size].tobytes()
                            at += 1
        if words:
            yield "words", at, " ".join(words).encode("utf-8", "surrogatepass")

    def encode_piece(self, kind: str, content: bytes) -> bytes:
        """Ids of a piece."""
        if kind == "words":
            return b"".join(map(self.word_ids.__getitem__, content.decode("utf-8", "surrogatepass").split(" ")))
        return content if kind == "ids" else np.array(self.tree(np.frombuffer(content, "<u4").tolist()), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        inner = self.inner
        symbols = [inner[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] = self.final[symbols[-1]]
        ids = self.merge(symbols) if len(symbols) <= self.leaf else self.tree(symbols)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _normal(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _plain(self, text: str) -> bytes:
        text = self._normal(text)
        if text.isalpha():
            return self.word_ids[text]
        if text[:-1].isalpha() and not text[-1].isalpha():
            return self.word_ids[text[:-1]] + self.word_ids[text[-1]]
        return b"".join(map(self.word_ids.__getitem__, self.words.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text without white space, as little-endian unsigned 32-bit integers."""
        if self.specials is None or not any(s in chunk for s in self.special):
            return self._plain(chunk)
        return b"".join(
            struct.pack("<I", self.special[x]) if x in self.special else self._plain(x)
            for x in self.specials.split(chunk) if x)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        chunks = [c for c in _GAPS.split(text) if c] if _ODD.search(text) else text.split()
        return b"".join(map(self.chunk_ids.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids, special ones too, with a space between them."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The encoder of a file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def segments(size: int = SEGMENT) -> str:
    """Pattern of the segments of a text: ``size`` code points, then up to the next white space."""
    return rf"(?s).{{1,{size}}}[^{WHITE}]*"


def cut(keyed: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Segments ``_part`` of each different ``_key``, once for all rows that share it: they share the text."""
    parts = keyed.select("_key", F.posexplode(F.regexp_extract_all("_text", F.lit(segments(size)), 0)).alias("_at", "_part"))
    return parts.groupBy("_key", "_at").agg(F.first("_part").alias("_part"))


def long_runs(parts: DataFrame, path: str, size: int = SEGMENT) -> DataFrame:
    """``_ids`` of the pieces of segments ``_part``, numbered by ``_sub``: words of many parts in one piece.

    Pieces are encoded wherever their number sends them. Parts of a word are joined ``FAN`` at a time, and
    what that makes is joined again: a task of the second round holds ids of one word, as its row will.
    """
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = loaded(path)
        for batch in batches:
            for key, at, part in zip(batch["_key"], batch["_at"], batch["_part"], strict=True):
                made = ((key, at, sub, *piece) for sub, piece in enumerate(coder.pieces(part, size)))
                while some := list(itertools.islice(made, 64)):
                    yield pd.DataFrame(some, columns=["_key", "_at", "_sub", "_kind", "_word", "_content"])

    @F.pandas_udf("binary")
    def ids(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        coder = loaded(path)
        for kinds, contents in batches:
            yield pd.Series([coder.encode_piece(k, c) for k, c in zip(kinds, contents, strict=True)], dtype=object)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_sub")
        first = group.iloc[[0]].copy()
        first["_ids"] = [loaded(path).joined([np.frombuffer(x, "<u4") for x in group["_ids"]]).tobytes()]
        return first

    columns = "_key string, _at int, _sub int, _word int, _kind string, _ids binary"
    made = (parts.select("_key", "_at", "_part").mapInPandas(pieces, "_key string, _at int, _sub int, _kind string, _word int, _content binary")
            .repartition("_key", "_at", "_sub").select("_key", "_at", "_sub", "_word", "_kind", ids("_kind", "_content").alias("_ids")))
    near = F.floor((F.col("_sub") - F.col("_word")) / FAN)
    words = (made.filter("_kind = 'part'").groupBy("_key", "_at", "_word", near).applyInPandas(joined, columns)
             .groupBy("_key", "_at", "_word").applyInPandas(joined, columns))
    return made.filter("_kind <> 'part'").unionByName(words).select("_key", "_at", "_sub", "_ids")


def encode(df: DataFrame, path: str, text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text to the other columns.

    Null counts as empty: no tokens, digests of nothing. Every input row gives one output row,
    repeated rows too; other columns are carried unchanged, whatever their names. Only texts
    longer than ``segment`` are shuffled, as segments keyed by a digest of the text; rows with
    the same long text share one encoding: copies of a segment are dropped before it is encoded.
    """
    bounded(df.sparkSession)
    carried = [F.col(c) for c in df.columns if c != text]
    rows = df.select(F.struct(*carried).alias("_row") if carried else F.lit(None).alias("_row"),
                     filled(text).alias("_text"))
    is_long = F.length("_text") > segment
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digests(ids: bytes, decoded: str) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf(kind)
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = loaded(path)
        for batch in batches:
            yield pd.DataFrame(
                [digests(ids := coder.encode(t), coder.decode(ids)) for t in batch],
                columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    @F.pandas_udf("binary")
    def part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = loaded(path)
        for batch in batches:
            yield pd.Series([coder.encode(t) for t in batch], dtype=object)

    def concatenated(group: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(group.sort_values(["_at", "_sub"])["_ids"])
        return pd.DataFrame([(group["_key"].iloc[0], *digests(ids, loaded(path).decode(ids)))],
                            columns=["_key", "n_tokens", "ids_sha256", "decoded_sha256"])

    short = rows.filter(~is_long).select("_row", whole("_text").alias("_made"))
    keyed = rows.filter(is_long).withColumn("_key", F.sha2("_text", 256))
    parts = cut(keyed, segment)
    is_run = F.length("_part") > 2 * segment
    plain = parts.filter(~is_run).select("_key", "_at", F.lit(0).alias("_sub"), part("_part").alias("_ids"))
    long = (plain.unionByName(long_runs(parts.filter(is_run), path, segment))
            .groupBy("_key").applyInPandas(concatenated, "_key string, " + kind))
    joined = keyed.select("_row", "_key").join(long, "_key").select(
        "_row", F.struct("n_tokens", "ids_sha256", "decoded_sha256").alias("_made"))
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c != text]
    return short.unionByName(joined).select(*kept, "_made.*")
