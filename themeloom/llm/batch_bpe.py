"""BPE ids of many texts at once: words not met before are merged together, in numpy.

``bpe.Bpe`` knows the tokenizer file and merges one word at a time. In prose with an open
vocabulary most of the time goes there, so here the new words of a whole batch become one matrix
of symbols; in each round every word applies its merge of lowest rank, the leftmost first. Words
that are done leave the matrix. The ids are those of ``Bpe``, hence of the tokenizers library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain, pairwise
from operator import add

import numpy as np
import regex

from themeloom.llm.bpe import WHITE, Bpe

#: Runs between white space whose ids a worker remembers before it starts anew.
REMEMBERED = 700_000
#: Words that are merged at once, and the longest of them in bytes; longer ones go through the tree.
TOGETHER, LONGEST = 16_384, 48

#: Characters that Python's split() takes for white space and Unicode does not.
_ODD = "\x1c\x1d\x1e\x1f"
_GAPS = regex.compile(f"[{WHITE}]+")
_NEVER = np.int32(1 << 30)


class BatchBpe(Bpe):
    """Encoder of whole batches of texts."""

    def __init__(self, path: str):
        super().__init__(path)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.int64(1) << 40)
        self._ranks = np.append(np.fromiter(self.ranks.values(), np.int32, len(keys))[order], _NEVER)
        self._made = np.array(self.merged, np.int32)
        self._inner = np.array(self.inner, np.int32)
        self._final = np.array([self.final[i] for i in self.inner], np.int32)
        # Ranks of the merges of two bytes, within a word and at its end: left byte * 256 + right byte.
        self._pairs = self._rank(self._inner[:, None], self._inner).ravel()
        self._last_pairs = self._rank(self._inner[:, None], self._final).ravel()
        self.remembered = REMEMBERED
        self.forget()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols; symbols under zero merge with nothing."""
        key = left.astype(np.int64) << 16 | right
        at = np.searchsorted(self._keys, key)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._ranks[at], _NEVER)

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers; no word is empty."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), TOGETHER):
            chosen = order[at:at + TOGETHER]
            for i, ids in zip(chosen.tolist(), self._matrix([words[i] for i in chosen], sizes[chosen]), strict=True):
                out[i] = ids
        return out

    def _matrix(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        n, width = len(words), int(sizes.max())
        inside, ends = np.arange(width + 1) < sizes[:, None], np.cumsum(sizes) - 1
        joined = np.frombuffer(b"".join(words), np.uint8)
        symbols = np.full((n, width + 1), -1, np.int32)
        symbols[inside] = self._inner[joined]
        symbols[np.arange(n), sizes - 1] = self._final[joined[ends]]
        # The pair at a word's last byte crosses to the next word, and merges with nothing.
        pairs = joined[:-1].astype(np.int32) << 8 | joined[1:]
        flat = np.append(self._pairs[pairs], _NEVER)
        flat[ends] = _NEVER
        last = ends[sizes > 1] - 1
        flat[last] = self._last_pairs[pairs[last]]
        ranks = np.full((n, width), _NEVER, np.int32)
        ranks[inside[:, :width]] = flat
        done = np.empty((n, width + 1), np.int32)
        left, own = sizes.copy(), np.arange(n)
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(own), np.int64)
            rows = np.arange(len(own))
            rank = ranks[rows, best] if ranks.shape[1] else np.full(len(own), _NEVER)
            ready = rank == _NEVER
            if ready.any():
                done[own[ready], :symbols.shape[1]] = symbols[ready]
                keep = ~ready
                own, symbols, ranks, best, rank = own[keep], symbols[keep], ranks[keep], best[keep], rank[keep]
                rows = np.arange(len(own))
            if not len(own):
                break
            left[own] -= 1
            symbols[rows, best] = self._made[rank]
            # What stands right of the merged pair moves one place to the left.
            kept = np.ones(symbols.shape, bool)
            kept[rows, best + 1] = False
            symbols = symbols[kept].reshape(len(own), -1)
            kept = np.ones(ranks.shape, bool)
            kept[rows, best] = False
            ranks = ranks[kept].reshape(len(own), -1)
            if ranks.shape[1]:
                at = np.minimum(best, ranks.shape[1] - 1)
                ranks[rows, at] = self._rank(symbols[rows, at], symbols[rows, at + 1])
                at = np.maximum(best - 1, 0)
                ranks[rows, at] = self._rank(symbols[rows, at], symbols[rows, at + 1])
        ids = done[np.arange(width + 1) < left[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(left) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of normalised runs of text without white space, and of the words in them."""
        known = self._known
        plain = {c for c in chunks if c.isalpha()}
        tailed = [c for c in chunks if c not in plain and c[:-1].isalpha() and not c[-1].isalpha()]
        odd = list(set(chunks).difference(plain, tailed))
        found = list(map(self.words.findall, odd))
        stems, tails = [c[:-1] for c in tailed], [c[-1] for c in tailed]
        new = list(plain.union(stems, tails, *found).difference(known))
        known.update(zip(new, self._several([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        known.update(zip(tailed, map(add, map(known.__getitem__, stems), map(known.__getitem__, tails)), strict=True))
        known.update(zip(odd, (b"".join(map(known.__getitem__, words)) for words in found), strict=True))

    def _several(self, words: list[bytes]) -> list[bytes]:
        out = [b"" if len(w) <= LONGEST else self._word(w.decode("utf-8", "surrogatepass")) for w in words]
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        for i, ids in zip(short, self.merged_together([words[i] for i in short]), strict=True):
            out[i] = ids
        return out

    def forget(self) -> None:
        """Give the memory of remembered words back."""
        # No run holds white space, so none is taken for a special token, however it is spelled.
        self._known = {" " + s: struct.pack("<I", i) for s, i in self.special.items()}

    def _split(self, text: str) -> list[str]:
        """The normalised runs of a text between white space; special tokens are those of ``forget``."""
        if any(s in text for s in self.special):
            return list(chain.from_iterable(
                [" " + bit] if bit in self.special else self._runs(bit) for bit in self.specials.split(text)))
        return self._runs(text)

    def _runs(self, text: str) -> list[str]:
        text = self._normal(text)
        return [c for c in _GAPS.split(text) if c] if any(c in text for c in _ODD) else text.split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self._known) > self.remembered:
            self.forget()
        chunks, ends = [], [0]
        for text in texts:
            chunks += self._split(text)
            ends.append(len(chunks))
        ids = list(map(self._known.get, chunks))
        missing = [i for i, known in enumerate(ids) if known is None]
        self._learn(list({chunks[i] for i in missing}))
        for i in missing:
            ids[i] = self._known[chunks[i]]
        return [b"".join(ids[a:b]) for a, b in pairwise(ends)]


def runs(texts: list[str], together: int) -> Iterator[list[str]]:
    """``texts`` in runs of ``together`` code points at most, or of one text."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > together:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


_loaded: dict[str, BatchBpe] = {}


def loaded(path: str) -> BatchBpe:
    """The encoder of a file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = BatchBpe(path)
    return _loaded[path]
