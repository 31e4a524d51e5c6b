"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Patterns give the base findings. Every other run of key-like characters is a *candidate*, words
too; a run that reaches beyond a base finding is one as well. A small convolutional network in
numpy reads its characters, and a second one those around it. What the surroundings can add or
take away is bounded by ``REACH``, so the score of the run alone, computed once for equal runs, tells
of most that no surroundings can make them a finding; the others are read where they stand.

The networks are trained on what the patterns label in all texts, on planted secrets of formats that
no pattern knows, and on planted look-alikes, numbers and names. Training begins on a bounded sample.
The network made there then reads every candidate of every text: all are counted, and all findings, and
all others that it does not place beyond the margin whatever stands around them, are learned from in rounds.
The loss of the rounds is zero beyond the margin, so the rest would teach nothing. In a round each task trains
on its shard, and the weights are averaged. A part of all is kept back to calibrate the scores and to choose the
threshold: the highest one that still finds the required share of all findings kept back.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import bounded, filled, give_back
from themeloom.storage import settle

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of [0-9a-f]+ are maximal, so the short ones can be left out at once
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "learned")

#: Bounds of the labelled sample: documents that are searched, findings of each label that are kept (about), and
#: characters of a longer finding that are kept, from a place chosen by its hash. Scanning reads whole runs.
SAMPLE_DOCUMENTS, SAMPLE_FINDINGS, SAMPLE_CHARS = 40_000, 3_000, 128
#: The sample is where training begins. Rounds over all texts' examples after it, times that each task goes through its
#: shard in one, examples of a shard (about), and the score, less than what the loss's margin of 1 asks for, below which one is not learned from.
ROUNDS, PASSES, SHARD, MARGIN = 2, 2, 10_000, 2.0
#: Steps of scores a unit, by which those of all texts are counted.
STEPS = 1_000
#: Planted examples of each label.
PLANTED = 2_000
#: Share of the labelled findings that the threshold has to find.
RECALL = 0.98
#: Candidates: runs of key-like characters, as long as the shortest secret of the patterns.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
BEFORE, AFTER = 24, 8
WIDTH, EMBEDDED, FILTERS, FILTERS_AROUND, EPOCHS, BATCH = 5, 8, 24, 12, 5, 64
#: The most that what stands around a candidate adds to its score or takes away.
REACH = 3.0
#: Characters of texts whose candidates are held at once, and positions that are looked at together.
TOGETHER, SLICE = 1 << 19, 1 << 14
#: Runs that a worker remembers when it scans, and when it states candidates.
REMEMBERED, STATED = 150_000, 300_000
_ALPHABET = 98  # padding, printable ASCII, white space, any other


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    value: int  # where the secret itself begins


def base_spans(text: str, longest: int | None = None) -> list[Span]:
    """Findings of the patterns, each kind leftmost and without overlaps, by start and then kind.

    ``longest`` is the length of the longest candidate, if known: a run of hex digits lies within one.
    """
    found = []
    if "=" in text or ":" in text:
        found += [Span("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST["access"]]
    if longest is None or longest >= LEAST["hex"]:
        found += [Span("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def overlaps(at: tuple[int, int], spans: list[Span]) -> bool:
    """Whether a secret of ``spans`` lies in the candidate, in whole or in part; its name alone does not count."""
    return any(s.value < at[1] and at[0] < s.end for s in spans)


def covered(at: tuple[int, int], spans: list[Span]) -> bool:
    """Whether the candidate lies within one finding, so that there is nothing to add."""
    return any(s.start <= at[0] and at[1] <= s.end for s in spans)


#: What stands before a candidate, the candidate, and what stands after it.
Found = tuple[str, str, str]


def surrounded(text: str, at: tuple[int, int]) -> Found:
    return text[max(0, at[0] - BEFORE):at[0]], text[at[0]:at[1]], text[at[1]:at[1] + AFTER]


_KNOWN = np.array([c - 31 if 32 < c < 127 else 96 if chr(c).isspace() else 97 for c in range(0x3002)], np.int64)


def _codes(text: str) -> np.ndarray:
    return _KNOWN[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x3001)]


def _inside(words: list[str]) -> np.ndarray:
    """Codes of each word, with padding after it."""
    out = np.zeros((len(words), max(map(len, words)) + WIDTH - 1), np.int64)
    for row, w in zip(out, words, strict=True):
        row[:len(w)] = _codes(w)
    return out


def _around(found: list[Found]) -> np.ndarray:
    """Codes of what stands before and after, the latter from an alphabet of its own."""
    out = np.zeros((len(found), BEFORE + AFTER), np.int64)
    for row, (before, _, after) in zip(out, found, strict=True):
        if before:
            row[BEFORE - len(before):BEFORE] = _codes(before)
        row[BEFORE:BEFORE + len(after)] = _codes(after) + _ALPHABET
    return out


class CharNet:
    """Two character convolutions: of a run, by maximum and mean over its windows, and of what is around it, by maximum.

    The score is linear in the first, and adds ``REACH`` times a hyperbolic tangent that is linear in the second.
    """

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (_ALPHABET, EMBEDDED)), "conv": r.normal(0, 0.3, (WIDTH * EMBEDDED, FILTERS)), "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.3, 2 * FILTERS), "shift": np.zeros(1),
            "embed_around": r.normal(0, 0.3, (2 * _ALPHABET, EMBEDDED)), "conv_around": r.normal(0, 0.3, (WIDTH * EMBEDDED, FILTERS_AROUND)),
            "bias_around": np.zeros(FILTERS_AROUND), "out_around": r.normal(0, 0.3, FILTERS_AROUND)}
        self._pad()
        self.r = r

    def _pad(self) -> None:
        for name in ("embed", "embed_around"):
            self.p[name][0] = 0

    def _convolved(self, x: np.ndarray, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
        columns = self.p["embed" + of][windows].reshape(*windows.shape[:2], -1)
        return windows, columns, np.maximum(columns @ self.p["conv" + of] + self.p["bias" + of], 0)

    def _forward(self, inside: np.ndarray, around: np.ndarray) -> tuple:
        windows, columns, conv = self._convolved(inside, "")
        real = windows[:, :, 0] != 0
        conv = conv * real[:, :, None]
        pooled = np.concatenate([conv.max(axis=1), conv.sum(axis=1) / real.sum(axis=1)[:, None]], axis=1)
        near = self._convolved(around, "_around")
        bent = np.tanh(near[2].max(axis=1) @ self.p["out_around"])
        return (windows, columns, conv, real), pooled, near, bent, pooled @ self.p["out"] + self.p["shift"][0] + REACH * bent

    def logits(self, found: list[Found]) -> np.ndarray:
        """Scores of examples of bounded length; ``Scanner`` scores runs of any length."""
        out = np.zeros(len(found))
        order = sorted(range(len(found)), key=lambda i: len(found[i][1]))
        for at in range(0, len(order), BATCH):
            part = [found[i] for i in order[at:at + BATCH]]
            out[order[at:at + BATCH]] = self._forward(_inside([f[1] for f in part]), _around(part))[-1]
        return out

    def _tables(self, of: str) -> list[np.ndarray]:
        """For each place in a window, what a character there adds to each filter."""
        return [(self.p["embed" + of] @ self.p["conv" + of][o * EMBEDDED:(o + 1) * EMBEDDED]).astype(np.float32) for o in range(WIDTH)]

    def inside_scores(self, words: list[str]) -> np.ndarray:
        """Scores of runs without what is around them, to single precision; memory does not grow with their length."""
        tables, bias = self._tables(""), self.p["bias"].astype(np.float32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + WIDTH - 1) - sizes - WIDTH + 1
        codes = np.zeros(int((sizes + WIDTH - 1).sum()) + WIDTH, np.int64)
        codes[np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = _codes("".join(words))
        best, total = np.zeros((len(words), FILTERS), np.float32), np.zeros((len(words), FILTERS), np.float64)
        for lo in range(0, len(codes) - WIDTH, SLICE):
            hi = min(lo + SLICE, len(codes) - WIDTH)
            line = sum(t.take(codes[lo + o:hi + o], 0) for o, t in enumerate(tables)) + bias
            np.maximum(line, 0, out=line)
            line[codes[lo:hi] == 0] = 0
            first = int(np.searchsorted(starts, lo, "right")) - 1
            last = int(np.searchsorted(starts, hi, "left"))
            cuts = np.maximum(starts[first:last] - lo, 0)
            best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(line, cuts))
            total[first:last] += np.add.reduceat(line, cuts)
        return np.concatenate([best, total / sizes[:, None]], axis=1) @ self.p["out"] + self.p["shift"][0]

    def around_scores(self, found: list[Found]) -> np.ndarray:
        """What the surroundings of candidates add, at most ``REACH``."""
        tables, out = self._tables("_around"), np.zeros(len(found))
        for at in range(0, len(found), SLICE // 8):
            x = _around(found[at:at + SLICE // 8])
            line = sum(t[x[:, o:BEFORE + AFTER - WIDTH + 1 + o]] for o, t in enumerate(tables)) + self.p["bias_around"].astype(np.float32)
            out[at:at + len(x)] = REACH * np.tanh(np.maximum(line.max(axis=1), 0) @ self.p["out_around"])
        return out

    def fit(self, found: list[Found], truth: np.ndarray, weight: np.ndarray | None = None, epochs: int = EPOCHS, rate: float = 0.01,
            hinge: bool = False) -> CharNet:
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        sizes = np.array([len(f[1]) for f in found])
        if weight is None:
            weight = np.where(truth == 1, 0.5 / max(truth.mean(), 1e-9), 0.5 / max(1 - truth.mean(), 1e-9))
        step = 0
        for _ in range(epochs):
            for part in self._batches(sizes):
                step += 1
                chosen = [found[i] for i in part]
                for k, g in self._gradients(_inside([f[1] for f in chosen]), _around(chosen), truth[part], weight[part], hinge).items():
                    m, v = moments[k]
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    self.p[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
                self._pad()
        return self

    def _batches(self, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """All examples in random batches, each of examples that are about as long, so that little is padding."""
        order, span = self.r.permutation(len(sizes)), 16 * BATCH
        for lo in range(0, len(order), span):
            part = order[lo:lo + span]
            part = part[np.argsort(sizes[part], kind="stable")]
            for at in self.r.permutation(range(0, len(part), BATCH)):
                yield part[at:at + BATCH]

    def _down(self, of: str, windows: np.ndarray, columns: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of one convolution, given those of what it returns."""
        each = (d @ self.p["conv" + of].T).reshape(-1, EMBEDDED)
        d_embed = np.column_stack([np.bincount(windows.ravel(), e, len(self.p["embed" + of])) for e in each.T])
        return {"embed" + of: d_embed, "conv" + of: np.einsum("nlw,nlf->wf", columns, d), "bias" + of: d.sum((0, 1))}

    def _gradients(self, inside: np.ndarray, around: np.ndarray, truth: np.ndarray, weight: np.ndarray, hinge: bool = False) -> dict[str, np.ndarray]:
        """Of the logistic loss, or of the squared hinge (halved), which goes on linearly from 2 on."""
        (windows, columns, conv, real), pooled, near, bent, logit = self._forward(inside, around)
        sign = 2 * truth - 1
        d = -sign * np.clip(1 - sign * logit, 0, 2) if hinge else 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth
        d = d * weight / len(inside)
        rows = np.arange(len(inside))[:, None]
        d_conv = (d[:, None] * self.p["out"][FILTERS:] / real.sum(axis=1)[:, None])[:, None, :] * np.ones_like(conv)
        best = conv.argmax(axis=1)
        d_conv[rows, best, np.arange(FILTERS)] += d[:, None] * self.p["out"][:FILTERS]
        d_bent = d * REACH * (1 - bent ** 2)
        d_near = np.zeros_like(near[2])
        best = near[2].argmax(axis=1)
        d_near[rows, best, np.arange(FILTERS_AROUND)] = d_bent[:, None] * self.p["out_around"]
        return {"out": pooled.T @ d, "shift": np.array([d.sum()]), "out_around": near[2].max(axis=1).T @ d_bent,
                **self._down("", windows, columns, d_conv * (conv > 0)), **self._down("_around", near[0], near[1], d_near * (near[2] > 0))}


@dataclass
class Scanner:
    """Trained networks, their calibration and threshold, and what held-out findings say of it; without networks, only patterns are used."""

    net: CharNet | None = None
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0
    recall: float = 0.0
    precision: float = 0.0

    def __post_init__(self):
        self._cold: set[str] = set()
        self._warm: dict[str, float] = {}

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))

    def scores(self, found: list[Found]) -> np.ndarray:
        return self.calibrated(self.net.logits(found))

    def least_logit(self) -> float:
        """The score, before calibration, that a finding has at least."""
        t = min(max(self.threshold, 1e-12), 1 - 1e-12)
        return (float(np.log(t / (1 - t))) - self.offset) / self.slope

    def scan(self, texts: list[str]) -> list[list[Span]]:
        """All findings of each text: those of the patterns, and candidates that are not within them over the threshold."""
        out, part, size = [], [], 0
        for t in texts:
            if part and size + len(t) > TOGETHER:
                out += self._scanned(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        return out + self._scanned(part) if part else out

    def _weigh(self, runs: set[str]) -> None:
        """Remember which runs could be findings; those that could not whatever is around them are cold."""
        words, least = list(runs), self.least_logit() - REACH
        size = 0
        part: list[str] = []
        for w in [*words, None]:
            if part and (w is None or size + len(w) > TOGETHER):
                for x, score in zip(part, self.net.inside_scores(part).tolist(), strict=True):
                    if score < least:
                        self._cold.add(x)
                    else:
                        self._warm[x] = score
                part, size = [], 0
            if w is not None:
                part.append(w)
                size += len(w)

    def _scanned(self, texts: list[str]) -> list[list[Span]]:
        runs = [CANDIDATE.findall(t) for t in texts]
        spans = [base_spans(t, max(map(len, r), default=0)) for t, r in zip(texts, runs, strict=True)]
        if self.net is None:
            return spans
        if len(self._cold) + len(self._warm) > REMEMBERED:  # before what these texts need of it is looked up
            self._cold.clear()
            self._warm.clear()
        new = set().union(*runs).difference(self._cold)
        self._weigh(new.difference(self._warm))
        where = [(i, m.span()) for i, t in enumerate(texts) if not self._warm.keys().isdisjoint(runs[i])
                 for m in CANDIDATE.finditer(t) if m.group() in self._warm and not covered(m.span(), spans[i])]
        if where:
            around = self.net.around_scores([_near(texts[i], at) for i, at in where])
            least = self.least_logit()
            for (i, at), extra in zip(where, around.tolist(), strict=True):
                if self._warm[texts[i][at[0]:at[1]]] + extra >= least:
                    spans[i].append(Span("learned", *at, at[0]))
        return [in_order(s) for s in spans]


def _near(text: str, at: tuple[int, int]) -> Found:
    """The surroundings of a candidate, which itself may be very long."""
    return text[max(0, at[0] - BEFORE):at[0]], "", text[at[1]:at[1] + AFTER]


def _varied(found: list[Found], truth: list[int]) -> tuple[list[Found], list[int]]:
    """Each finding as it is and without what stands around it; secrets also in the other case, others also in capitals."""
    out = [(f, y) for f, y in zip(found, truth, strict=True)]
    out += [(("", f[1], ""), y) for f, y in zip(found, truth, strict=True)]
    out += [((f[0], f[1].swapcase(), f[2]), y) for f, y in zip(found, truth, strict=True) if y]
    out += [((f[0], f[1].upper(), f[2]), y) for f, y in zip(found, truth, strict=True) if not y]
    return [f for f, _ in out], [y for _, y in out]


# Formats of planted secrets: what they begin with, the letters of the rest, and its length.
_MIXED = string.ascii_letters + string.digits
_FORMATS = (
    ("", _MIXED, (16, 40)), ("", _MIXED + "+/", (24, 64)), ("", _MIXED + "-_", (20, 48)), ("", string.ascii_uppercase + string.digits, (16, 32)),
    ("", "0123456789ABCDEF", (24, 64)), ("key_", _MIXED, (20, 40)), ("tok-", _MIXED, (20, 48)), ("live_", _MIXED, (16, 32)), ("", _MIXED, (10, 16)))
_SAID_BEFORE = ("key: ", "Authorization: Bearer ", "pwd ", "the secret is ", "credentials ", "export KEY=", "use ", "login with ", "\"", "(", "")
_SAID_AFTER = (" ", "\n", "\"", ")", ".", ",", "")


def planted(words: list[str], n: int, seed: int = 11) -> tuple[list[Found], list[Found]]:
    """``n`` secrets of formats that the patterns do not know, and ``n`` look-alikes, some made of ``words``."""
    r = random.Random(seed)
    words = words or ["word", "other", "longer"]

    def some(letters: str, a: int, b: int) -> str:
        return "".join(r.choices(letters, k=r.randint(a, b)))

    def secret() -> str:
        begin, letters, (a, b) = r.choice(_FORMATS)
        return begin + some(letters, a, b)

    likes = (
        lambda: "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: some(string.digits, 6, 19),
        lambda: f"{some(string.digits, 3, 3)}-{some(string.digits, 4, 4)}", lambda: f"{r.randint(1900, 2100)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: "-".join(r.choices(words, k=r.randint(2, 5))), lambda: "_".join(r.choices(words, k=r.randint(2, 4))).lower(),
        lambda: "/".join(r.choices(words, k=r.randint(2, 5))), lambda: "".join(w.capitalize() for w in r.choices(words, k=r.randint(2, 4))),
        lambda: r.choice(words).upper() + r.choice(("", "S", "-2", "_10")), lambda: r.choice("-=_+/x") * r.randint(6, 60),
        lambda: r.choice(words) * r.randint(1, 3) + r.choice(("", some(string.digits, 1, 4))))

    def placed(inside: str) -> Found:
        return r.choice((r.choice(_SAID_BEFORE), " ".join(r.choices(words, k=3))[-BEFORE + 1:] + " "))[-BEFORE:], inside, r.choice(_SAID_AFTER)

    def several(make) -> list[Found]:
        out = []
        while len(out) < n:
            if CANDIDATE.fullmatch(x := make()[:SAMPLE_CHARS]) and not HEX.search(x):
                out.append(placed(x))
        return out

    return several(secret), several(lambda: r.choice(likes)())


def _calibrated(logits: np.ndarray, truth: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the scores, each there ``counts`` times, by Newton steps with a weak prior."""
    w = np.array([1.0, 0.0])
    x = np.column_stack([logits, np.ones_like(logits)])
    right, wrong = (counts * truth).sum(), (counts * (1 - truth)).sum()
    goal = np.where(truth == 1, (right + 1) / (right + 2), 1 / (wrong + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (counts * (p - goal)) + 1e-3 * (w - [1, 0])), -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


def _window(text: str, at: tuple[int, int]) -> tuple[int, int]:
    """The part of a longer candidate that an example is made of."""
    extra = at[1] - at[0] - SAMPLE_CHARS
    if extra <= 0:
        return at
    start = at[0] + int.from_bytes(hashlib.sha256(text[at[0]:at[1]].encode()).digest()[:8], "big") % (extra + 1)
    return start, start + SAMPLE_CHARS


def _netted(weights: dict[str, np.ndarray]) -> CharNet:
    net = CharNet()
    net.p = {k: v.copy() for k, v in weights.items()}
    return net


def examples(df: DataFrame, net: CharNet, text: str = "text") -> DataFrame:
    """Candidates of all texts: order, before, inside, after and label, the texts null where ``net`` places it beyond the margin.

    A task states a candidate once, as far as it remembers; ``order`` is a hash of its characters.
    """
    spread = df.sparkSession.sparkContext.broadcast(net.p)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = _netted(spread.value), (set(), set())
        for batch in batches:
            made, size = [{}, {}], 0
            for t in [*batch["text"], None]:
                if t is not None:
                    new = set(CANDIDATE.findall(t))
                    spans = base_spans(t, max(map(len, new), default=0))
                    if spans or not new <= seen[0]:
                        for at in candidates(t):
                            label = int(bool(spans) and overlaps(at, spans))
                            if (inside := t[slice(*_window(t, at))]) not in seen[label]:
                                seen[label].add(inside)
                                before, _, after = _near(t, at)
                                made[label][inside] = before, after
                    size += len(t)
                if t is None or size > TOGETHER:
                    others = list(made[0])
                    far = own.inside_scores(others) + REACH <= -MARGIN if others else []
                    rows = [(x, *made[1][x], 1, False) for x in made[1]]
                    rows += [(x, *made[0][x], 0, bool(f)) for x, f in zip(others, far, strict=True)]
                    yield pd.DataFrame(rows, columns=["inside", "before", "after", "label", "far"])
                    made, size = [{}, {}], 0
                    for s in seen:
                        if len(s) > STATED:
                            s.clear()
        give_back()

    kind = "inside string, before string, after string, label int, far boolean"
    near = [F.when(~F.col("far"), F.col(c)).alias(c) for c in ("before", "inside", "after")]
    return (df.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(read, kind)
            .select(F.xxhash64("inside").alias("order"), *near, "label"))


def _round(found: DataFrame, net: CharNet, planted_too: list[tuple[Found, int]], shards: int, counts: dict[int, int]) -> CharNet:
    """The mean of the networks that tasks make of ``net``, each by its shard and what is planted.

    Findings, other candidates, planted secrets and look-alikes weigh the same in all, whatever their ``counts``.
    """
    spread = found.sparkSession.sparkContext.broadcast((net.p, planted_too))

    def trained(shard: pd.DataFrame) -> pd.DataFrame:
        weights, extra = spread.value
        shard = shard.sort_values(["inside", "label"])
        part = [((b, x, a), int(y), 1 / counts[y]) for b, x, a, y in zip(shard["before"], shard["inside"], shard["after"], shard["label"], strict=True)]
        planted_of = {y: max(1, sum(z == y for _, z in extra)) for y in (0, 1)}
        part += [(f, y, 1 / (planted_of[y] * shards)) for f, y in extra]
        varied, truth = _varied([f for f, _, _ in part], [y for _, y, _ in part])
        each = dict(zip(((f[1], y) for f, y, _ in part), (w for _, _, w in part), strict=True))
        low = {(x.swapcase() if y else x.upper(), y): w for (x, y), w in each.items()}
        weight = np.array([each.get((f[1], y)) or low[f[1], y] for f, y in zip(varied, truth, strict=True)])
        own = _netted(weights).fit(varied, np.array(truth, float), weight / weight.mean(), PASSES, 0.002, True)
        flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)])
        return pd.DataFrame({"at": np.arange(len(flat), dtype=np.int32), "value": flat})

    rows = found.groupBy("shard").applyInPandas(trained, "at int, value double").groupBy("at").agg(F.avg("value").alias("value")).collect()
    flat, made, at = np.array([v for _, v in sorted(map(tuple, rows))]), CharNet(), 0
    if not len(flat):
        return net
    for k in sorted(net.p):
        made.p[k] = flat[at:at + net.p[k].size].reshape(net.p[k].shape)
        at += net.p[k].size
    return made


def _scored(found: DataFrame, net: CharNet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all of ``found``, varied, rounded down to ``STEPS`` a unit, with their labels and how many there are."""
    spread = found.sparkSession.sparkContext.broadcast(net.p)

    def stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _netted(spread.value)
        for batch in batches:
            varied, truth = _varied(list(zip(batch["before"], batch["inside"], batch["after"], strict=True)), batch["label"].tolist())
            yield pd.DataFrame({"label": truth, "step": np.floor(np.clip(own.logits(varied), -30, 30) * STEPS).astype(np.int64)})

    rows = found.select("before", "inside", "after", "label").mapInPandas(stepped, "label int, step long").groupBy("label", "step").count().collect()
    made = np.array(sorted(map(tuple, rows)), float).reshape(-1, 3)
    return made[:, 1] / STEPS, made[:, 0], made[:, 2]


def train(df: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS, findings: int = SAMPLE_FINDINGS, plant: int = PLANTED) -> Scanner:
    """Fit on the candidates of all texts and on twice ``plant`` planted ones.

    Training begins on candidates of about ``documents`` texts, about ``findings`` different ones of each label.
    Texts and findings are chosen by hash there; null texts teach nothing. Without a finding of the patterns
    the planted secrets are the only ones; without any candidate there is nothing to learn, and the
    scanner uses the patterns alone. ``recall`` and ``precision`` are those on the part kept back.
    """
    bounded(df.sparkSession)
    texts = df.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    start, extra = _begun(texts, documents, findings, plant)
    if start is None:
        return Scanner()
    every = settle(examples(texts, start), "secret-candidates")
    counts = {r["label"]: r["n"] for r in every.select("order", "label").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}
    near = every.filter("inside is not null").groupBy("order", "inside", "label").agg(F.min(F.struct("before", "after")).alias("_around"))
    found = settle(near.select("order", "inside", "label", "_around.*"), "secret-examples")
    back = F.pmod("order", F.lit(4)) == 0
    shards = -(-max(1, found.filter(~back).count()) // SHARD)
    dealt = found.filter(~back).withColumn("shard", F.pmod(F.xxhash64("inside", F.lit("shard")), F.lit(shards)))
    net = start
    for _ in range(ROUNDS):
        net = _round(dealt, net, [(f, y) for f, y, k in extra if not k], shards, counts)
    varied, truth = _varied([f for f, _, k in extra if k], [y for _, y, k in extra if k])
    logits, labels, times = _scored(found.filter(back), net)
    truth, times = np.concatenate([truth, labels]), np.concatenate([np.ones(len(truth)), times])
    scanner = Scanner(net, *_calibrated(np.concatenate([net.logits(varied), logits]), truth, times))
    scores = np.concatenate([scanner.scores(varied), scanner.calibrated(logits)])
    order = np.argsort(scores[truth == 1], kind="stable")
    below = np.cumsum(times[truth == 1][order])
    scanner.threshold = float(scores[truth == 1][order][np.searchsorted(below, np.floor((1 - RECALL) * below[-1]), "right")]) - 1e-6
    over = scores >= scanner.threshold
    scanner.recall = float(times[over & (truth == 1)].sum() / times[truth == 1].sum())
    scanner.precision = float(times[over & (truth == 1)].sum() / times[over].sum())
    return scanner


def _begun(texts: DataFrame, documents: int, findings: int, plant: int) -> tuple[CharNet | None, list[tuple[Found, int, bool]]]:
    """A network trained on a bounded sample, none without candidates; and what is planted, with its label and whether it is kept back."""
    there = texts.count()
    if there > documents:
        texts = texts.filter(F.pmod(F.xxhash64(F.lit("secrets"), "text"), F.lit(1 << 20)) < int((1 << 20) * documents / there))

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {}  # one of each candidate, as of the whole sample below
            for t in batch["text"]:
                spans = base_spans(t)
                for at in candidates(t):
                    if (inside := t[slice(*_window(t, at))]) not in rows:
                        before, _, after = _near(t, at)
                        rows[inside] = (before, inside, after, int(overlaps(at, spans)))
            yield pd.DataFrame(list(rows.values()), columns=["before", "inside", "after", "label"])

    found = settle(texts.mapInPandas(labelled, "before string, inside string, after string, label int")
                   .dropDuplicates(["inside"]).withColumn("order", F.xxhash64("inside")), "secret-start")
    rows = []
    for label, n in found.groupBy("label").count().collect():  # two rows
        share = int((1 << 30) * min(1.0, findings / n))
        rows += sorted(map(tuple, found.filter((F.col("label") == label) & (F.pmod(F.xxhash64("order"), F.lit(1 << 30)) < share)).collect()))
    words = [inside for _, inside, _, label, _ in rows if not label and inside.isalpha() and len(inside) < 16]
    secrets, likes = planted(words, plant)
    extra = [(f, y, i % 4 == 0) for y, part in ((1, secrets), (0, likes)) for i, f in enumerate(part) if rows]
    fit = [((before, inside, after), label) for before, inside, after, label, order in rows if order % 4]
    fit += [(f, y) for f, y, k in extra if not k]
    if len({y for _, y in fit}) < 2 or len({y for _, y, k in extra if k}) < 2:
        return None, []
    varied, truth = _varied([f for f, _ in fit], [y for _, y in fit])
    return CharNet().fit(varied, np.array(truth, float)), extra


def scan(df: DataFrame, scanner: Scanner, text: str = "text") -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256, spans and the text without its secrets, ``clean_text``.

    Spans are ``kind:start:end`` in code points. In ``clean_text`` the value of each finding is
    replaced by ``[SECRET]``. Null text counts as empty, without findings; each row gives one row,
    whatever other columns there are, which are kept unless they have one of these names.
    """
    bounded(df.sparkSession)
    spread = df.sparkSession.sparkContext.broadcast((scanner.net and scanner.net.p, scanner.slope, scanner.offset, scanner.threshold))

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, *numbers = spread.value
        own = Scanner(None, *numbers)
        if weights is not None:
            own.net = CharNet()
            own.net.p = weights
        for batch in batches:
            rows = []
            for t, spans in zip(batch, own.scan(list(batch)), strict=True):
                base = [s for s in spans if s.kind != "learned"]
                n = [sum(s.kind == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), without(t, spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"])
        give_back()

    names = {"n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"}
    return df.withColumn("_made", scanned(filled(text))).select(*[c for c in df.columns if c not in names], "_made.*")


def without(text: str, spans: list[Span]) -> str:
    """The text with ``[SECRET]`` for the values of findings; values that overlap are one."""
    out, done = [], 0
    for start, end in sorted((s.value, s.end) for s in spans):
        if start >= done:
            out += (text[done:start], "[SECRET]")
        done = max(done, end)
    return "".join(out) + text[done:] if spans else text
