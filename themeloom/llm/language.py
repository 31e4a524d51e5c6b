"""Language identification, word first, with backoff to shorter and shorter character n-grams.

Training counts words and n-grams per language in Spark, over a sample of labelled rows whose
size is a parameter; the model holds the most frequent of them, so it is bounded whatever the
corpus. A text is scored word by word: a word of the model by its log frequency in each
language; any other by its longest n-grams that the model has, and where it has too few of that
length, by the next shorter ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.batches import bounded, filled, give_back

#: Bounds of what is fitted: labelled rows, and words and n-grams of the model.
SAMPLE_ROWS, MODEL_WORDS, MODEL_GRAMS = 20_000, 60_000, 60_000
#: Rarer words and n-grams say little: next to what is never seen, their languages differ by the size of the training text.
LEAST_COUNT = 5
#: Longest n-gram, and the share of a word's n-grams that must be known for a length to count.
LONGEST, KNOWN = 5, 0.5
#: Words after which more evidence no longer sharpens a score.
EVIDENCE = 12
#: Added to each count; an unseen word or n-gram is as frequent as this.
SMOOTHING = 0.5
#: Words that a worker remembers.
REMEMBERED = 100_000
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never used for training; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray

    def backoff(self, word: str) -> tuple[list[int], int]:
        """Places of an unseen word's n-grams, of the longest length that is known, and that length.

        Each character is in n of them, so the sum of their log frequencies is divided by n.
        """
        marked, get = f" {word} ", self.grams.get
        for n in range(min(LONGEST, len(marked)), 0, -1):
            places = len(marked) - n + 1
            known = [g for i in range(places) if (g := get(marked[i:i + n])) is not None]
            if known and len(known) >= KNOWN * places:
                return known, n
        return [], 1

    def scores_of(self, words: list[str]) -> np.ndarray:
        """Log frequencies of each word in each language, zero for words of which nothing is known."""
        out = np.zeros((len(words), len(self.languages)))
        at = [self.words.get(w, -1) for w in words]
        known = [i for i, k in enumerate(at) if k >= 0]
        out[known] = self.word_scores[[at[i] for i in known]]
        found = [(i, *self.backoff(words[i])) for i, k in enumerate(at) if k < 0]
        found = [f for f in found if f[1]]
        if found:
            starts = np.cumsum([0] + [len(g) for _, g, _ in found[:-1]])
            sums = np.add.reduceat(self.gram_scores[[g for _, gs, _ in found for g in gs]], starts)
            out[[i for i, _, _ in found]] = sums / np.array([[n] for _, _, n in found])
        return out


def _scores(rows: list, languages: list[str], totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    index: dict[str, int] = {}
    for r in rows:
        index.setdefault(r["item"], len(index))
    counts = np.zeros((len(index), len(languages)))
    for r in rows:
        counts[index[r["item"]], languages.index(r["lang"])] = r["n"]
    size = np.array([totals.get(x, 0) for x in languages]) + SMOOTHING * (len(index) + 1)
    return index, np.log((counts + SMOOTHING) / size)


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``rows`` labelled rows that are not held out, chosen by a hash of the id.

    Rows with null text or language teach nothing. Without any, the model knows no language.
    """
    labelled = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id))
    there = labelled.count()
    chosen = labelled if there <= rows else labelled.filter(
        F.pmod(F.xxhash64(F.lit("train"), doc_id), F.lit(1 << 20)) < int((1 << 20) * rows / there))
    words = (chosen.select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)).alias("item"))
             .groupBy("lang", "item").agg(F.count("*").alias("n"))).cache()
    marked = F.concat(F.lit(" "), "item", F.lit(" "))
    grams = (words.select("lang", "n", marked.alias("item"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size"))
             .filter(F.length("item") >= F.col("size"))
             .select("lang", "n", F.explode(F.transform(
                 F.sequence(F.lit(1), F.length("item") - F.col("size") + 1),
                 lambda i: F.substring("item", i, F.col("size")))).alias("item"))
             .groupBy("lang", "item").agg(F.sum("n").alias("n")).cache())
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    lengths = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", F.length("item").alias("size")).agg(F.sum("n").alias("n")).collect()}

    def most(table: DataFrame, n: int) -> list:
        common = F.sum("n").over(Window.partitionBy("item")) >= LEAST_COUNT
        return table.withColumn("_common", common).filter("_common").orderBy(F.desc("n"), "item", "lang").limit(n).collect()

    languages = sorted(totals)
    word_index, word_scores = _scores(most(words, MODEL_WORDS), languages, totals)
    found = most(grams, MODEL_GRAMS)
    gram_index: dict[str, int] = {}
    gram_scores = np.zeros((0, len(languages)))
    for size in range(1, LONGEST + 1):
        own = [r for r in found if len(r["item"]) == size]
        index, scores = _scores(own, languages, {x: lengths.get((x, size), 0) for x in languages})
        gram_index |= {g: i + len(gram_scores) for g, i in index.items()}
        gram_scores = np.concatenate([gram_scores, scores])
    words.unpersist()
    grams.unpersist()
    return Model(languages, word_index, gram_index, word_scores, gram_scores)


class _Scorer:
    """Row of a word in a growing matrix of scores; starts anew when it holds too many words."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.model.languages)))

    def rows(self, words: list[str]) -> list[int]:
        if len(self.at) > REMEMBERED:
            self.reset()
        at = self.at
        new = [w for w in words if w not in at]
        if new:
            first = len(at)
            while first + len(new) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[first:first + len(new)] = self.model.scores_of(new)
            at.update(zip(new, range(first, first + len(new)), strict=True))
        return [at[w] for w in words]

    def predict(self, text: str) -> tuple[str, float]:
        counts = Counter(_WORD.findall(text.lower()))
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        rows = self.rows(list(counts))
        total = np.fromiter(counts.values(), float, len(counts)) @ self.matrix[rows]
        logits = total * min(1.0, EVIDENCE / counts.total())
        best = int(np.argmax(logits))
        return self.model.languages[best], 1.0 / float(np.exp(logits - logits[best]).sum())


def predict(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add ``held_out``, ``lang_pred`` and ``score`` to the columns of ``df``, which they replace if there.

    The score is the share of the best language, by likelihood of at most ``EVIDENCE`` words.
    Null text and text without a letter are ``und``, with score 0; of languages that tie, the
    first in order is taken. Each row gives one row; an empty table gives none.
    """
    bounded(df.sparkSession)
    spread = df.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_WORDS and MODEL_GRAMS

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(spread.value)
        try:
            for batch in batches:
                yield pd.DataFrame([scorer.predict(t) for t in batch], columns=["lang_pred", "score"])
        finally:
            give_back()

    # A filter on the result would otherwise be pushed below it, with a second evaluation of every text.
    once = scored.asNondeterministic()
    made = df.withColumn("held_out", held_out(doc_id)).withColumn("_made", once(filled(text)))
    rest = [c for c in made.columns if c not in ("lang_pred", "score", "_made")]
    return made.select(*rest, "_made.lang_pred", "_made.score")
