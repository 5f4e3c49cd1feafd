"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is itself and its character n-grams between ``<`` and ``>``, each hashed to a row of one embedding table, so a
misspelling that was never seen shares most rows with the word it bends. The rows of a word are averaged, the words of
a passage (``PASSAGE`` words, each passage starting half a passage after the last, covering the whole text) are averaged,
and a linear softmax gives the passage's probability; a text is as toxic as its worst passage, in training too. Scoring
needs one number for each distinct word, cached up to a bound.

Defined results: null and empty texts score as an empty passage (the bias alone); repeated rows give equal scores; null
ids are kept and held out by the crc32 of an empty text; other columns are ignored, whatever their names; without labelled
rows every score is 0; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verselake.llm import labelled

FOLDS, HELD_OUT, CUT = 4, 2, 0.3
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 8, 3, 6
PASSAGE = 16
#: A word of fewer n-grams counts as filled up with empty ones, so that a short word can't decide by one of them.
LEAST_GRAMS = 16
#: Factor on the average before the softmax; with it, one word among a passage's can decide.
SCALE = 100.0
#: Logit of a passage that says nothing.
PRIOR = -4.0
EPOCHS, WHOLE, BATCH, RATE, SEED = 8, 2, 16, 0.05, 11
CACHE_ENTRIES = 1 << 20
#: Labelled rows that it learns from at most, half of each label.
LEARN_ROWS = 1600
EDGE = ".,;:!?\"'()[]{}*#$%&|<>-_"


def subwords(word: str) -> list[int]:
    bare = word.strip(EDGE) or word
    marked = f"<{bare}>"
    end = len(marked) + 1
    grams = {marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(end - n)}
    grams.add(marked)
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


def passages(n: int) -> np.ndarray:
    """(from, to) of each passage over n words."""
    starts = np.arange(0, max(1, n - PASSAGE // 2), PASSAGE // 2)
    return np.stack([starts, np.minimum(starts + PASSAGE, n)], axis=1)


def worst_passage(values: np.ndarray) -> tuple[float, int, int]:
    """(average, from, to) of the passage whose words' values have the highest average. A word that repeats the one
    before it counts as empty, and a short passage as filled up with empty words."""
    values = values.copy()
    values[1:][values[1:] == values[:-1]] = 0.0
    sums = np.concatenate([[0.0], np.cumsum(values)])
    spans = passages(len(values))
    part = sums[spans[:, 1]] - sums[spans[:, 0]]
    k = int(np.argmax(part))
    return float(part[k]) / PASSAGE, int(spans[k, 0]), int(spans[k, 1])


@dataclass
class SubwordModel:
    rows: np.ndarray  # (BUCKETS, DIM)
    out: np.ndarray  # (DIM, 2)
    bias: np.ndarray

    def word_logits(self) -> np.ndarray:
        """Difference of the two classes' logits for each row."""
        return SCALE * (self.rows @ (self.out[:, 1] - self.out[:, 0]))


class Scorer(dict):
    """Cache from a word to the average logit difference of its rows."""

    def __init__(self, model: SubwordModel):
        super().__init__()
        self.logit, self.bias = model.word_logits(), float(model.bias[1] - model.bias[0])

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        rows = subwords(word)
        self[word] = out = float(self.logit[rows].sum() / max(len(rows), LEAST_GRAMS))
        return out

    def score(self, text: str) -> float:
        words = text.lower().split()
        logit = self.bias
        if words:
            logit += worst_passage(np.fromiter(map(self.__getitem__, words), np.float64, len(words)))[0]
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def fit(rows: list[tuple[str, int]], seed: int = SEED, epochs: int = EPOCHS) -> SubwordModel | None:
    """Adagrad on the log loss, first of whole texts (``WHOLE`` epochs), then of each text's worst passage."""
    if len({y for _, y in rows}) < 2:
        return None
    rng = np.random.default_rng(seed)
    # Rows start at zero, so an n-gram that training never met says nothing.
    model = SubwordModel(np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.array([0.0, PRIOR]))
    seen: dict[str, np.ndarray] = {}
    bags = []
    for text, _ in rows:
        words = text.lower().split()
        for w in set(words) - seen.keys():
            seen[w] = np.array(sorted(subwords(w)), np.int32)
        parts = [seen[w] for w in words]
        size = np.array([len(p) for p in parts], np.int64)
        bags.append((np.concatenate(parts) if parts else np.zeros(0, np.int32), np.cumsum(size) - size, size))
    del seen
    spread, spread_out = np.full(BUCKETS, 1e-8), np.full(model.out.shape, 1e-8)
    for epoch in range(epochs):
        for n, i in enumerate(rng.permutation(len(rows))):
            if n % BATCH == 0:
                gap = model.word_logits()
            ids, starts, size = bags[i]
            lo, hi, over = 0, len(size), max(PASSAGE, len(size))
            if epoch >= WHOLE and len(size) > PASSAGE:
                _, lo, hi = worst_passage(np.add.reduceat(gap[ids], starts) / np.maximum(size, LEAST_GRAMS))
                over = PASSAGE
            first = starts[lo] if hi else 0
            last = starts[hi - 1] + size[hi - 1] if hi else 0
            unique, place = np.unique(ids[first:last], return_inverse=True)
            weight = np.repeat(1 / (np.maximum(size[lo:hi], LEAST_GRAMS) * over), size[lo:hi])
            count = np.bincount(place, weight, minlength=len(unique))
            share = (SCALE * count).astype(np.float32)
            mean = share @ model.rows[unique]
            logits = mean @ model.out + model.bias
            p = 1 / (1 + np.exp(-np.clip(logits[1] - logits[0], -60, 60)))
            error = np.array([rows[i][1] - p, p - rows[i][1]])
            grad = share[:, None] * (model.out @ error).astype(np.float32)[None, :]
            grad_out = np.outer(mean, error)
            spread[unique] += (grad * grad).mean(axis=1)
            spread_out += grad_out * grad_out
            model.rows[unique] -= (RATE / np.sqrt(spread[unique])).astype(np.float32)[:, None] * grad
            model.out -= (RATE * grad_out / np.sqrt(spread_out)).astype(np.float32)
    return model


def score_column(model: SubwordModel | None, text: Column) -> Column:
    """Probability that a text is toxic."""
    if model is None:
        return F.lit(0.0)
    slim = SubwordModel((model.word_logits()[:, None] / SCALE).astype(np.float32), np.array([[0.0, 1.0]], np.float32), model.bias)
    cache: list[Scorer] = []

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not cache:
            cache.append(Scorer(slim))
        return pd.Series([cache[0].score(t) for t in texts.fillna("").tolist()], dtype="float64")

    return score(text.cast("string"))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel | None:
    return fit(labelled.sample(docs, labels, "toxic", FOLDS, HELD_OUT, id_col, text_col, LEARN_ROWS, balanced=True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of each row of docs."""
    model = trained(docs, labels, id_col, text_col)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    scored = chosen.select("_id", score_column(model, F.col("_text")).alias("score"))
    return scored.select(
        F.col("_id").alias(id_col), (labelled.fold(F.col("_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
