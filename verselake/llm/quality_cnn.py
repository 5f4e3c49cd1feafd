"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each filter sees ``WIDTH`` bytes at every
second place of a chunk; its greatest answer in the chunk passes a rectifier, the answers of all chunks are averaged, and
a logistic layer makes one probability. Because a filter over one-hot bytes is a sum of table rows, it is evaluated with
one look-up for each pair of bytes. Only the winning place of a chunk gets a gradient.

Defined results: null and empty texts are one chunk of zero bytes and get a score too; repeated rows give equal scores; null
ids are kept and held out by the crc32 of an empty text; other columns are ignored, whatever their names; without labelled
rows every score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verselake.llm import labelled
from verselake.llm.memory import give_back, released

FOLDS, HELD_OUT, CUT = 5, 0, 0.3
FILTERS, WIDTH = 16, 6
#: Pairs of bytes in a chunk, and how far the next chunk starts.
CHUNK, STEP = 256, 252
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.01, 7
#: Chunks that are evaluated at once.
SLAB = 2048


def chunks_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks of byte pairs, owner of each chunk)."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        data = text.encode()
        pairs = np.frombuffer(data + b"\0" * (len(data) % 2), "<u2")
        n = max(1, -(-(len(pairs) - (CHUNK - STEP)) // STEP))
        padded = np.zeros((n - 1) * STEP + CHUNK, np.uint16)
        padded[: len(pairs)] = pairs
        parts.append(np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP])
        owner.append(np.full(n, i))
    return np.concatenate(parts), np.concatenate(owner)


@dataclass
class ByteCNN:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> ByteCNN:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, 0.3, FILTERS).astype(np.float32),
            np.zeros(1, np.float32),
        )

    def tables(self) -> list[np.ndarray]:
        """For each pair of the width, a row of answers for each value of the pair (low byte first)."""
        w = self.filters
        return [(w[j + 1][:, None, :] + w[j][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def pooled(self, chunks: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Greatest answer of each filter in each chunk, and where."""
        places = CHUNK - len(tables) + 1
        z = tables[0][chunks[:, :places]]
        for j in range(1, len(tables)):
            z += tables[j][chunks[:, j : j + places]]
        return z.max(axis=1) + self.bias, z.argmax(axis=1) if self.training else None

    training = False

    def scores(self, texts: list[str], tables: list[np.ndarray] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out, i = np.empty(len(texts)), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < SLAB * STEP):
                size += len(texts[j])
                j += 1
            chunks, owner = chunks_of(texts[i:j])
            sums = np.zeros((j - i, FILTERS))
            for k in range(0, len(chunks), SLAB // 8):
                best, _ = self.pooled(chunks[k : k + SLAB // 8], tables)
                np.add.at(sums, owner[k : k + SLAB // 8], np.maximum(best, 0))
            mean = sums / np.bincount(owner, minlength=j - i)[:, None]
            out[i:j] = 1 / (1 + np.exp(-(mean @ self.weights + self.intercept[0])))
            i = j
        return out


def fit(rows: list[tuple[str, int]], seed: int = SEED, epochs: int = EPOCHS) -> ByteCNN | None:
    if len({y for _, y in rows}) < 2:
        return None
    rng = np.random.default_rng(seed)
    net = ByteCNN.fresh(seed)
    net.training = True
    params = [net.filters, net.bias, net.weights, net.intercept]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    target = np.array([y for _, y in rows], np.float64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            take = order[b : b + BATCH]
            chunks, owner = chunks_of([rows[i][0] for i in take])
            tables = net.tables()
            answers = [net.pooled(chunks[k : k + SLAB // 8], tables) for k in range(0, len(chunks), SLAB // 8)]
            best, place = np.concatenate([a for a, _ in answers]), np.concatenate([p for _, p in answers])
            active = np.maximum(best, 0)
            count = np.bincount(owner, minlength=len(take))
            mean = np.zeros((len(take), FILTERS))
            np.add.at(mean, owner, active)
            mean /= count[:, None]
            score = 1 / (1 + np.exp(-(mean @ net.weights + net.intercept[0])))
            error = (score - target[take]) / len(take)
            grads = [np.zeros_like(p) for p in params]
            grads[2][:], grads[3][0] = error @ mean, error.sum()
            back = (error / count)[owner][:, None] * net.weights[None, :] * (best > 0)
            grads[1][:] = back.sum(axis=0)
            row, filt = np.nonzero(back)
            for j in range(WIDTH):
                pair = chunks[row, place[row, filt] + j // 2]
                byte = (pair >> 8) if j % 2 else (pair & 255)
                np.add.at(grads[0][j], (byte, filt), back[row, filt])
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.training = False
    return net


def score_column(net: ByteCNN | None, text: Column) -> Column:
    """Probability of label 1."""
    if net is None:
        return F.lit(0.5)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = net.tables()
        yield from released(pd.Series(net.scores(texts.fillna("").tolist(), tables)) for texts in batches)

    return score(text.cast("string"))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ByteCNN | None:
    net = fit(labelled.sample(docs, labels, "quality", FOLDS, HELD_OUT, id_col, text_col))
    give_back()
    return net


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of each row of docs."""
    net = trained(docs, labels, id_col, text_col)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    scored = chosen.select("_id", score_column(net, F.col("_text")).alias("score"))
    return scored.select(
        F.col("_id").alias(id_col), (labelled.fold(F.col("_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
