"""Speech detection by a model with memory, over batches and streams.

A detector model takes chunks of fixed length, each with the last samples of the one before, and hands on a memory of its own.
Rows of a stream are cut anywhere, so what is left over after the last whole chunk, the context, the memory and the latch are the
state of the stream: any cut into rows and batches gives the same chunks and so the same flags. A model that fails once
is given up for its stream, whose loudness decides from then on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from verselake.functions import signal
from verselake.operators.folds import ordered_fold
from verselake.streaming.folds import IDLE, folded_stream

#: Samples of a chunk and of the context before it.
CHUNK, CONTEXT = 512, 64
FLAGS = "chunk long, speech boolean, probability double, degraded boolean"
Model = Callable[[np.ndarray, object], tuple[float, object]]


class ChunkDetector:
    """A fold over rows (kind, payload) of 16-bit samples; what is shorter than a chunk at the end has no flag."""

    def __init__(self, model: Model | None = None, on: float = 0.5, off: float = 0.35, rms_on: float = 0.01, rms_off: float = 0.006):
        self.model, self.limits, self.loud = model, (on, off), (rms_on, rms_off)
        self.rest = np.zeros(0, np.float32)
        self.context, self.memory = np.zeros(CONTEXT, np.float32), None
        self.chunks, self.active, self.degraded = 0, False, model is None

    def __getstate__(self):
        # The model travels with the query; a stream keeps what the model remembers.
        return {k: v for k, v in self.__dict__.items() if k != "model"}

    def _heard(self, chunk: np.ndarray) -> float | None:
        if self.degraded:
            return None
        try:
            probability, self.memory = self.model(np.concatenate([self.context, chunk]), self.memory)
            return float(probability)
        except Exception:
            self.degraded = True
            return None

    def add(self, kind, payload):
        if kind != "audio":
            return
        x = np.concatenate([self.rest, signal.pcm16_to_float(payload)])
        whole = len(x) // CHUNK * CHUNK
        self.rest = x[whole:]
        for chunk in x[:whole].reshape(-1, CHUNK):
            probability = self._heard(chunk)
            value, (on, off) = (signal.rms(chunk), self.loud) if probability is None else (probability, self.limits)
            self.active = value >= on or (self.active and value >= off)
            self.context = chunk[-CONTEXT:]
            yield self.chunks, self.active, probability, self.degraded
            self.chunks += 1

    def finish(self):
        return ()


def detect_batch(stream: DataFrame, model: Model | None = None, **limits) -> DataFrame:
    """(stream_id, chunk, speech, probability, degraded) of whole streams (stream_id, seq, kind, payload)."""
    return ordered_fold(stream, ["stream_id"], ["seq"], ["kind", "payload"], partial(ChunkDetector, model, **limits), FLAGS)


def detect_stream(stream: DataFrame, model: Model | None = None, idle: float | None = IDLE, **limits) -> DataFrame:
    """The same over a streaming DataFrame."""

    def bind(detector: ChunkDetector) -> None:
        detector.model = model

    make, ends = partial(ChunkDetector, model, **limits), lambda kind, payload: kind == "stop"
    return folded_stream(stream, ["stream_id"], ["seq"], ["kind", "payload"], make, FLAGS, ends, idle, bind)
