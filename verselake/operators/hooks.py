"""Hooks for models: a plain function becomes a column, with the rule for what happens where there is no model.

Each hook takes the model as a function of one row's values (or, with ``batched``, of lists of them for up to BATCH rows, which
gives a list), or None. The function travels to the Python workers once, rows come in Arrow batches. What a failure does is up
to ``errors``: "keep" gives the row what a missing model gives, so one bad clip can't end a job; "report" gives a struct
(value, error), so failures are rows to count; "raise" ends the job. A batch that fails is asked again row by row, so
that only the bad rows fail.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verselake.functions import signal
from verselake.operators.folds import ordered_fold


#: Rows that a batched model gets at once.
BATCH = 32


def _outcomes(model: Callable | None, fallback: Callable, rows: list[tuple], errors: str, batched: bool) -> list[tuple]:
    """(value, error) of each row."""

    def alone(values: tuple) -> tuple:
        try:
            return (list(model(*([v] for v in values)))[0] if batched else model(*values)), None
        except Exception as e:
            if errors == "raise":
                raise
            return fallback(*values), f"{type(e).__name__}: {e}"

    if model is None:
        return [(fallback(*values), None) for values in rows]
    if not batched:
        return [alone(values) for values in rows]
    out: list[tuple] = []
    for i in range(0, len(rows), BATCH):
        some = rows[i : i + BATCH]
        try:
            found = list(model(*map(list, zip(*some))))
            if len(found) != len(some):
                raise ValueError(f"{len(found)} results for {len(some)} rows")
            out += [(v, None) for v in found]
        except Exception:
            out += [alone(values) for values in some]
    return out


def applied(model: Callable | None, kind: str, fallback: Callable, *inputs: Column, errors: str = "keep", batched: bool = False) -> Column:
    """A model over one or two columns; see the module for ``errors`` and ``batched``."""
    if errors not in ("keep", "report", "raise"):
        raise ValueError(f"errors is keep, report or raise, not {errors}")
    reported = errors == "report"
    full = f"struct<value:{kind},error:string>" if reported else kind

    def column(*series: pd.Series):
        found = _outcomes(model, fallback, list(zip(*series)), errors, batched)
        if not reported:
            return pd.Series([v for v, _ in found], dtype=object)
        return pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    if len(inputs) == 1:

        def run1(a):
            return column(a)

        run1.__annotations__ = {"a": pd.Series, "return": pd.DataFrame if reported else pd.Series}
        return pandas_udf(run1, full)(*inputs)

    def run2(a, b):
        return column(a, b)

    run2.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame if reported else pd.Series}
    return pandas_udf(run2, full)(*inputs)


def recognise(samples: Column, context: Column, model: Callable | None, errors: str = "keep", batched: bool = True) -> Column:
    """Text of each window given what came before it; empty without a model."""

    def arrays(x, c):
        return model([np.asarray(v if v is not None else [], np.float32) for v in x], c) if batched else model(np.asarray(x if x is not None else [], np.float32), c)

    return applied(arrays if model else None, "string", lambda x, c: "", samples, context, errors=errors, batched=batched)


def embed(samples: Column, model: Callable[[np.ndarray], Sequence[float]] | None, errors: str = "keep") -> Column:
    """Voice vector of an array of samples; null without a model, where it fails, or where a value isn't finite."""

    def checked(x):
        v = np.asarray(model(np.asarray(x, np.float32)), float).ravel()
        return v.tolist() if v.size and np.isfinite(v).all() else None

    return applied(checked if model else None, "array<double>", lambda x: None, samples, errors=errors)


def translate(text: Column, source: Column, target: str, model: Callable | None, errors: str = "keep", batched: bool = False) -> Column:
    """Translation of each text; empty without a model, where it fails, and between equal languages."""
    same = F.lower(F.trim(source)) == target.strip().lower()
    needless = F.coalesce(same, F.lit(False)) | (F.trim(F.coalesce(text, F.lit(""))) == "")
    done = applied(model, "string", lambda t, s: "", text, source, errors=errors, batched=batched)
    nothing = F.struct(F.lit("").alias("value"), F.lit(None).cast("string").alias("error")) if errors == "report" else F.lit("")
    return F.when(needless, nothing).otherwise(done)


def enhance(samples: Column, model: Callable[[np.ndarray], np.ndarray] | None, errors: str = "keep") -> Column:
    """Cleaned samples; the samples themselves without a model, where it fails, or where it changes their number."""

    def checked(x):
        out = np.asarray(model(np.asarray(x, np.float32)), np.float32)
        return out.tolist() if out.shape == np.shape(x) and np.isfinite(out).all() else list(x)

    return applied(checked if model else None, "array<float>", lambda x: None if x is None else list(x), samples, errors=errors)


def forced_spans(samples: Column, lines: Column, model: Callable | None, errors: str = "keep") -> Column:
    """Spans (start, end) of each line of a song; null, so that the song is skipped, without a model or where the number of
    spans isn't that of the lines."""

    def checked(x, l):
        spans = [(float(a), float(b)) for a, b in model(np.asarray(x, np.float32), list(l))]
        return [{"start": a, "end": b} for a, b in spans] if len(spans) == len(l) else None

    return applied(checked if model else None, "array<struct<start:double,end:double>>", lambda x, l: None, samples, lines, errors=errors)


def voice_engine(samples: Column, voice: Column, model: Callable | None, errors: str = "keep") -> Column:
    """Samples in another voice; without a model the input, at half its level so that it can't be taken for a result."""
    return applied(model, "array<float>", lambda x, v: None if x is None else (np.asarray(x, np.float32) * 0.5).tolist(), samples, voice, errors=errors)


class Detection:
    """Speech or not, frame by frame of a stream: the model's probability latched between two thresholds, or the frame's RMS
    where there is no model, in the samples' single precision; a frame whose loudness is unknown leaves the latch as it is.
    What the model carries from chunk to chunk goes through it as ``memory``."""

    def __init__(self, model: Callable | None = None, on: float = 0.5, off: float = 0.35, rms_on: float = 0.01, rms_off: float = 0.006):
        self.model, self.limits = model, (on, off) if model else (np.float32(rms_on), np.float32(rms_off))
        self.memory, self.active = None, False

    def speech(self, samples: np.ndarray) -> bool:
        if self.model is None:
            value = np.float32(signal.rms(samples))
            if np.isnan(value):
                return self.active
        else:
            value, self.memory = self.model(samples, self.memory)
        on, off = self.limits
        self.active = bool(value >= on or (self.active and value >= off))
        return self.active

    def add(self, seq, samples):
        return ((seq, self.speech(np.asarray(samples if samples is not None else [], np.float32))),)

    def finish(self):
        return ()


def detect_speech(frames: DataFrame, stream: str, seq: str, samples: str, model: Callable | None = None, **limits) -> DataFrame:
    """(stream, seq, speech) of frames in order, one detector for each stream."""
    return ordered_fold(frames, [stream], [seq], [seq, samples], partial(Detection, model, **limits), f"`{seq}` {frames.schema[seq].dataType.simpleString()}, speech boolean")


def best_language(probs: Column, allowed: Sequence[str]) -> Column:
    """The likeliest of the allowed languages in an array of (code, prob), likeliest first; the first allowed one where none is."""
    hit = F.get(F.filter(probs, lambda p: p["code"].isin(*allowed)), 0)
    return F.coalesce(hit["code"], F.lit(allowed[0]))
