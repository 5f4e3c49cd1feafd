"""Stream segmentation: sliding windows, utterances by energy, transcript joining, speakers.

Each operator is one plain state object. The batch twin folds a stream's ordered rows through it; the streaming twin
carries the object's fields as state from batch to batch, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from verselake.functions import signal as S
from verselake.functions import text as T
from verselake.operators.folds import ordered_fold
from verselake.operators.speakers import Clustered
from verselake.streaming.folds import IDLE, folded_stream

WINDOW_SCHEMA = "stream_id string, idx int, start_seconds double, end_seconds double, rms double, kind string, samples binary"
#: Part of a segment, counted from its start, in which a forced split looks for a quiet place.
SPLIT_FROM, SPLIT_TO = 0.75, 0.98


@dataclass
class SlidingWindows:
    """Full windows of ``seconds`` that overlap by ``overlap``; what is shorter at the end is dropped."""

    rate: int = 16_000
    seconds: float = 2.0
    overlap: float = 0.5
    held: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    at: int = 0
    count: int = 0

    def feed(self, samples: np.ndarray) -> Iterator[dict]:
        size = round(self.rate * self.seconds)
        step = max(1, size - round(self.rate * self.overlap))
        self.held = np.concatenate([self.held, samples])
        while len(self.held) >= size:
            part = self.held[:size]
            yield _window(self.count, self.at, part, self.rate, "window")
            self.held, self.at, self.count = self.held[step:], self.at + step, self.count + 1

    def finish(self) -> Iterator[dict]:
        self.held = self.held[:0]
        return iter(())


@dataclass
class Utterances:
    """Speech segments: energy opens them (with what was just before), silence closes them, and one that grows too long is
    cut at a quiet place, its rest opening the next."""

    rate: int = 16_000
    frame: float = 0.1
    pre_roll: float = 0.3
    end_silence: float = 0.7
    longest: float = 12.0
    threshold: float = 0.008
    held: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    before: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    segment: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    start: int = 0
    at: int = 0
    quiet: int = 0
    count: int = 0
    loud: bool = False

    def feed(self, samples: np.ndarray) -> Iterator[dict]:
        size = max(1, round(self.rate * self.frame))
        self.held = np.concatenate([self.held, samples])
        while len(self.held) >= size:
            frame, self.held = self.held[:size], self.held[size:]
            yield from self._frame(frame)

    def finish(self) -> Iterator[dict]:
        """Also closes what is open after the last, shorter frame has closed a segment of its own."""
        if len(self.held):
            frame, self.held = self.held, self.held[:0]
            yield from self._frame(frame)
        if len(self.segment):
            yield self._close(keep_tail=False)

    def _frame(self, frame: np.ndarray) -> Iterator[dict]:
        value = S.rms(frame)
        self.loud = value >= self.threshold or (self.loud and value >= self.threshold / 2)
        lead = round(self.pre_roll / self.frame) * max(1, round(self.rate * self.frame))
        if self.loud and not len(self.segment):
            self.segment, self.start = self.before, max(0, self.at - len(self.before))
        if self.loud or len(self.segment):
            self.segment = np.concatenate([self.segment, frame])
            self.quiet = 0 if self.loud else self.quiet + 1
        else:
            self.before = np.concatenate([self.before, frame])[-lead:] if lead else self.before[:0]
        self.at += len(frame)
        if len(self.segment) and self.quiet >= max(1, round(self.end_silence / self.frame)):
            yield self._close(keep_tail=True)
        elif len(self.segment) >= round(self.rate * self.longest):
            yield self._split()

    def _close(self, keep_tail: bool) -> dict:
        out = _window(self.count, self.start, self.segment, self.rate, "utterance")
        lead = round(self.pre_roll / self.frame) * max(1, round(self.rate * self.frame))
        self.before = self.segment[-lead:] if keep_tail and lead else self.segment[:0]
        self.segment, self.quiet, self.count = self.segment[:0], 0, self.count + 1
        return out

    def _split(self) -> dict:
        cut = self._quiet_place()
        if not 0 < cut < len(self.segment):
            return self._close(keep_tail=True)
        out = _window(self.count, self.start, self.segment[:cut], self.rate, "utterance")
        self.segment, self.start, self.quiet, self.count = self.segment[cut:], self.start + cut, 0, self.count + 1
        return out

    def _quiet_place(self) -> int:
        """The last quiet probe near the end, else the quietest."""
        n, size = len(self.segment), max(1, round(self.rate * self.frame))
        if n < 4 * size:
            return n
        probe = max(1, size // 4)
        places = np.arange(int(n * SPLIT_FROM), int(n * SPLIT_TO) + 1, max(1, probe // 2))
        values = np.array([S.rms(self.segment[p : p + probe]) for p in places])
        calm = np.flatnonzero(values <= max(1.5 * self.threshold, 0.5 * S.rms(self.segment)))
        return int(places[calm[-1] if len(calm) else np.argmin(values)]) + probe // 2


@dataclass
class Transcript:
    """Text that each recognised segment adds: windows overlap and lose what is known already; utterances lose at most a
    few characters, and only where they begin before the last one ended."""

    text: str = ""
    last_end: float | None = None
    boundary: int = 6
    #: Characters of the end that are kept to compare with; a context longer than that needs more.
    keep: int = 4000

    def add(self, kind: str, start: float, end: float, text: str) -> str:
        overlapped = self.last_end is not None and start < self.last_end - 1e-3
        cap = None if kind != "utterance" else self.boundary if overlapped else 0
        new = T.novel_part(self.text, text or "", cap)
        self.text, self.last_end = (self.text + new)[-self.keep :], end
        return new


def _window(index: int, start: int, samples: np.ndarray, rate: int, kind: str) -> dict:
    return {
        "idx": index,
        "start_seconds": start / rate,
        "end_seconds": (start + len(samples)) / rate,
        "rms": S.rms(samples),
        "kind": kind,
        "samples": S.float_to_pcm16(samples),
    }


_WINDOWS = WINDOW_SCHEMA.split(", ", 1)[1]
_FIELDS = [c.split()[0] for c in _WINDOWS.split(", ")]


class Segmented:
    """A segmenter as a fold over rows (kind, payload); a stop row ends what is open."""

    def __init__(self, make):
        self.segmenter = make()

    def add(self, kind, payload):
        found = self.segmenter.feed(S.pcm16_to_float(payload)) if kind == "audio" else self.segmenter.finish() if kind == "stop" else ()
        return [tuple(w[c] for c in _FIELDS) for w in found]

    def finish(self):
        return [tuple(w[c] for c in _FIELDS) for w in self.segmenter.finish()]


class _Stopped(Segmented):
    """In a batch only a stop row ends a stream."""

    def finish(self):
        return ()


def segment_batch(stream: DataFrame, make) -> DataFrame:
    """Windows of whole streams (stream_id, seq, kind, payload); ``make`` builds the state object."""
    return ordered_fold(stream, ["stream_id"], ["seq"], ["kind", "payload"], partial(_Stopped, make), _WINDOWS)


def segment_stream(stream: DataFrame, make, idle: float | None = IDLE) -> DataFrame:
    """The same over a streaming DataFrame; the object is the state of its stream and goes at its stop row, or, flushed, after
    ``idle`` seconds without a row (see ``folds.IDLE``)."""
    return folded_stream(stream, ["stream_id"], ["seq"], ["kind", "payload"], partial(Segmented, make), _WINDOWS, lambda kind, payload: kind == "stop", idle)


JOINED_SCHEMA = "stream_id string, idx long, novel string"
_TEXTS = ["idx", "kind", "start_seconds", "end_seconds", "text"]


class Joined:
    """A transcript as a fold over recognised texts."""

    def __init__(self):
        self.transcript = Transcript()

    def add(self, idx, kind, start, end, text):
        return ((idx, self.transcript.add(kind, start, end, text)),)

    def finish(self):
        return ()


def join_batch(texts: DataFrame) -> DataFrame:
    """What each recognised text (stream_id, idx, kind, start_seconds, end_seconds, text) adds to its stream's transcript."""
    return ordered_fold(texts, ["stream_id"], ["idx"], _TEXTS, Joined, "idx long, novel string")


def join_stream(texts: DataFrame, idle: float | None = IDLE) -> DataFrame:
    return folded_stream(texts, ["stream_id"], ["idx"], _TEXTS, Joined, "idx long, novel string", None, idle)


SPEAKER_SCHEMA = "session string, seq long, speaker int"


def speakers_stream(vectors: DataFrame, most: int = 6, threshold: float = 0.75, idle: float | None = IDLE) -> DataFrame:
    """Online clustering of a stream of vectors (session, seq, vec)."""
    return folded_stream(vectors, ["session"], ["seq"], ["seq", "vec"], partial(Clustered, most, threshold), "seq long, speaker int", None, idle)
