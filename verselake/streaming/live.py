"""A live stream in one query: samples in, ready, partial, final, error and stats events out.

One state object holds what a stream carries: its segmenter, the transcript so far, its voices and its counts. Its first row
is answered by a ready event. Rows go through segmentation, enhancement, preparation, recognition, the gate and learned terms;
what is recognised goes out as a partial event, and what it adds to the transcript as a final one, with its translation, speaker
and pitch. A model that fails gives an error event with its stage and message, and the window goes on without what it
would have given. A stop row, or no row for ``idle`` seconds of processing time, ends a stream: what is open is flushed, a stats event
goes out, and the state is removed.
Rows of one stream must arrive in order of seq across batches; inside a batch they are sorted.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from verselake.functions import signal as S
from verselake.functions import text as T
from verselake.operators.folds import ordered_fold
from verselake.operators.speakers import OnlineClusters
from verselake.streaming.folds import IDLE, folded_stream
from verselake.streaming.segmenter import Transcript, Utterances

EVENT_SCHEMA = "stream_id string, idx int, type string, start_seconds double, end_seconds double, text string, translation string, speaker int, pitch_hz double"


@dataclass
class Models:
    """What a session calls: samples to (text, no_speech_prob), samples to samples, samples to a vector, text to text. A
    missing recogniser names each window; the others may be missing."""

    recognise: Callable[[np.ndarray, str], tuple[str, float | None]] | None = None
    enhance: Callable[[np.ndarray], np.ndarray] | None = None
    embed: Callable[[np.ndarray], Iterable[float]] | None = None
    translate: Callable[[str], str] | None = None


@dataclass
class Session:
    """State of one stream."""

    segmenter: object = field(default_factory=Utterances)
    glossary: tuple[tuple[str, str], ...] = ()
    no_speech_at: float = 0.6
    rms_at: float = 0.008
    context_chars: int = 0
    speaker_seconds: float = 0.5
    speaker_rms: float = 0.008
    #: Profile that samples are prepared by before they are recognised.
    profile: str = "off"
    transcript: Transcript = field(default_factory=Transcript)
    voices: OnlineClusters = field(default_factory=OnlineClusters)
    windows: int = 0
    dropped: int = 0
    failed: int = 0
    begun: bool = False

    def __post_init__(self):
        # One factory makes many sessions; each cuts on its own.
        self.segmenter = copy.deepcopy(self.segmenter)
        self.transcript.keep = max(self.transcript.keep, self.context_chars)

    def events(self, found: Iterable[dict], models: Models) -> Iterator[tuple]:
        for w in found:
            self.windows += 1
            place, errors = (w["idx"], w["start_seconds"], w["end_seconds"]), []

            def tried(stage: str, model: Callable, fallback, *values):
                try:
                    return model(*values)
                except Exception as e:
                    self.failed += 1
                    errors.append(_event(place, "error", f"{stage}: {e}"))
                    return fallback

            samples = heard = S.pcm16_to_float(w["samples"])
            if models.enhance:
                samples = np.asarray(tried("enhance", models.enhance, samples, samples), np.float32)
            samples = S.prepare(samples, self.segmenter.rate, self.profile)
            context = self.transcript.text[-self.context_chars :] if self.context_chars > 0 else ""
            seconds = w["end_seconds"] - w["start_seconds"]
            named = (f"window {w['idx']} ({seconds:.1f} s)", 0.0)
            text, silence = tried("recognise", models.recognise, ("", None), samples, context) if models.recognise else named
            text = (text or "").strip()
            if not text or T.drops(text, silence, w["rms"], self.no_speech_at, self.rms_at):
                self.dropped += 1
                yield from errors
                continue
            for old, new in sorted(self.glossary, key=lambda p: -len(p[0])):
                text = text.replace(old, new)
            yield _event(place, "partial", text)
            novel = self.transcript.add(w["kind"], w["start_seconds"], w["end_seconds"], text)
            if novel:
                speaker = None
                if models.embed and seconds >= self.speaker_seconds and w["rms"] >= self.speaker_rms:
                    vector = tried("embed", models.embed, None, samples)
                    speaker = None if vector is None else self.voices.assign(vector)
                translation = tried("translate", models.translate, None, novel) if models.translate else None
                yield _event(place, "final", novel, translation, speaker, S.pitch_summary(heard, self.segmenter.rate)["median_hz"])
            yield from errors

    def take(self, rows: Iterable[tuple[str, bytes]], models: Models) -> tuple[list[tuple], bool]:
        """Events of (kind, payload) rows in order, and whether the stream has ended."""
        out: list[tuple] = []
        for kind, payload in rows:
            if not self.begun:
                self.begun = True
                out.append(_event((None, None, None), "ready", ""))
            if kind == "audio":
                out += self.events(self.segmenter.feed(S.pcm16_to_float(payload)), models)
            elif kind == "stop":
                return out + self.close(models), True
        return out, False

    def close(self, models: Models) -> list[tuple]:
        out = [*self.events(self.segmenter.finish(), models)]
        return [*out, _event((self.windows, None, None), "stats", f"{self.windows} windows, {self.dropped} dropped, {self.failed} failures")]


def _event(place, kind: str, text: str, translation: str | None = None, speaker: int | None = None, pitch: float | None = None) -> tuple:
    return (place[0], kind, place[1], place[2], text, translation, speaker, pitch)


class Lived:
    """A session as a fold over rows (kind, payload): what comes after a stop row is no part of it."""

    def __init__(self, make: Callable[[], Session], models: Models):
        self.session, self.models, self.ended = make(), models, False

    def __getstate__(self):
        return {"session": self.session, "ended": self.ended}

    def add(self, kind, payload):
        if self.ended:
            return ()
        events, self.ended = self.session.take([(kind, payload)], self.models)
        return events

    def finish(self):
        return () if self.ended else self.session.close(self.models)


_EVENTS = EVENT_SCHEMA.split(", ", 1)[1]
_ROW = (["stream_id"], ["seq"], ["kind", "payload"])


def live_batch(stream: DataFrame, make: Callable[[], Session], models: Models | None = None) -> DataFrame:
    """Events of whole streams (stream_id, seq, kind, payload); a stream without a stop row ends with its last row."""
    return ordered_fold(stream, *_ROW, partial(Lived, make, models or Models()), _EVENTS)


def live_stream(stream: DataFrame, make: Callable[[], Session], models: Models | None = None, idle: float | None = IDLE) -> DataFrame:
    """The same over a streaming DataFrame. The models travel with the query, the session is the state."""
    used = models or Models()

    def bind(lived: Lived) -> None:
        lived.models = used

    return folded_stream(stream, *_ROW, partial(Lived, make, used), _EVENTS, lambda kind, payload: kind == "stop", idle, bind)
