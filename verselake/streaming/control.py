"""Control messages of a stream, recognition by an injected model, and the events that go out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verselake.functions import text as T

CONTROL = (
    "type string, sampleRate int, language string, chunkMs int, mode string, languages array<string>, "
    "glossary array<struct<from:string,to:string>>, translate boolean, translateTarget string"
)
KINDS, MODES, MOST_LANGUAGES, MOST_TERMS, TERM_CHARS = ("start", "stop", "ping"), ("utterance", "window"), 4, 200, 80


def parse(rows: DataFrame, col: str = "control") -> DataFrame:
    """rows with (msg, error): unknown kinds, bad rates and text that isn't JSON become an error, never a failure."""
    msg = F.from_json(col, CONTROL, {"mode": "PERMISSIVE"})
    parsed = rows.withColumn("msg", msg)
    kind, rate = F.col("msg.type"), F.col("msg.sampleRate")
    error = (
        F.when(kind.isNull(), "not a message")
        .when(~kind.isin(*KINDS), "unknown type")
        .when((kind == "start") & (rate.isNull() | ~rate.between(8000, 192000)), "bad sample rate")
    )
    short = lambda p: (F.length(p["from"]) <= TERM_CHARS) & (F.length(p["to"]) <= TERM_CHARS)
    terms = F.filter("msg.glossary", lambda p: (F.trim(p["from"]) != "") & p["to"].isNotNull() & (p["from"] != p["to"]) & short(p))
    return parsed.withColumns(
        {"error": error, "languages": T.distinct_lower("msg.languages", MOST_LANGUAGES), "glossary": F.slice(terms, 1, MOST_TERMS)}
    )


def recognise(windows: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """windows with (text, no_speech_prob) from a batch function; without one a stand-in names each window."""

    def stand_in(frames):
        for f in frames:
            yield f.assign(
                text=[f"window {i} ({z - a:.1f} s)" for i, a, z in zip(f["idx"], f["start_seconds"], f["end_seconds"])], no_speech_prob=0.0
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)
    return windows.mapInPandas(model or stand_in, f"{fields}, text string, no_speech_prob double")


def gated(texts: DataFrame, glossary=(), no_speech_at: float = 0.6, rms_at: float = 0.008) -> DataFrame:
    """Recognised texts that the gate keeps, with learned terms replaced."""
    kept = texts.filter(~T.should_drop("text", "no_speech_prob", "rms", no_speech_at, rms_at))
    return kept.withColumn("text", T.replace_longest_first("text", glossary))


def events(joined: DataFrame) -> DataFrame:
    """One final event for each text that adds something."""
    return joined.filter(F.col("novel") != "").select(
        "stream_id", F.lit("final").alias("type"), F.to_json(F.struct("idx", F.col("novel").alias("text"))).alias("body")
    )


def transcribe(stream: DataFrame, make, model=None, glossary=()) -> DataFrame:
    """Whole streams to final events, in batch."""
    from verselake.streaming.segmenter import join_batch, segment_batch

    return events(join_batch(gated(recognise(segment_batch(stream, make), model), glossary)))
