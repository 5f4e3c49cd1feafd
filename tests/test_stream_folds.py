"""Streams in event time, detectors with memory, and live events of failing models."""

import random
from functools import partial

import numpy as np
import pytest

from verselake.functions import signal as S
from verselake.streaming import detector, folds, live
from verselake.streaming.segmenter import Utterances


def running():
    """A fold of its own, as a caller would write it: running count and a text of what was seen, so that order shows."""

    class Running:
        def __init__(self):
            self.n, self.seen = 0, ""

        def add(self, name, value):
            self.n, self.seen = self.n + 1, (self.seen + str(name))[-12:]
            return ((self.n, self.seen),)

        def finish(self):
            return ((-self.n, self.seen),)

    return Running


SCHEMA = "key string, at timestamp, id long, name string, value double"


def run_stream(spark, tmp_path, batches, schema, build, one_file=True):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = build(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(sink).collect(), query


def test_event_time_gives_the_batch_result(spark, tmp_path):
    from datetime import datetime, timedelta

    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=i // 2), i, chr(97 + i % 26), float(i)) for k in "ab" for i in range(60)]
    # Shuffled by at most half the delay of 20 s.
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 18))
    cuts = [shuffled[i : i + 30] for i in range(0, len(shuffled), 30)]
    late = [("a", start + timedelta(seconds=1), 900, "!", 0.0), ("a", start + timedelta(seconds=2), 901, "!", 0.0), ("b", start, 902, "!", 0.0)]
    # Another key's far event moves the watermark past all others, a further run fires their timers.
    ahead = [[("z", start + timedelta(seconds=1000 * n), n, "z", 0.0)] for n in (1, 2, 3)]
    args = (["key"], "at", ["id"], ["name", "value"], running(), "n int, seen string")
    build = lambda df: folds.in_event_time(df, *args, delay=20, bound=200)
    got, query = run_stream(spark, tmp_path, [*cuts, late, *ahead], SCHEMA, build)
    want = folds.event_time_batch(spark.createDataFrame(rows, SCHEMA), *args).collect()
    assert sorted((r.key, r.n, r.seen) for r in got if not r.late and r.key != "z") == sorted((r.key, r.n, r.seen) for r in want)
    assert sorted((r.key, r.late_name, r.late_count) for r in got if r.late) == [("a", "!", 1), ("a", "!", 2), ("b", "!", 1)]
    assert {r.n for r in got if r.key == "a" and not r.late} == {*range(1, 61), -60}
    assert folds.dropped_rows(query) == 0
    with pytest.raises(ValueError):
        folds.in_event_time(spark.createDataFrame(rows, SCHEMA), *args, delay=20, bound=10)


def stand_ins():
    """A model with a memory of its own that also needs its context, and one that fails at its sixth chunk."""
    context = detector.CONTEXT

    def remembering(chunk, memory):
        memory = 0.7 * (memory or 0.0) + float(np.abs(chunk).mean())
        return min(1.0, 4 * memory + 0.01 * float(np.abs(chunk[:context]).max())), memory

    def failing(chunk, memory):
        if memory == 5:
            raise RuntimeError("gone")
        return 0.9, (memory or 0) + 1

    return remembering, failing


def sound(seed):
    rng = np.random.default_rng(seed)
    shape = np.repeat(rng.choice([0.0, 0.005, 0.05, 0.3], 40), 397)
    return (rng.normal(0, 1, len(shape)) * shape).clip(-1, 1).astype(np.float32)


def cut_rows(x, rng, stream="s"):
    rows, i = [], 0
    while i < len(x):
        n = rng.randint(1, 1500)
        rows.append((stream, len(rows), "audio", bytearray(S.float_to_pcm16(x[i : i + n]))))
        i += n
    return rows


def test_any_cut_gives_the_same_flags(spark, tmp_path):
    schema, x = "stream_id string, seq long, kind string, payload binary", sound(1)
    remembering, failing = stand_ins()
    flags = lambda rows: sorted((r.stream_id, r.chunk, r.speech, r.probability, r.degraded) for r in rows)
    samples = S.pcm16_to_float(S.float_to_pcm16(x))
    memory, active, want, before = None, False, [], np.zeros(64, np.float32)
    for c in range(len(samples) // 512):
        chunk = samples[c * 512 : c * 512 + 512]
        p, memory = remembering(np.concatenate([before, chunk]), memory)
        active, before = p >= 0.5 or (active and p >= 0.35), chunk[-64:]
        want.append(("s", c, active, p, False))
    assert {w[2] for w in want} == {True, False}
    for seed in (1, 2):
        rows = cut_rows(x, random.Random(seed))
        assert flags(detector.detect_batch(spark.createDataFrame(rows, schema), remembering).collect()) == want
    rows = [*cut_rows(x, random.Random(5)), ("s", 999, "stop", None)]
    batches = [rows[:3], rows[3:4], rows[4:]]
    got, _ = run_stream(spark, tmp_path, batches, schema, lambda df: detector.detect_stream(df, remembering, idle=None))
    assert flags(got) == want
    broken = detector.detect_batch(spark.createDataFrame(rows, schema), failing).collect()
    loud = {r.chunk: (r.speech, r.probability, r.degraded) for r in broken}
    assert all(loud[c] == (True, 0.9, False) for c in range(5)) and all(loud[c][1] is None and loud[c][2] for c in range(5, len(loud)))
    assert {loud[c][0] for c in range(5, len(loud))} == {True, False}


def test_live_events_of_failing_models():
    x = np.concatenate([S.sine(1000, 1.5, 100, 0.3), np.zeros(1200, np.float32)] * 3)

    def recognise(samples, context):
        recognise.calls += 1
        if recognise.calls == 2:
            raise RuntimeError("no words")
        return f"line {recognise.calls}", 0.0

    recognise.calls = 0
    models = live.Models(recognise, embed=lambda s: 1 / 0, translate=str.upper)
    fold = live.Lived(partial(live.Session, Utterances(1000)), models)
    out = [e for i in range(0, len(x), 333) for e in fold.add("audio", S.float_to_pcm16(x[i : i + 333]))] + list(fold.finish())
    kinds = [e[1] for e in out]
    assert kinds == ["ready", "partial", "final", "error", "error", "partial", "final", "error", "stats"]
    assert [e[4] for e in out if e[1] == "error"] == ["embed: division by zero", "recognise: no words", "embed: division by zero"]
    finals = [e for e in out if e[1] == "final"]
    assert [e[5] for e in finals] == ["LINE 1", " LINE 3"] or [e[5].strip() for e in finals] == ["LINE 1", "LINE 3"]
    assert all(e[6] is None and abs(e[7] - 100) < 2 for e in finals) and out[-1][4] == "3 windows, 1 dropped, 3 failures"
