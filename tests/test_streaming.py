import random
from functools import partial

import numpy as np

from verselake.functions import signal as S
from verselake.functions import text as T
from verselake.sources import files, sinks
from verselake.streaming import control, live
from verselake.streaming.segmenter import SlidingWindows, Transcript, Utterances, segment_batch, segment_stream

RATE = 1000


def speech(pattern):
    """0.1 s frames: 1 loud, 0 silent."""
    return np.concatenate([np.full(100, 0.1 if c == "1" else 0.0, np.float32) for c in pattern])


def cut(segmenter, samples, rng):
    out, i = [], 0
    while i < len(samples):
        n = rng.randint(1, 350)
        out += segmenter.feed(samples[i : i + n])
        i += n
    return out + list(segmenter.finish())


def test_windows_full_only():
    out = cut(SlidingWindows(RATE), np.zeros(5200, np.float32), random.Random(1))
    assert [(w["start_seconds"], w["end_seconds"]) for w in out] == [(0.0, 2.0), (1.5, 3.5), (3.0, 5.0)]


def test_utterances():
    u = Utterances(RATE)
    out = cut(u, speech("000011110000000000111" + "0" * 3), random.Random(2))
    assert [(round(w["start_seconds"], 3), round(w["end_seconds"], 3)) for w in out] == [(0.1, 1.5), (1.5, 2.4)]
    long = cut(Utterances(RATE, longest=2.0), speech("1" * 17 + "0" + "1" * 32), random.Random(3))
    assert sum(len(w["samples"]) for w in long) == 2 * 5000
    assert all(a["end_seconds"] == b["start_seconds"] for a, b in zip(long, long[1:])) and all(w["end_seconds"] - w["start_seconds"] <= 2.0 for w in long)


def test_stream_equals_batch(spark, tmp_path):
    rng, schema = random.Random(4), "stream_id string, seq long, kind string, payload binary"
    rows = []
    for s in ("a", "b"):
        x = speech("".join(rng.choice("0011111") * rng.randint(1, 9) for _ in range(30)))
        parts = [x[i : i + 170] for i in range(0, len(x), 170)]
        rows += [(s, k, "audio", bytearray(S.float_to_pcm16(p))) for k, p in enumerate(parts)] + [(s, len(parts), "stop", None)]
    df = spark.createDataFrame(rows, schema)
    make = partial(Utterances, RATE, longest=3.0)
    want = sorted((r.stream_id, r.idx, r.start_seconds, r.end_seconds) for r in segment_batch(df, make).collect())
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    halves = [df.filter("seq < 9"), df.filter("seq >= 9")]
    halves[0].coalesce(1).write.mode("append").parquet(source)
    for half in (None, halves[1]):
        if half is not None:
            half.coalesce(1).write.mode("append").parquet(source)
        stream = segment_stream(spark.readStream.schema(schema).parquet(source), make, idle=None)
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.stream_id, r.idx, r.start_seconds, r.end_seconds) for r in spark.read.parquet(sink).collect())
    assert want and got == want


def live_rows():
    rng, rows = random.Random(6), []
    for s in ("a", "b", "open"):
        x = speech("".join(rng.choice("0011111") * rng.randint(1, 9) for _ in range(30)))
        parts = [x[i : i + 170] for i in range(0, len(x), 170)]
        rows += [(s, k, "audio", bytearray(S.float_to_pcm16(p))) for k, p in enumerate(parts)]
        rows += [(s, len(parts), "stop", None)] if s != "open" else []
    return rows, "stream_id string, seq long, kind string, payload binary"


def test_live_stream_equals_batch(spark, tmp_path):
    rows, schema = live_rows()
    df = spark.createDataFrame(rows, schema)
    make = partial(live.Session, Utterances(RATE, longest=3.0), (("welcome", "WELCOME"),))
    words = ["good morning everyone", "morning everyone and welcome", "字幕由 X 社群提供", "to the show", ""]

    def stand_in(samples, context):
        """Text by the length of the window, so that batch and stream must cut alike."""
        return words[len(samples) // 100 % len(words)], 0.1

    models = live.Models(stand_in, enhance=lambda x: x, embed=lambda x: [1.0, float(len(x) % 200 > 99)], translate=str.upper)
    row = lambda r: tuple(r)
    whole = sorted(map(row, live.live_batch(df, make, models).collect()), key=str)
    kinds = {r[2] for r in whole}
    assert kinds == {"ready", "partial", "final", "stats"} and not any("社群" in r[5] for r in whole) and any("WELCOME" in r[5] for r in whole)
    assert all(r[6] == r[5].upper() and r[7] in (0, 1) for r in whole if r[2] == "final")
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (df.filter("seq < 9"), df.filter("seq >= 9")):
        part.coalesce(1).write.mode("append").parquet(source)
        out = live.live_stream(spark.readStream.schema(schema).parquet(source), make, models, idle=None)
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted(map(row, spark.read.parquet(sink).collect()), key=str)
    ended = lambda all_rows: [r for r in all_rows if r[0] != "open"]
    assert ended(got) == ended(whole) and {r[2] for r in got if r[0] == "open"} <= {"ready", "partial", "final"}


def test_idle_streams_are_flushed(spark, tmp_path):
    """A stream without a stop row is closed by the clock, and its state goes."""
    rows, schema = live_rows()
    only = [r for r in rows if r[0] == "open"]
    make = partial(live.Session, Utterances(RATE, longest=3.0))
    want = sorted(map(str, live.live_batch(spark.createDataFrame(only, schema), make).collect()))
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(only, schema).coalesce(1).write.parquet(source)
    out = live.live_stream(spark.readStream.schema(schema).parquet(source), make, idle=0.5)
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="1 second").start()
    for _ in range(60):
        query.awaitTermination(1)
        got = sorted(map(str, spark.read.schema(live.EVENT_SCHEMA).parquet(sink).collect())) if (tmp_path / "out").exists() else []
        if got == want:
            break
    query.stop()
    assert got == want and any("stats" in r for r in got)


def test_gate_of_one_text(spark):
    texts = ["字幕由 X 社群提供", "歡迎訂閱，按讚分享！", "hello", ""]
    cases = [(t, p, r) for t in texts for p in (None, 0.2, 0.9) for r in (None, 0.001, 0.5)]
    df = spark.createDataFrame(cases, "t string, p double, r double")
    got = [x[0] for x in df.select(T.should_drop("t", "p", "r", 0.6, 0.008)).collect()]
    assert got == [T.drops(t, p, r, 0.6, 0.008) for t, p, r in cases]


def test_transcript_policies():
    t = Transcript()
    assert t.add("window", 0, 2, "我們今天") == "我們今天" and t.add("window", 1.5, 3.5, "今天很好") == "很好"
    assert t.add("utterance", 4, 5, "很好") == " 很好" and t.add("utterance", 4.9, 6, "很好吃") == "吃"


def test_control(spark):
    rows = ['{"type":"start","sampleRate":16000,"languages":["EN","en "],"glossary":[{"from":"a","to":"b"},{"from":"x","to":"x"}]}', '{"type":"start"}', '{"type":"what"}', "no"]
    out = control.parse(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, control string")).orderBy("i").collect()
    assert [r.error for r in out] == [None, "bad sample rate", "unknown type", "not a message"]
    assert out[0].languages == ["en"] and len(out[0].glossary) == 1


def test_signal():
    tone = S.sine(16000, 1.0, 220.0, 0.5)
    hz, confidence = S.yin_pitch(tone[:1600], 16000)
    assert abs(hz - 220) < 1 and confidence > 0.9
    assert abs(S.pitch_summary(tone, 16000)["median_hz"] - 220) < 1
    samples, rate = S.decode_wav(S.encode_wav(tone, 16000))
    assert rate == 16000 and np.abs(samples - tone).max() < 1e-3
    assert len(S.resample(tone, 16000, 8000)) == 8000 and S.pcm16_to_float(b"\0\0\1").size == 1
    clicks = np.zeros(16000 * 8, np.float32)
    clicks[::8000] = 1.0
    assert abs(S.tempo(S.onset_envelope(clicks, 16000), 100)["bpm"] - 120) < 4
    assert S.log_mel(tone, 16000).shape[1] == 80 and S.noise_floor(np.zeros(1000), 1000) == 0.0


def test_files(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.txt").write_text("\nfirst\nsecond")
    (d / "b.txt").write_text("other")
    (d / "a.json").write_text('{"blocks":[{"text":"x","characters":[{"char":"x","jianpu":"1"}]}]}')
    (d / "b.json").write_text("broken")
    (d / "b.wav").write_bytes(b"RIFF")
    got = {r.doc_id: r for r in files.transcripts(spark, str(d)).collect()}
    assert got["a"].title == "first" and got["a"].has_jianpu and not got["a"].has_audio and got["b"].has_audio and got["b"].blocks is None
    rows = spark.createDataFrame([("x.wav", 1), ("x.wav", 2), ("y.wav", 3)], "file_name string, n int")
    path = str(tmp_path / "corpus")
    assert sinks.append_new(rows, path).count() == 2 and sinks.append_new(rows, path).count() == 2
    (tmp_path / "p.csv").write_text('time_seconds,hz,intensity,text\n0.1,220,0.5,a\n\n0.2,,0.4,"b,c"\n')
    pitch = files.pitch_rows(spark, str(tmp_path / "p.csv")).orderBy("pos").collect()
    assert [(r.hz, r.text, r.after_blank) for r in pitch] == [(220.0, "a", False), (None, "b,c", True)]
