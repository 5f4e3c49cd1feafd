import wave

import numpy as np
import pytest

from verselake.functions import signal as S
from verselake.operators import ingest, sound
from verselake.sources import wav


def save(path, x, rate, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = np.round(np.clip(x, -1, 1) * 32767).astype("<i2")
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(data.tobytes())


def clip_of(folder, name):
    with wave.open(f"{folder}/clips/{name}.wav") as f:
        return np.frombuffer(f.readframes(f.getnframes()), "<i2") / 32767, f.getframerate()


RATE = 4000


def test_local_songs_with_resume(spark, tmp_path):
    rng = np.random.default_rng(1)
    songs = {"one song": rng.normal(0, 0.1, 60 * RATE), "two": rng.normal(0, 0.1, 40 * 2 * RATE), "hush": np.zeros(20 * RATE)}
    for name, x in songs.items():
        save(tmp_path / "audio" / f"{name}.wav", x, 2 * RATE if name == "two" else RATE)
    (tmp_path / "lyrics").mkdir()
    lrc = "[ti:x]\n" + "\n".join(f"[00:{s:05.2f}]{t}" for s, t in ((5, "Hello (x2) there"), (5.6, "my friend"), (9, ""), (20, "  "), (30, "the end"), (33, "")))
    for name in songs:
        (tmp_path / "lyrics" / f"{name}.lrc").write_text(lrc)
    (tmp_path / "lyrics" / "plain.txt").write_text("no stamps\nhere")
    rules = ingest.Rules(rate=RATE, negative_share=0.4)
    corpus = ingest.Corpus(spark, str(tmp_path / "corpus"), rules)
    found, lines = ingest.local_songs(spark, str(tmp_path / "lyrics"), "en", rules)
    assert {r.song_id for r in found.collect()} == set(songs)
    audio = ingest.heard(spark, str(tmp_path / "audio"), RATE)
    asked = []

    def listened(some):
        asked.append({r.song_id for r in some.collect()})
        return audio(some)

    first = corpus.ingest(found.filter("song_id = 'one song'"), listened, lines, "batch 1")
    rows = {r.clip: r for r in corpus.metadata().collect()}
    # A line under a second takes the next one; the gate keeps both chunks; of the gaps the longest is taken.
    assert first == len(rows) == 3 and rows["one_song_0000"].text.startswith("Hello") and rows["one_song_0000"].text.endswith("my friend")
    assert rows["one_song_0001"].text == "the end" and [r.text for c, r in rows.items() if r.text == ""] == [""]
    x, rate = clip_of(tmp_path / "corpus", "one_song_0000")
    a = int(4.9 * RATE)
    assert rate == RATE and np.abs(x - songs["one song"][a : a + len(x)].clip(-1, 1)).max() < 1e-3
    assert len(x) / RATE == pytest.approx(rows["one_song_0000"].duration, abs=1e-3) == pytest.approx(4.2, abs=0.01)
    # The second run leaves out what is there, a repeated batch adds nothing.
    second = corpus.ingest(found, listened, lines, "batch 2")
    assert asked == [{"one song"}, {"two", "hush"}] and second == 3 and corpus.metadata().count() == 6
    assert not any(r.song_id == "hush" for r in corpus.metadata().collect())
    assert corpus.ingest(found, listened, lines, "batch 2") == 0 and corpus.metadata().count() == 6
    y, rate = clip_of(tmp_path / "corpus", "two_0001")
    want = S.resample(songs["two"].astype(np.float32), 2 * RATE, RATE)[int(29.9 * RATE) :][: len(y)]
    assert rate == RATE and np.abs(y - want.clip(-1, 1)).max() < 1e-3


def test_rates_by_pieces(spark):
    rng = np.random.default_rng(2)
    clips = {"a": (rng.normal(0, 1, 5000), 8000), "b": (rng.normal(0, 1, 701), 3000), "c": (rng.normal(0, 1, 900), 5000)}
    rows = [(k, i, [float(v) for v in x[i : i + 130]]) for k, (x, _) in clips.items() for i in range(0, len(x), 130)]
    audio = spark.createDataFrame(rows, "rec_id string, first long, samples array<float>")
    rates = spark.createDataFrame([(k, r) for k, (_, r) in clips.items()], "rec_id string, rate int")
    got = ingest.at_rate(audio, rates, 5000, piece=256).collect()
    for k, (x, r) in clips.items():
        parts = sorted((g.first, g.samples) for g in got if g.rec_id == k)
        whole = np.concatenate([p for _, p in parts])
        n = -(-len(x) * 5000 // r)
        assert len(whole) == n and [a for a, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)])[:-1].tolist()
        assert np.allclose(whole, np.interp(np.arange(n) * r / 5000, np.arange(len(x)), x), atol=1e-5)


def test_annotated_and_clip_sources(spark, tmp_path):
    root = tmp_path / "jamendo"
    (root / "annotations" / "lines").mkdir(parents=True)
    (root / "JamendoLyrics.csv").write_text("Filepath,Artist,Language\na b.mp3,x,English\nc.mp3,y,French\nmissing.mp3,z,English\n")
    (root / "annotations" / "lines" / "a b.csv").write_text('﻿start,end,text\n0.5,2.0,"One, two"\n2.0,3.0,\n3,4,three\n')
    (root / "annotations" / "lines" / "c.csv").write_text("0.5,2.0,un\n")
    songs, lines = ingest.annotated_songs(spark, str(root), "en")
    assert [(r.song_id, r.stem, r.lang, r.is_mix) for r in songs.collect()] == [("jamendo_a b", "a b", "en", True)]
    assert sorted((r.start, r.end, r.text) for r in lines.collect() if r.song_id == "jamendo_a b") == [(0.5, 2.0, "One, two"), (3.0, 4.0, "three")]
    rate = 8000
    left, right = np.zeros(2 * rate), S.sine(rate, 2.0, 200, 0.3)
    for name in ("abjones_1_01", "abjones_1_02"):
        save(tmp_path / "mir" / "Wavfile" / f"{name}.wav", np.stack([left, right], axis=1), rate, 2)
    (tmp_path / "mir" / "Lyrics").mkdir()
    (tmp_path / "mir" / "Lyrics" / "abjones_1_01.txt").write_bytes("我們_今天".encode("cp950"))
    songs, lines = ingest.clip_songs(spark, str(tmp_path / "mir" / "Wavfile"), str(tmp_path / "mir" / "Lyrics"))
    assert [(r.song_id, r.is_mix) for r in songs.collect()] == [("mir1k_abjones_1_01", False)]
    assert [(r.start, r.end, r.text) for r in lines.collect()] == [(0.0, 2.0, "我們 今天")]
    corpus = ingest.Corpus(spark, str(tmp_path / "out"), ingest.Rules(rate=rate))
    assert corpus.ingest(songs, ingest.heard(spark, str(tmp_path / "mir" / "Wavfile"), rate, channel=1), lines, "mir") == 1
    x, _ = clip_of(tmp_path / "out", "mir1k_abjones_1_01_0000")
    assert np.abs(x - right[: len(x)]).max() < 1e-3 and len(x) == 2 * rate
    assert wav.PIECE and sound.PIECE
