import numpy as np
import pytest
from pyspark.sql import functions as F

from verselake.functions import signal
from verselake.functions import text as T
from verselake.operators import blocks, hooks, metrics, music, speakers, splits
from verselake.sources import files


def test_glide_edges():
    steady = [200.0] * 10
    assert music.glide_edges(steady) == (200.0, 200.0, None) and music.glide_edges([]) == (None, None, None)
    assert music.glide_edges([100.0, 150.0, 200.0]) == (100.0, 200.0, None)
    step = [200.0] * 6 + [300.0] * 4
    assert music.glide_edges(step) == (200.0, 300.0, pytest.approx(6 / 9))
    slide = list(np.geomspace(200, 400, 21))
    first, last, place = music.glide_edges(slide)
    assert first < 215 and last > 370 and place == pytest.approx(0.5, abs=0.05)
    assert music.glide_edges(slide[::-1])[2] == pytest.approx(0.5, abs=0.06)


def brute_growth(samples, size, start, end, lowest, highest, limit):
    while start - size >= lowest and signal.rms(samples[start - size : start]) >= limit:
        start -= size
    while end + size <= highest and signal.rms(samples[end : end + size]) >= limit:
        end += size
    return start, end


def test_grown_span_equals_steps():
    rng = np.random.default_rng(3)
    for _ in range(200):
        samples = rng.normal(0, 1, 400) * np.repeat(rng.choice([0.001, 0.1], 20), 20)
        a, z = sorted(rng.integers(0, 400, 2).tolist())
        low, high = int(rng.integers(0, a + 1)), int(rng.integers(z, 401))
        got = signal.grown_span(samples, 1000, a, z, low, high, 0.01)
        assert got == brute_growth(samples, 10, a, z, low, high, 0.016)
    assert signal.grown_span(np.zeros(0), 1000, 3, 5, 0, 9, 0.01) == (0, 0)


def test_segment_analysis_of_tones():
    rate = 8000
    low, high = signal.sine(rate, 0.4, 200.0, 0.4), signal.sine(rate, 0.4, 300.0, 0.2)
    found = signal.segment_analysis(np.concatenate([low, high]), rate)
    assert found["start_hz"] == pytest.approx(200, rel=0.02) and found["end_hz"] == pytest.approx(300, rel=0.02)
    assert 0.3 < found["position"] < 0.7 and found["rms_start"] > found["rms"] > found["rms_end"]
    assert signal.segment_analysis(np.zeros(1), rate)["median_hz"] is None
    assert signal.spectral_centroid(low, rate) == pytest.approx(200, rel=0.05) and signal.spectral_centroid(np.zeros(0), rate) == 0
    bands = signal.envelope_bands(low, rate)
    assert len(bands) == 28 and abs(sum(bands)) < 0.01 and signal.envelope_bands(np.zeros(2000), rate) is None and signal.envelope_bands(low[:99], rate) is None


def test_registers(spark):
    rows = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 35.0, 70.0, 100.0, 400.0, 401.0, 3300.0, 5.0)], "hz double")

    def loop(hz):
        while hz > 400:
            hz /= 2
        while 0 < hz < 70:
            hz *= 2
        return hz

    assert all(r.f == loop(r.hz) for r in rows.select("hz", music.fold_into_range("hz").alias("f")).collect())
    assert [r[0] for r in rows.select(music.register_octaves("hz", F.lit(100.0))).collect()][:5] == [0, 0, 2, 1, 0]


def test_blocks_and_notes(spark):
    a = spark.createDataFrame([(1, [("x", 1), ("y", 2)]), (2, [("z", 3)]), (3, None)], "id int, blocks array<struct<t:string,p:int>>")
    b = spark.createDataFrame([(1, [(10,), (20,), (30,)]), (3, [(9,)])], "id int, blocks array<struct<p:int>>")
    got = {r.id: r.blocks and [(x.t, x.p) for x in r.blocks] for r in blocks.by_position(a, b, "id", ["p"]).collect()}
    assert got == {1: [("x", 10), ("y", 20)], 2: [("z", 3)], 3: None}
    notes = spark.createDataFrame([("ab c", "1 2", [1.0, 2.0, 3.0]), ("", "5 6", [3.0]), (None, None, None)], "t string, j string, d array<double>")
    rows = [[(n.char, n.token, n.seconds) for n in r[0] or []] for r in notes.select(blocks.sing_notes("t", "j", "d")).collect()]
    assert rows == [[("a", "1", 1.0), ("b", "2", 2.0), ("c", "2", 3.0)], [("啦", "5", 1.5), ("啦", "6", 1.5)], []]
    seg = spark.createDataFrame([(["1", None, "x", "2.5"],), ([],), (["?"],)], "s array<string>")
    assert [r[0] for r in seg.select(blocks.segment_max("s")).collect()] == [2.5, None, None]
    num = spark.createDataFrame([('{"a": 1.5}',), ('{"a": "NaN"}',), ("no",), (None,)], "j string")
    assert [r[0] for r in num.select(blocks.payload_number("j", "a", 4)).collect()] == [1.5, 4.0, 4.0, 4.0]


def test_glossary_is_a_queue():
    fold = blocks.GlossaryFold(capacity=2)
    for pair in (("a", "1"), ("b", "2"), (" a ", "3"), ("c", "c"), ("", "x"), ("c", "4"), (None, "x"), ("y" * 81, "z")):
        fold.add(*pair)
    assert fold.finish() == [(0, "b", "2"), (1, "c", "4")]


def test_hooks(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.5], "hallo", "de"), (2, [0.0], "hi", "EN"), (3, None, None, None)], "id int, x array<float>, t string, l string")
    doubled = rows.select(hooks.enhance(F.col("x"), lambda s: s * 2)).collect()
    assert [r[0] for r in doubled] == [[1.0, -1.0], [0.0], None]
    assert [r[0] for r in rows.select(hooks.enhance(F.col("x"), lambda s: s[:1])).collect()] == [[0.5, -0.5], [0.0], None]
    assert [r[0] for r in rows.select(hooks.translate(F.col("t"), F.col("l"), "en", lambda t, s: t.upper())).collect()] == ["HALLO", "", ""]
    assert [r[0] for r in rows.select(hooks.embed(F.col("x"), lambda s: [1.0 / s[0]])).collect()] == [[2.0], None, None]
    assert [r[0] for r in rows.select(hooks.embed(F.col("x"), None)).collect()] == [None] * 3
    spans = rows.select(hooks.forced_spans(F.col("x"), F.array("t"), lambda x, l: [(0, len(x))])).collect()
    assert [r[0] and [tuple(s) for s in r[0]] for r in spans] == [[(0.0, 2.0)], [(0.0, 1.0)], None]
    assert [r[0] for r in rows.select(hooks.voice_engine(F.col("x"), F.col("l"), None)).collect()] == [[0.25, -0.25], [0.0], None]
    frames = spark.createDataFrame([("s", i, [v]) for i, v in enumerate((0.0, 0.02, 0.008, 0.001, 0.008))], "k string, i int, x array<float>")
    heard = hooks.detect_speech(frames, "k", "i", "x", None).orderBy("i").collect()
    assert [r.speech for r in heard] == [False, True, True, False, False]
    model = hooks.detect_speech(frames, "k", "i", "x", lambda x, memory: ((memory or 0) / 4, (memory or 0) + 1)).orderBy("i").collect()
    assert [r.speech for r in model] == [False, False, True, True, True]


def test_samples_and_sources(spark):
    rows = spark.range(1000).withColumn("s", F.col("id") % 3)
    drawn = splits.hash_sample(rows, "id", 0.15)
    best = rows.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(150)
    assert drawn.columns == rows.columns and {r.id for r in drawn.collect()} == {r.id for r in best.collect()}
    assert splits.first_per_source(rows, "s", ["id"], 2).count() == 6 and splits.first_per_source(rows, "s", ["id"], None).count() == 1000
    assert splits.manifest_union(rows.select("id"), rows.select("s")).count() == 2000
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None)], "id int, v array<double>")
    near = {r.id: (r.c, r.similarity) for r in speakers.nearest(vectors, vectors.select(F.col("id").alias("c"), "v"), "id", "v", "c").collect()}
    assert near == {1: (1, 1.0), 2: (2, 1.0), 3: (None, None), 4: (None, None)}
    errors = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 7.0), ("a", 2, 1.0), ("a", 3, None)], "g string, clip int, e double")
    assert [tuple(r) for r in metrics.median_of_medians(errors, ["g"], "clip", "e").collect()] == [("a", 3.5, 2)]


def test_small_text_rules(spark):
    rows = spark.createDataFrame([("é好😀a", "mir1k_amy_3_02", "zh-TW")], "t string, s string, l string")
    r = rows.select(T.ascii_escape("t"), T.singer("s"), T.joiner("l"), T.rolling_context("t", 2), T.rolling_context("t", 0)).first()
    assert tuple(r) == ("\\xe9\\u597d\\U0001f600a", "amy", "", "😀a", "")


def test_preparation_and_spectrogram(spark):
    rate = 8000
    rng = np.random.default_rng(2)
    voice = signal.sine(rate, 1.0, 200.0, 0.05)
    clip = np.concatenate([voice, np.zeros(rate, np.float32)]) + rng.normal(0, 0.002, 2 * rate).astype(np.float32)
    assert (signal.prepare(clip, rate, "off") == clip).all() and len(signal.prepare(clip[:0], rate)) == 0
    for profile, gain in (("natural", 6.0), ("speech", 10.0), ("unknown", 6.0)):
        out = signal.prepare(clip, rate, profile)
        loud, quiet = signal.rms(out[:rate]) / signal.rms(clip[:rate]), signal.rms(out[rate + 400 :]) / signal.rms(clip[rate + 400 :])
        assert len(out) == len(clip) and np.abs(out).max() <= signal.HEADROOM and quiet < 0.75 * loud and 1 < loud <= 10 ** (gain / 20)
    levels = signal.frame_levels(clip, 160, 80)
    assert np.allclose(levels[:50], [signal.rms(clip[i * 80 : i * 80 + 160]) for i in range(50)])
    found = signal.spectrogram(voice * 4, rate)
    shades = np.frombuffer(found["magnitudes"], np.uint8).reshape(found["time_bins"], found["bands"])
    assert shades.max() == 255 and (shades.argmax(axis=1) == 6).all() and found["bands"] == 64
    assert sum(x is not None and abs(x - 200) < 2 for x in found["f0"]) >= 0.9 * found["time_bins"]
    assert signal.spectrogram(clip[:0], rate) is None and signal.spectrogram(voice[:100], rate)["time_bins"] == 1
    row = spark.createDataFrame([(bytearray(signal.float_to_pcm16(voice * 4)),), (None,)], "b binary").select(signal.spectrograms(F.col("b"), rate).alias("s")).collect()
    assert len(row[0].s.f0) == found["time_bins"] and row[1].s.time_bins is None


def test_corpus_lists(spark, tmp_path):
    head = "client_id\tpath\tsentence\n"
    for name, rows in (("train", "s1\ta.mp3\thello\ns2\tb.mp3\tq\"uote\n"), ("test", "s1\tc.mp3\tx\n")):
        (tmp_path / f"{name}.tsv").write_text(head + rows)
    folder = str(tmp_path)
    assert {(r.stem, r.speaker) for r in files.common_voice(spark, folder).collect()} == {("a", "s1"), ("b", "s2"), ("c", "s1")}
    assert {r.stem for r in files.clip_stems(spark, f"{folder}/train.tsv", f"{folder}/gone.tsv").collect()} == {"a", "b"}
    (tmp_path / "validated.tsv").write_text(head + "s9\tz.mp3\ty\ns8\tz.mp3\tlater\n")
    assert [tuple(r) for r in files.common_voice(spark, folder).collect()] == [("z", "s8", "later")]
    assert files.common_voice(spark, f"{folder}/none").count() == 0 and files.clip_stems(spark, f"{folder}/none.tsv").count() == 0
    assert files.alignment_gold(spark, f"{folder}/none.jsonl").count() == 0
    (tmp_path / "pairs.csv").write_text("from,to\na,b\nlonger,c\n")
    assert files.replacement_pairs(spark, f"{folder}/pairs.csv") == [("longer", "c"), ("a", "b")]
    with pytest.raises(ValueError):
        files.replacement_pairs(spark, f"{folder}/pairs.csv", most=1)
