import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verselake.operators import align, corpus, metrics, music, registry, search, speakers, splits, summary


def test_search_routes_and_ranks(spark):
    rows = [(i, f"t{i}", b, float(i)) for i, b in enumerate(["the cat sat", "CAT cat cat", "dog", 'say "cat" OR dog', "", "x", "y", "z"])]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, mtime double")
    assert [r.doc_id for r in search.search(docs, "cat").collect()][0] == 1
    assert {r.doc_id for r in search.search(docs, "cat").collect()} == {0, 1, 3}
    assert [r.doc_id for r in search.search(docs, "ca").collect()] == [3, 1, 0]
    assert [r.doc_id for r in search.search(docs, "  ").collect()][:2] == [7, 6]
    assert search.search(docs, '"cat" OR').count() == 1
    assert search.clamp_limit(0) == 50 and search.clamp_limit(-3) == 1 and search.clamp_limit(999) == 200
    assert spark.createDataFrame([("aaaa",)], "x string").select(search.occurrences(F.col("x"), "aa")).first()[0] == 3


def test_summary_keeps_order(spark):
    docs = spark.createDataFrame([(1, "aaa! bb! aaab! c! aa!"), (2, "only one!"), (3, None), (4, "… !!")], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in summary.summarize(docs, 2).collect()}
    assert got[1] == "aaa!aa!" and got[2] == "only one!" and 3 not in got


def brute_cost(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_counts_are_optimal():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        h, s, d, i = metrics.edit_counts(a, b)
        assert s + d + i == brute_cost(a, b) and h + s + d == len(a) and h + s + i == len(b)
        pairs = align.aligned_pairs(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and len(pairs) == h
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_texts_align_exactly():
    """Halved tables give a path as short as a whole one."""
    rng = random.Random(8)
    for _ in range(120):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        for cells in (4, 40, 4_000_000):
            steps = align.diagonals(a, b, cells)
            changed = sum(a[i] != b[j] for i, j in steps)
            assert changed + len(a) + len(b) - 2 * len(steps) == brute_cost(a, b)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(steps, steps[1:]))


def test_anchored_and_dropped(spark):
    lyrics = spark.createDataFrame([(1, "abcd\nxy"), (2, "q")], "rec_id int, lyrics string")
    heard = spark.createDataFrame([(1, c, float(i), i + 1.0) for i, c in enumerate("abzdxy!k")] + [(3, "q", 0.0, 1.0)], "rec_id int, char string, start double, end double")
    aligned = align.align_lyrics(lyrics, heard)
    got = {r.char: (r.start, r.matched, r.anchored) for r in aligned.filter("rec_id = 1").collect()}
    assert got["c"] == (2.0, False, True) and got["x"] == (4.0, True, True)
    totals = {r.rec_id: (round(r.matched_ratio, 4), r.anchored_ratio, r.dropped) for r in align.alignment_totals(aligned, heard).collect()}
    assert totals == {1: (0.8333, 1.0, 1), 2: (0.0, 0.0, 0)}


def test_metrics(spark):
    df = spark.createDataFrame([("g", "abc", "abd"), ("g", "小星星", "心星星")], "g string, ref string, hyp string")
    r = metrics.error_rates(df, ["g"]).first()
    assert (r.cer, r.mer, r.wer_compat) == (0.33333, 0.33333, 1.0)
    pred = [{"word": w, "start": s, "end": s + 1} for w, s in (("a", 0.1), ("x", 1.0), ("b", 2.2))]
    gold = [{"word": w, "start": s, "end": s + 1} for w, s in (("a", 0.0), ("b", 2.0), ("c", 3.0))]
    assert np.allclose(sorted(metrics.matched_time_errors(pred, gold)), [100, 100, 200, 200])


def test_lrc_lines_gaps(spark):
    text = "[ti:x]\n[00:10.00][00:30.00]hello\n[00:20.50]\nplain\n[01:00.00]end"
    songs = spark.createDataFrame([("s", text, 70.0)], "song_id string, text string, duration double")
    entries = corpus.parse_lrc(songs).join(songs.select("song_id", "duration"), "song_id")
    lines = corpus.line_ends(entries)
    assert [(r.start, r.end, r.text) for r in lines.orderBy("pos").collect()] == [(10.0, 20.5, "hello"), (30.0, 55.0, "hello"), (60.0, 70.0, "end")]
    gaps = corpus.gaps(lines.select("song_id", "start", "end"), songs.select("song_id", "duration"), 2.0, 4.0, 0.5)
    assert [(r.start, r.end) for r in gaps.orderBy("start").collect()] == [(0.5, 3.5), (3.5, 6.5), (6.5, 9.5), (21.0, 23.833333333333332), (23.833333333333332, 26.666666666666668), (26.666666666666668, 29.5), (55.5, 59.5)]


def brute_merge(lines, min_dur, max_dur, max_gap):
    out = []
    for a, z, x in lines:
        if out and out[-1][1] - out[-1][0] < min_dur and a - out[-1][1] <= max_gap and z - out[-1][0] <= max_dur:
            out[-1] = (out[-1][0], z, out[-1][2] + " " + x)
        else:
            out.append((a, z, x))
    return out


def test_merge_and_pack_lose_nothing():
    rng = random.Random(2)
    for _ in range(200):
        t, lines = 0.0, []
        for k in range(rng.randint(0, 12)):
            t += rng.random()
            lines.append((t, t + rng.random(), str(k)))
            t = lines[-1][1]
        fold = corpus.LineMerger(1.0, 3.0, 0.5, " ")
        chunks = [c for x in lines for c in fold.add(*x)] + list(fold.finish())
        assert [c[1:] for c in chunks] == brute_merge(lines, 1.0, 3.0, 0.5) and [c[0] for c in chunks] == list(range(len(chunks)))
        durations = [rng.random() * 12 for _ in range(20)]
        packer = corpus.BinPacker(25.0, 0.3)
        bins = [r[-2:] for d in durations for r in packer.add(d)]
        assert [b for b, _ in bins] == sorted(b for b, _ in bins) and all(d <= 25.0 for _, d in bins)


def test_ordered_fold_keeps_keys_apart(spark):
    """Keys (a null one too) over several batches, and an empty table."""
    rows = [(k, i, float(i)) for k in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, dur double").repartition(7)
    out = corpus.pack_windows(df, "k", ["i"], target=100.0, gap=0.0).collect()
    by = {}
    for r in out:
        by.setdefault(r.k, []).append((r.i, r.bin, r.bin_dur))
    assert set(by) == {"a", "b", None} and len({tuple(sorted(v)) for v in by.values()}) == 1 and len(out) == 150
    assert corpus.pack_windows(df.filter("false"), "k", ["i"]).count() == 0


def test_pack_blocks(spark):
    clips = spark.createDataFrame([("s", i, 10.0 if i else None) for i in range(5)], "spk string, id int, dur double")
    packed = corpus.pack_windows(clips, "spk", ["id"])
    assert [(r.id, r.bin) for r in packed.orderBy("id").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    rows = corpus.packed_rows(packed, "spk", ["id"], "id").orderBy("bin").collect()
    assert [r.audios for r in rows] == [[0, 1, 2], [3, 4]] and rows[1].dur == 20.3


def test_splits_are_disjoint(spark):
    clips = spark.range(300).select(F.col("id").cast("string").alias("stem"))
    speakers_of = clips.select("stem", F.concat(F.lit("s"), (F.col("stem").cast("int") % 23).cast("string")).alias("speaker"))
    out = splits.speaker_split(clips, clips.filter("cast(stem as int) in (0, 1, 24)"), speakers_of).cache()
    assert out.filter("split = 'test'").count() == 3
    by = {s: {r.speaker for r in out.filter(F.col("split") == s).collect()} for s in ("train", "dev", "test")}
    assert not by["train"] & by["dev"] and not by["train"] & by["test"] and not by["dev"] & by["test"] and len(by["dev"]) == 3
    assert splits.drop_reasons(out).first().n == out.filter("split is null").count()
    small = spark.range(103).select("id", (F.col("id") < 3).alias("m"))
    assert splits.oversample(small, "m", "id", 10).filter("m").count() == 10


def test_negatives_compat(spark):
    rows = spark.createDataFrame([("neg_1", "", True), ("song_3", "", True), ("cv_1", "x", False)], "stem string, text string, negative boolean")
    assert [r.drop_reason for r in splits.keep_text_rows(rows).orderBy("stem").collect()] == [None, None, "empty_text"]
    assert [r.drop_reason for r in splits.keep_text_rows(rows, compat=False).orderBy("stem").collect()] == [None, None, None]


def test_monotonic_and_interpolation(spark):
    rng = random.Random(1)
    spans = [(rng.random() * 10, rng.random() * 10) for _ in range(60)]
    df = spark.createDataFrame([("r", i, a, b) for i, (a, b) in enumerate(spans)], "by string, pos int, start double, end double")
    got = [(r.start, r.end) for r in align.monotonic(df, "by", "pos").orderBy("pos").collect()]
    held = 0.0
    for (a, b), (x, y) in zip(spans, got):
        assert x == max(a, held) and y == max(b, x)
        held = max(held, x, y)
    assert align.filled_spans([None, (1, 2), None, None, (4, 5), None], 0, 6) == [(0.0, 1.0), (1, 2), (2.0, 3.0), (3.0, 4.0), (4, 5), (5.0, 6.0)]


def test_align_lyrics(spark):
    lyrics = spark.createDataFrame([("r", "[Verse]\nab\n\ncd"), ("n", None)], "rec_id string, lyrics string")
    chars = spark.createDataFrame([("r", "A", 0.0, 1.0), ("r", "d", 3.0, 4.0), ("r", "z", None, 2.0)], "rec_id string, char string, start double, end double")
    got = [(r.char, r.start, r.end, r.matched) for r in align.align_lyrics(lyrics, chars).orderBy("pos").collect()]
    assert got == [("a", 0.0, 1.0, True), ("b", 1.0, 2.0, False), ("c", 2.0, 3.0, False), ("d", 3.0, 4.0, True)]


def test_degrees_round_trip(spark):
    hz = [220 * 2 ** (k / 12) for k in range(-14, 27)] + [None, 0.0]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hz)], "i int, hz double")
    rows = df.select("i", "hz", music.scale_degree("hz", F.lit(220.0)).alias("d")).withColumn("s", music.degree_semitones("d")).orderBy("i").collect()
    assert [r.s for r in rows[:-2]] == [float(k) for k in range(-14, 27)] and [r.d for r in rows[-2:]] == ["", ""]
    one = spark.range(1).select(music.glide(F.lit(220.0), F.lit(440.0), F.lit(220.0)).alias("g"), music.quantize_beats(F.lit(0.6), F.lit(0.5))["beats"].alias("b")).first()
    assert one.g == "1↗1̇" and one.b == 1.0


def loop_tonic(notes, last_weight=3.0):
    """The rule note by note."""
    good = [(f, w if w and w > 0 and np.isfinite(w) else 0.0) for f, w in notes if f and f > 0 and np.isfinite(f)]
    if not good:
        return None, 0.0, "empty"
    thin = (float(np.median([f for f, _ in good])), 0.0, "median")
    if len(good) < 8:
        return thin
    weights = [w for _, w in good] if any(w for _, w in good) else [1.0] * len(good)
    weights[-1] *= last_weight
    steps = [12 * np.log2(f / 440) for f, _ in good]
    mean = sum(w * np.exp(2j * np.pi * s) for w, s in zip(weights, steps))
    offset = np.angle(mean) / (2 * np.pi)
    held = [0.0] * 12
    for w, s in zip(weights, steps):
        held[int(np.rint(s - offset)) % 12] += w
    if sum(h >= 0.02 * sum(held) for h in held) < 4 or min(held) == max(held):
        return thin
    scores = [np.corrcoef([held[(r + k) % 12] for k in range(12)], p)[0, 1] for p in (music.MAJOR_PROFILE, music.MINOR_PROFILE) for r in range(12)]
    best = int(np.argmax(scores))
    root = best if best < 12 else (best - 9) % 12
    share = sum(held[(root + s) % 12] for s in music.MAJOR_STEPS) / sum(held)
    if share < 0.75:
        return thin
    tonic = 440 * 2 ** ((offset + root) / 12)
    return float(tonic * 2.0 ** np.floor(np.log2(thin[0] / tonic))), share, "key"


def test_tonic_of_recordings(spark):
    rng = np.random.default_rng(4)
    scale = [0, 2, 4, 5, 7, 9, 11, 12, 7, 4, 0]
    tunes = {0: [(261.63 * 2 ** (s / 12), 1.0) for s in scale], 1: [(None, 1.0), (float("nan"), 1.0), (-3.0, 1.0)], 2: [(220.0, 0.5)] * 12, 3: [(300.0, 1.0)] * 3, 4: [(131 * 2 ** (s / 12), None) for s in scale]}
    for k in range(5, 30):
        root, minor = rng.uniform(100, 400), k % 2
        steps = [0, 2, 3, 5, 7, 8, 10] if minor else [0, 2, 4, 5, 7, 9, 11]
        tunes[k] = [(float(root * 2 ** ((rng.choice(steps) + rng.normal(0, 0.05) + 12 * rng.integers(0, 2)) / 12)), float(rng.uniform(-0.1, 1))) for _ in range(rng.integers(5, 60))]
    for k in range(30, 34):
        tunes[k] = [(float(rng.uniform(80, 500)), 1.0) for _ in range(40)]
    rows = [(r, i, f, w) for r, notes in tunes.items() for i, (f, w) in enumerate(notes)]
    got = {r.rec: r for r in music.estimate_tonic(spark.createDataFrame(rows, "rec int, pos int, hz double, duration double"), "rec", ["pos"]).collect()}
    for r, notes in tunes.items():
        tonic, confidence, source = loop_tonic(notes)
        assert got[r].source == source and got[r].confidence == pytest.approx(confidence), r
        assert got[r].tonic_hz == (None if tonic is None else pytest.approx(tonic)), r
    assert got[0].source == "key" and got[1].source == "empty" and got[2].tonic_hz == 220 and {g.source for g in got.values()} == {"key", "median", "empty"}


def test_online_clusters_of_few():
    c = speakers.OnlineClusters(2, 0.75)
    assert [c.assign(v) for v in ([1, 0], [0.9, 0.1], [0, 1], [-1, 0], [0, 0], [float("nan"), 1], None)] == [0, 0, 1, 1, None, None, None]


def test_at_time_first_match(spark):
    spans = spark.createDataFrame([("r", 0, "a", 0.0, 2.0), ("r", 1, "b", 1.0, 9.0)], "by string, pos int, char string, start double, end double")
    times = spark.createDataFrame([("r", 0.5), ("r", 1.5), ("r", 5.0), ("r", 9.0)], "by string, t double")
    assert [r.char for r in align.at_time(times, spans, "by", "t", 1.0).orderBy("t").collect()] == ["a", "a", "b", ""]


def test_registry(spark):
    rows = spark.createDataFrame([(0, "a", "m1", "asr"), (1, "a", "m2", "asr"), (2, "bad id!", "m", "asr"), (3, "c", "m3", "nope")], "pos int, id string, model string, kind string")
    assert [(r.id, r.model) for r in registry.valid(rows).collect()] == [("a", "m1")]
    assert registry.active(rows, "m2").first().active == "a" and registry.active(rows, "zz").first().active == "current"


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_rates_read_whole_texts(spark):
    """Texts that differ after their first 60 characters only, or in characters beyond ASCII only."""
    from verselake.plans import catalog

    texts = ["same start " * 8 + "ends one way", "same start " * 8 + "ends in another way", "caf\u00e9 \u597d", "cafe \u4f60\U0001f600"]
    df = spark.createDataFrame([(k // 2, k % 2, "user", x) for k, x in enumerate(texts)], "conv_id long, turn int, role string, text string")
    want = sum(brute_edits(*texts[k : k + 2]) for k in (0, 2)) / sum(len(texts[k]) for k in (0, 2))
    one, more = catalog.cer_micro(lambda _: df).first(), catalog.mer_micro(lambda _: df).first()
    assert one.cer == round(want, 6) and more.cer == round(want, 5) and one.wer_compat == more.wer_compat == 1.0
    words = [x.split() for x in texts]
    assert more.n == 2 and more.wer_token > 0 and brute_edits(words[0], words[1]) == 2
