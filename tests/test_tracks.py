import numpy as np
import pytest
from pyspark.sql import functions as F

from verselake.functions import text as T
from verselake.operators import tracks

NAN = float("nan")


def test_cleaning_rules():
    t = np.arange(40) * 0.02
    held = np.full(40, 220.0)
    assert (tracks.cleaned(held, t) == held).all()
    octave = held.copy()
    octave[15:22] = 440.0
    assert np.allclose(tracks.cleaned(octave, t), 220.0, atol=0.2)
    spike = held.copy()
    spike[20] = 330.0
    assert np.allclose(tracks.cleaned(spike, t), 220.0, atol=0.2)
    glide = np.concatenate([held[:15], 220 * 2 ** (np.linspace(0, 4, 10) / 12), np.full(15, 220 * 2 ** (4 / 12))])
    assert np.allclose(tracks.cleaned(glide, t), glide)
    alone = np.array([NAN, 100.0, 500.0, 100.0, NAN])
    assert np.isnan(tracks.cleaned(alone, np.arange(5) * 0.5)).all()
    assert tracks.spacing(np.array([0.0])) == 0.0 and tracks.stretches(np.array([1, 0, 1, 1], bool)) == [(0, 1), (2, 4)]


def test_growth_stops_at_the_floor():
    hz = np.array([NAN] * 5 + [200.0, 210.0] + [NAN] * 5)
    loud = np.array([0.1, 0.1, 0.1, 0.1, 1, 1, 1, 1, 1, 1, 1, 0.1])
    got = tracks.grown(hz, loud)
    assert np.nan_to_num(got).tolist() == [0, 0, 0, 0, 200, 200, 210, 210, 210, 210, 0, 0]


def test_notes(spark):
    schema = "by string, pos int, time double, hz double, intensity double, text string, block_start boolean"
    made = lambda rows: [(n.char, n.kind, n.hz, n.duration and round(n.duration, 6)) for n in tracks.notes(spark.createDataFrame(rows, schema), "by").orderBy("pos").collect()]
    rows = [("a", 220.0), ("a", 220.0), ("", 230.0), ("", None), ("", None), ("b", None)]
    plain = [("r", i, i * 0.1, h, 0.0 if h is None else 0.5, x, False) for i, (x, h) in enumerate(rows)]
    assert made(plain) == [("a", "voiced", 220.0, 0.5), ("b", "voiced", 230.0, 0.1)]
    # A paragraph's silence, a tail after it that joins nothing, a loud silence of two bins, and a quiet one.
    rows = [(0.0, "a", 200.0, 0.5, False), (0.1, "a", 240.0, 0.5, False), (1.5, "", 260.0, 0.5, True), (1.6, "x", None, 0.5, False), (1.7, "", None, 0.5, True), (1.8, "", None, 0.5, False), (1.9, "y", 300.0, 0.5, False), (2.0, "", None, 0.0, False)]
    assert made([("s", i, a, h, v, x, b) for i, (a, x, h, v, b) in enumerate(rows)]) == [
        ("a", "voiced", 240.0, 0.2), ("-", "rest", None, 1.3), ("啦", "voiced", 260.0, 0.1), ("x", "voiced", 260.0, 0.1), ("", "breath", None, 0.2),
        ("y", "voiced", 300.0, 0.1), ("-", "rest", None, 0.1),
    ]
    spaced = spark.createDataFrame([("r", x) for x in (0.0, 0.1, 0.3, 0.6, 1.0, 9.0)], "by string, time double")
    assert tracks.bin_spacing(spaced, "by").first().bin_seconds == pytest.approx(0.3)
    padded = spark.createDataFrame([("r", 0, "x", "rest"), ("r", 1, "y", "voiced"), ("r", 2, "z", "rest")], "by string, pos int, char string, kind string")
    assert [n.pos for n in tracks.trim_edge_rests(padded, "by").collect()] == [1]


def test_small_text(spark):
    one = spark.range(1).select(
        T.flores(F.lit("ZH_tw")).alias("a"), T.flores(F.lit("zho_Hant")).alias("b"), T.flores(F.lit("auto")).alias("c"),
        T.changed_part(F.lit("the cat sat"), F.lit("the dog sat")).alias("d"), T.changed_part(F.lit("aa"), F.lit("aaa")).alias("e"),
        T.prompt(F.lit(None).cast("string"), F.lit("base"), F.array(F.lit("x"), F.lit(" x "), F.lit("y"))).alias("p"),
    ).first()
    assert (one.a, one.b, one.c) == ("zho_Hant", "zho_Hant", None)
    assert tuple(one.d) == ("cat", "dog") and tuple(one.e) == ("", "a") and one.p == "base x、y"
