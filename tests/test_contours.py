import numpy as np
import pytest
from pyspark.sql import functions as F

from verselake.functions import text as T
from verselake.operators import contours

NOTE = "char string, kind string, hz double, contour array<double>, start_hz double, end_hz double, degree string, degree_start string, degree_end string, glide_mid double, duration double, intensity double"


def slide(a, b, place):
    p = min(0.85, max(0.15, place if place and 0 < place < 1 else 0.5))
    return [a if k / 8 <= p - 0.18 else b if k / 8 >= p + 0.18 else a + (b - a) * (k / 8 - p + 0.18) / 0.36 for k in range(9)]


def test_curves_of_notes(spark):
    up = lambda s: 220 * 2 ** (s / 12)
    cases = [
        # (note, measured, curve)
        ((None, "", 100.0, [200.0, None, -1.0, 300.0], 110.0, 120.0, "1", None, None, None, 1.0, None), True, [200.0, 300.0]),
        (("x", "", 100.0, [None], 110.0, 120.0, "1", None, None, 0.9, 1.0, None), True, slide(110, 120, 0.9)),
        (("x", "", 100.0, None, 110.0, None, "1", None, None, None, 1.0, None), True, [100.0]),
        (("x", "", 0.0, None, 110.0, 0.0, "1", None, None, None, 1.0, None), True, None),
        (("x", "", 100.0, [200.0], 110.0, 120.0, "3↗5", None, None, 0.2, 1.0, None), False, slide(up(4), up(7), 0.2)),
        (("x", "", 100.0, None, None, None, "5↘1", "6", "", None, 1.0, None), False, slide(up(9), up(0), None)),
        (("x", "", 100.0, None, None, None, "2", "3", "3", None, 1.0, None), False, [up(2)]),
        (("x", "", 100.0, None, None, None, "1", "1", "7", 1.0, 1.0, None), False, slide(up(0), up(11), None)),
        (("x", "", 100.0, None, None, None, "2↗2", None, None, None, 1.0, None), False, [up(2)]),
        (("x", "", 100.0, None, None, None, "??", None, None, None, 1.0, None), False, [100.0]),
        (("x", "", None, None, None, None, None, None, None, None, 1.0, None), False, None),
        (("", "Breath ", 100.0, [200.0], None, None, "1", None, None, None, 1.0, 0.3), True, None),
    ]
    df = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(cases)], f"i int, n struct<{NOTE.replace(' ', ':').replace(',:', ',')}>")
    for measured in (True, False):
        got = {r.i: r.r for r in df.select("i", contours.resolved(F.col("n"), F.lit(220.0), measured).alias("r")).collect()}
        for i, (note, kind, want) in enumerate(cases):
            if kind == measured:
                assert got[i].contour == (None if want is None else pytest.approx(want)), note
                assert got[i].kind == ("breath" if i == 11 else "rest" if want is None else "voiced") and got[i].freq == (None if want is None else pytest.approx(want[0]))
    assert got[11].char == "h" and got[0].char == "a" and got[11].intensity == 0.3 and got[0].intensity == 0
    none = df.filter("i = 6").select(contours.resolved(F.col("n"), F.lit(0.0), False).alias("r")).first().r
    assert none.contour == [100.0]


def test_sampling(spark):
    curve = [100.0, 200.0, 600.0, 80.0]
    df = spark.createDataFrame([(curve, 7), (curve, 1), ([90.0], 3), (None, 2), ([], 2)], "c array<double>, n int")
    got = [r.p for r in df.select(contours.pitches(F.col("c"), F.col("n")).alias("p")).collect()]
    assert got[0] == pytest.approx(np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, 4), np.clip(curve, 70, 400)).tolist())
    assert got[1:] == [[100.0], [90.0] * 3, [165.0] * 2, [165.0] * 2]
    for k in (1, 3, 5):
        found = df.limit(1).select(contours.steps(F.col("c"), k).alias("s")).first().s
        assert found == pytest.approx([100.0] if k == 1 else np.interp((np.arange(k) + 0.5) / k, np.linspace(0, 1, 4), curve).tolist())


def test_romanised(spark):
    table = {"你": "ni", "你好": "nihao", "好": "hao", "吗": "ma", "": "never", "é": "e"}
    df = spark.createDataFrame([("你好吗 你 好 Café!",), (None,), ("",), ("it's 1 2",)], "t string")
    got = df.select(T.romanised("t", table).alias("r"), T.romanised_words("t", table).alias("w")).collect()
    assert [r.r for r in got] == ["nihaoma ni hao Cafe!", None, "", "it's 1 2"] and [r.w for r in got] == [["nihaoma", "ni", "hao", "cafe"], None, [], ["it's"]]


def test_a_note_is_read_once(spark):
    """Each degree of a note stands in the plan once, however many points and columns come from it."""
    note = F.struct(
        *(F.lit("").alias(c) for c in ("char", "kind", "degree_start", "degree_end")), F.lit(None).cast("array<double>").alias("contour"), F.lit("3↗5").alias("degree"),
        *(F.lit(None).cast("double").alias(c) for c in ("hz", "start_hz", "end_hz", "glide_mid")), F.rand().alias("duration"), F.lit(0.1).alias("intensity"),
    )
    found = spark.range(3).select(contours.resolved(F.when(F.col("id") >= 0, note), F.lit(220.0), False).alias("r")).select("r.kind", "r.freq", F.size("r.contour").alias("n"))
    assert [r.n for r in found.collect()] == [9, 9, 9]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4
