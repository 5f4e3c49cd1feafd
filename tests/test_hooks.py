import pytest
from pyspark.sql import functions as F

from verselake.operators import hooks


def test_outcomes_of_batches():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    rows = [(f"t{i}",) for i in range(70)] + [("bad",), ("x",)]
    found = hooks._outcomes(model, lambda t: "", rows, "keep", True)
    assert [v for v, _ in found[:70]] == [f"T{i}" for i in range(70)] and found[70] == ("", "ValueError: no") and found[71] == ("X", None)
    assert calls[:3] == [32, 32, 8] and calls[3:] == [1] * 8
    short = hooks._outcomes(lambda t: t[:-1], lambda t: "", [("a",), ("b",)], "keep", True)
    assert [e[:10] for _, e in short] == ["IndexError"] * 2
    with pytest.raises(ValueError):
        hooks._outcomes(model, lambda t: "", rows, "raise", True)
    assert hooks._outcomes(None, lambda t: "none", [("a",)], "raise", True) == [("none", None)]


def test_failures_are_rows(spark):
    df = spark.createDataFrame([("one", "en"), ("bad", "en"), ("two", "de"), (None, "en"), ("three", None)], "t string, s string")

    def model(text, source):
        if text == "bad":
            raise RuntimeError("broken")
        return text[::-1]

    def many(texts, sources):
        return [model(t, s) for t, s in zip(texts, sources)]

    for m, batched in ((model, False), (many, True)):
        got = df.select("t", hooks.translate(F.col("t"), F.col("s"), "de", m, errors="report", batched=batched).alias("r")).collect()
        assert {(r.t, r.r.value, r.r.error) for r in got} == {("one", "eno", None), ("bad", "", "RuntimeError: broken"), ("two", "", None), (None, "", None), ("three", "eerht", None)}
    kept = df.select(hooks.translate(F.col("t"), F.col("s"), "de", model).alias("r")).collect()
    assert [r.r for r in kept] == ["eno", "", "", "", "eerht"]
    with pytest.raises(Exception):
        df.select(hooks.translate(F.col("t"), F.col("s"), "de", model, errors="raise")).collect()
    with pytest.raises(ValueError):
        hooks.translate(F.col("t"), F.col("s"), "de", model, errors="ignore")
    clips = spark.createDataFrame([([0.5, 0.5], ""), ([], "before"), (None, "")], "x array<float>, c string")
    text = hooks.recognise(F.col("x"), F.col("c"), lambda xs, cs: [f"{len(x)}{c}" for x, c in zip(xs, cs)])
    assert [r[0] for r in clips.select(text).collect()] == ["2", "0before", "0"]
    assert [r[0] for r in clips.select(hooks.recognise(F.col("x"), F.col("c"), None)).collect()] == ["", "", ""]
