"""Queries over odd rows, held to their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, table, rows, kinds):
    """Rows of a query and of its SQL over one table, as sorted texts: signs of zero and NaN count."""
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/{table}.parquet")
    got = [tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(str, got)), sorted(str(tuple(r)) for r in con.sql(entry.oracle_sql()[name]).fetchall())


def test_gloss_alone_gives_the_text_back(spark, tmp_path):
    texts = ["", " ", "(abc)", "（abc）", None, " hi (x)", "　word　", " m ", "a (b) c", "(1)", "((a))", "\n(abc)\n", "​zw"]
    got, want = both(spark, tmp_path, "gloss_strip", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want


def test_speech_at_the_thresholds(spark, tmp_path):
    values = [120.0, 200.0, 120.0, 119.99, 120.0, None, 200.0, None, 150.0, -5.0, 150.0, float("nan"), 150.0, -300.0, None, float("inf"), float("-inf"), 0.0]
    rows = [(u, i, values[(i * (u + 1)) % len(values)]) for u in range(4) for i in range(u * 100, u * 100 + 60)]
    got, want = both(spark, tmp_path, "detected_speech", "events", rows, "user_id long, event_id long, value double")
    assert got == want


def test_vectors_without_a_length(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.0, 0.0], [1e-12, 0.0], [3.0, None], [None, None], [], None, [nan, 1.0], [inf, 1.0, -1.0], [None, 0.0], [-0.0, 1.0], [-1e-8, 1.0], [1e-30, -1e-30]]
    got, want = both(spark, tmp_path, "unit_vectors", "embeddings", list(enumerate(vectors)), "vec_id long, embedding array<float>")
    assert got == want


def test_control_messages_of_large_ids(spark, tmp_path):
    """A rate beyond 32 bits is a bad rate, not the end of the job."""
    spark.createDataFrame([(i,) for i in (6, 9, 3_000_000, 5_999_997, 9_000_000_000_000)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.error, r.languages) for r in entry.queries()["control_messages"](spark, str(tmp_path)).collect()}
    assert got == {6: ("bad sample rate", "en,nan"), 9: (None, "en,nan")} | dict.fromkeys((3_000_000, 5_999_997, 9_000_000_000_000), ("bad sample rate", "en,nan"))


@pytest.mark.parametrize("name", ["segment_analysis", "timbre_bands", "spectrogram_tracks", "prepared_audio", "mel_features", "shifted_tones"])
def test_tones_are_dealt_to_all_cores(spark, tmp_path, name):
    """One small file of events is analysed by many tasks, each value once, and every event has a row."""
    values = [10.0, 57.5, 10.0, None, 400.25, 57.5]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    rows = {r[0]: tuple(map(str, r[1:])) for r in found.collect()}
    assert sorted(rows) == list(range(6)) and rows[0] == rows[2] and rows[1] == rows[5] and len({rows[0], rows[1], rows[4]}) > 1 - (name in ("timbre_bands", "spectrogram_tracks"))
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
