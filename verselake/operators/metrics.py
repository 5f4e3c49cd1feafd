"""Recognition-quality metrics over (ref, hyp) rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from verselake.functions import text as T
from verselake.operators.edits import edit_counts

EDITS = StructType([StructField(n, LongType()) for n in ("hits", "subs", "dels", "ins")])


def cer(ref: str = "ref", hyp: str = "hyp") -> Column:
    """Micro character error rate: all edits over all reference characters."""
    return F.sum(F.levenshtein(ref, hyp)) / F.nullif(F.sum(F.length(ref)), F.lit(0))


def wer_compat(ref: str = "ref", hyp: str = "hyp") -> Column:
    """Share of rows that differ at all: a word error rate over texts that scoring left without spaces."""
    return F.avg((F.col(ref) != F.col(hyp)).cast("double"))


@pandas_udf(EDITS)
def edit_path(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Edit counts of two texts by character."""
    rows = [edit_counts(r or "", h or "") for r, h in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["hits", "subs", "dels", "ins"], dtype="int64")


@pandas_udf(EDITS)
def token_edit_path(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Edit counts of two arrays of words."""
    rows = [edit_counts(list(r) if r is not None else [], list(h) if h is not None else []) for r, h in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["hits", "subs", "dels", "ins"], dtype="int64")


def error_rates(df: DataFrame, by: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Character CER and MER, exact-match rate and token WER of each group, texts taken as they are."""
    pathed = df.withColumn("_p", edit_path(ref, hyp)).withColumn("_w", token_edit_path(T.score_tokens(ref), T.score_tokens(hyp)))
    edits = lambda p: F.sum(F.col(f"{p}.subs") + F.col(f"{p}.dels") + F.col(f"{p}.ins"))
    total = lambda p: edits(p) + F.sum(f"{p}.hits")
    words = F.sum(F.col("_w.hits") + F.col("_w.subs") + F.col("_w.dels"))
    return pathed.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(cer(ref, hyp), 5).alias("cer"),
        F.round(edits("_p") / F.nullif(total("_p"), F.lit(0)), 5).alias("mer"),
        F.round(wer_compat(ref, hyp), 5).alias("wer_compat"),
        F.round(edits("_w") / F.nullif(words, F.lit(0)), 5).alias("wer_token"),
    )


def hallucination_stats(df: DataFrame, by: list[str], no_speech_at: float, rms_at: float) -> DataFrame:
    """Rates over rows (hyp, no_speech_prob, rms): text at all, credit lines, and text that the gate lets through."""
    hyp = F.trim(F.coalesce("hyp", F.lit("")))
    said = hyp != ""
    rate = lambda c: F.round(F.avg(c.cast("double")), 5)
    dropped = T.should_drop(hyp, "no_speech_prob", "rms", no_speech_at, rms_at)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        rate(said).alias("nonempty_rate"),
        rate(said & T.is_credit(hyp)).alias("credit_rate"),
        rate(said & ~dropped).alias("post_gate_leak_rate"),
    )


def rtf(decode: str, audio: str) -> Column:
    return F.round(F.sum(decode) / F.nullif(F.sum(audio), F.lit(0.0)), 4)


def against_baseline(metrics: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """Relative gain over the baseline for each key that both have."""
    base = baseline.select(key, F.col(value).alias("baseline"))
    return metrics.select(key, value).join(base, key).withColumn("gain", (F.col("baseline") - F.col(value)) / F.nullif("baseline", F.lit(0.0)))


def matched_time_errors(pred: list[dict], gold: list[dict], same=lambda t: t) -> list[float]:
    """Start and end errors in ms of words that match in order: each gold word takes the next predicted one of its text."""
    errors, at = [], 0
    for g in gold:
        target = same(g["word"] or "")
        found = next((k for k in range(at, len(pred)) if target and same(pred[k]["word"] or "") == target), None)
        if found is None:
            continue
        for edge in ("start", "end"):
            if pred[found][edge] is not None and g[edge] is not None:
                errors.append(abs(pred[found][edge] - g[edge]) * 1000.0)
        at = found + 1
    return errors


def alignment_error_ms(pred: Column, gold: Column) -> Column:
    """Median of ``matched_time_errors`` of two arrays of (word, start, end), to one decimal; null without a match."""

    @pandas_udf("double")
    def run(p: pd.Series, g: pd.Series) -> pd.Series:
        out = [matched_time_errors([dict(w) for w in a], [dict(w) for w in b], lambda t: t.strip().lower()) for a, b in zip(p, g)]
        return pd.Series([round(float(np.median(e)), 1) if e else None for e in out], dtype="float64")

    return run(pred, gold)


def median_of_medians(errors: DataFrame, by: list[str], clip: str, value: str) -> DataFrame:
    """(by, error_ms, n) to one decimal: the median over clips of each clip's median; clips without a value don't count."""
    clips = errors.groupBy(*by, clip).agg(F.median(value).alias("_m")).filter("_m is not null")
    return clips.groupBy(*by).agg(F.round(F.median("_m"), 1).alias("error_ms"), F.count("*").alias("n"))


def tallies(checks: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many checks are ok, warn or fail, and an exit code that is 1 if one fails."""
    count = lambda s: F.count_if(F.col(status) == s)
    return checks.agg(count("ok").alias("ok"), count("warn").alias("warn"), count("fail").alias("fail"), (count("fail") > 0).cast("int").alias("exit_code"))
