"""Extractive summaries: sentences ranked by the mean frequency, within the document, of their characters."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verselake.functions import text as T

MOST_SENTENCES = 20


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, sentence), idx from 0."""
    return docs.select(id_col, F.posexplode(T.sentences(text_col)).alias("idx", "sentence"))


def sentence_scores(sentences: list[str]) -> list[float | None]:
    """For each sentence the mean of the document's counts of its informative characters, None where it has none."""
    bare = [s.translate(_DROPPED) for s in sentences]
    count = Counter("".join(bare))
    return [sum(map(count.__getitem__, b)) / len(b) if b else None for b in bare]


_DROPPED = dict.fromkeys(map(ord, T.SUMMARY_IGNORED))


def chosen(sentences: list[str], k: int) -> list[str]:
    """The k best sentences in reading order; all of them where there are no more than k, the first k where none has a score."""
    if len(sentences) <= k:
        return sentences
    score = sentence_scores(sentences)
    known = [i for i, x in enumerate(score) if x is not None]
    best = sorted(known, key=lambda i: (-round(score[i], 9), i))[:k] if known else range(k)
    return [sentences[i] for i in sorted(best)]


def summarize(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """(id, summary) of each row with a sentence: its k (1 to MOST_SENTENCES) best sentences, of its first ``max_chars``
    characters if those are given. All counts are inside the document, so nothing is shuffled."""
    k = max(1, min(k, MOST_SENTENCES))

    @pandas_udf("string")
    def best(sentences: pd.Series) -> pd.Series:
        return sentences.map(lambda s: "".join(chosen(list(s), k)))

    text = F.col(text_col) if max_chars is None else F.substring(text_col, 1, max_chars)
    cut = docs.select(id_col, T.sentences(text).alias("_s")).filter(F.size("_s") > 0)
    return cut.select(id_col, best("_s").alias("summary"))
