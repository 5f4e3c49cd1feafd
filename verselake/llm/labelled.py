"""Labelled samples of bounded size, and the fold rule that keeps rows out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier learns from at most, and the longest text among them (longer ones are scored, but
#: not learned from).
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 200_000


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS,
    balanced: bool = False,
) -> list[tuple[str, int]]:
    """Up to ``rows`` (text, label) pairs outside the held-out fold, drawn by hash of the id; if balanced, up to half as
    many of each label."""
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).alias("_label"))
    )
    first = lambda df, n: df.orderBy(F.xxhash64("_id"), "_id").limit(n)
    drawn = first(known.filter("_label = 1"), rows // 2).union(first(known.filter("_label = 0"), rows // 2)) if balanced else first(known, rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # The limit above bounds the broadcast side and, with one text for each id, what is collected.
    found = texts.filter(F.length("_text") <= SAMPLE_CHARS).join(F.broadcast(drawn), "_id").dropDuplicates(["_id"])
    return [(r["_text"], int(r["_label"])) for r in found.orderBy("_id").collect()]
