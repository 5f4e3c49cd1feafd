"""Finite vectors of one width as matrices of whole numbers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """(_id, _v, others) of the rows whose vector has no null, NaN or infinite component. Of vectors of several widths the
    commonest width stays, of equally common ones the widest."""
    good = F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), *others).filter((F.size("_v") > 0) & good)
    widths = rows.groupBy(F.size("_v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.filter(F.size("_v") == (widths.w if widths else 0))


def scaled(vectors: pa.Array, scale: int, limit: int) -> np.ndarray:
    """floor(scale * component) of a batch of equally wide vectors, a row each; beyond +-limit it is the limit."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // max(1, len(vectors))
    return np.clip(np.floor(flat * scale), -limit, limit).astype(np.int64).reshape(len(vectors), width)


def matrices(batches: Iterator[pa.RecordBatch], scale: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch that has rows, with the matrix of its column _v."""
    for batch in batches:
        if batch.num_rows:
            yield batch, scaled(batch.column("_v"), scale, limit)
