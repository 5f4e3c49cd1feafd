"""Voice vectors: unit length, similarity, and online clustering."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verselake.operators.folds import ordered_fold


def norm(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector over its length; null for a length of nearly zero or without a finite value."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.when((n > 1e-9) & ~F.isnan(n) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n))


def over_length(v: Column | str) -> Column:
    """Every vector over its length, by the rules of plain division: null components stay null and don't count, a length of
    zero or one that isn't a number leaves NaN. ``unit`` is what similarities are made from."""
    v = F.col(v) if isinstance(v, str) else v
    nothing = F.lit(float("nan"))
    scaled = lambda n: F.transform(v, lambda x: F.when(x.isNotNull(), F.when(n == 0, nothing).otherwise(x.cast("double") / n)))
    # An array of the one length, so that it is made once and not for each component.
    return F.get(F.transform(F.array(norm(F.filter(v, lambda x: x.isNotNull()))), scaled), 0)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Centroids that ``nearest`` takes at most; they become one literal array of the projection.
MOST_CENTROIDS = 1024


def nearest(vectors: DataFrame, centroids: DataFrame, id_col: str, vec: str, centroid_id: str) -> DataFrame:
    """(id, centroid_id, similarity): the best of a small set of centroids for each row (of equals the least id), inside the
    row: no join, no shuffle. A row without a usable vector has nulls."""
    table = centroids.select(F.col(centroid_id).alias("c"), unit(vec).alias("u")).filter("u is not null").orderBy("c").limit(MOST_CENTROIDS + 1).collect()
    if len(table) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    kind = centroids.schema[centroid_id].dataType
    options = F.lit(None).cast("array<struct<s:double,i:int>>")
    if table:
        options = F.array(*(F.struct(F.round(cosine("_v", F.lit([float(x) for x in r.u])), 9).alias("s"), F.lit(-i).alias("i")) for i, r in enumerate(table)))
    ids = F.array(*(F.lit(r.c).cast(kind) for r in table)) if table else F.lit(None).cast(f"array<{kind.simpleString()}>")
    best = F.when(F.col("_v").isNotNull(), F.array_max(options))
    found = vectors.select(id_col, unit(vec).alias("_v")).select(id_col, best.alias("_b"))
    return found.select(id_col, F.get(ids, -F.col("_b.i")).alias(centroid_id), F.col("_b.s").alias("similarity"))


class OnlineClusters:
    """Running centroids of one session; the same object serves the batch fold and the stream."""

    def __init__(self, most: int = 6, threshold: float = 0.75, sums: list | None = None, counts: list | None = None):
        self.most, self.threshold = max(1, most), threshold
        self.centroids = [np.array(s, float) for s in sums or []]
        self.counts = list(counts or [])

    def assign(self, vector) -> int | None:
        v = np.asarray(vector, float).ravel() if vector is not None else np.zeros(0)
        length = np.linalg.norm(v) if v.size and np.isfinite(v).all() else 0.0
        if length <= 1e-9:
            return None
        v = v / length
        near = np.array([v @ c for c in self.centroids])
        if not len(near) or (near.max() < self.threshold and len(near) < self.most):
            self.centroids.append(v)
            self.counts.append(1)
            return len(self.counts) - 1
        k = int(near.argmax())
        mixed = self.centroids[k] * self.counts[k] + v
        length = np.linalg.norm(mixed)
        if length > 1e-9:
            self.centroids[k] = mixed / length
        self.counts[k] += 1
        return k


class Clustered:
    """Online clusters as a fold over rows (order, vector)."""

    def __init__(self, most: int = 6, threshold: float = 0.75):
        self.clusters = OnlineClusters(most, threshold)

    def add(self, at, vector):
        return ((at, self.clusters.assign(vector)),)

    def finish(self):
        return ()


def online_clusters(vectors: DataFrame, session: str, order: str, vec: str, most: int = 6, threshold: float = 0.75) -> DataFrame:
    """(session, order, speaker) by a fold over each session's vectors in order; null for an unusable vector."""
    kind = vectors.schema[order].dataType.simpleString()
    return ordered_fold(vectors, [session], [order], [order, vec], partial(Clustered, most, threshold), f"`{order}` {kind}, speaker int")


def gate(windows: DataFrame, min_seconds: float, min_rms: float) -> DataFrame:
    """Windows long and loud enough to name a speaker."""
    return windows.filter(((F.col("end_seconds") - F.col("start_seconds")) >= min_seconds) & (F.col("rms") >= min_rms))


def keep_last(rows: DataFrame, by: list[str], order: list[str], n: int = 4) -> DataFrame:
    """A bounded queue that drops its oldest: the last n rows of each arrival batch."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
