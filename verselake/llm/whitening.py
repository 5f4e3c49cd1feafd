"""Embedding whitening by cyclic Jacobi rotations.

Components are whole numbers x = floor(SCALE * c) + SHIFT. Tasks add up n and the sums S; the driver rounds the mean to a whole
number m, and a second pass adds up products of the centred y = x - m exactly. With r = S - n * m, the covariance is
(n * sum(y_i * y_j) - r_i * r_j) / n^2, a quotient of whole numbers that is rounded once; the large shift never enters a
product. The driver, whose matrix has the width of a vector, rotates pairs of dimensions until no off-diagonal counts
beside its diagonal entries, which keeps small eigenvalues accurate. Tasks get the projection whole. A third
pass measures the covariance of what is returned.

Defined results: a vector that is null, empty, or holds a null or non-finite component is dropped, and so is one that hasn't the
commonest width; |floor(SCALE * c)| counts as LIMIT at most; repeated rows count each; rows without an id are kept; a component without
variance (fewer vectors than dimensions, or equal vectors) is 0 for every row and isn't measured; a deviation
that no long can hold is null; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verselake.llm.vectors import finite, matrices

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMIT = 1 << 30
#: An off-diagonal entry counts if it is above this share of the geometric mean of its two diagonal entries.
SMALL = 1e-16
SWEEPS = 60
#: Rows whose components are made at once.
PART_ROWS = 4096


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    a, vectors = np.array(matrix, float), np.eye(len(matrix))
    for _ in range(SWEEPS):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= SMALL * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                # tan of the angle: the smaller root of t^2 + 2 * cot(2 * angle) * t - 1.
                cot = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if cot >= 0 else -1.0) / (abs(cot) + np.hypot(1.0, cot))
                c = 1 / np.hypot(1.0, t)
                turn = np.array([[c, t * c], [-t * c, c]])
                pair, edge = [p, q], t * a[p, q]
                low, high = a[p, p] - edge, a[q, q] + edge
                a[:, pair] = a[:, pair] @ turn
                a[pair] = a[:, pair].T
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
                vectors[:, pair] = vectors[:, pair] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return np.diag(a)[order], vectors * np.sign(vectors[top, np.arange(len(top))])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, n, s): rows and sum of each dimension of a task's vectors, without the shift."""
    n, sums = 0, 0
    for _, x in matrices(batches, SCALE, LIMIT):
        n, sums = n + len(x), sums + x.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array(sums)], ["i", "n", "s"])


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers as Python's whole numbers, by the fastest kind of number that can't round or overflow."""
    bound = max(1, int(np.abs(y).max())) ** 2 * len(y)
    if bound < 1 << 53:
        y = y.astype(float)
    elif bound >= 1 << 63:
        y = y.astype(object)
    return (y.T @ y).astype(np.int64 if bound < 1 << 63 else object).astype(object)


def _scatter(mean: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, s), i <= j: sums of products of a task's centred vectors."""
    total, rows = 0, 0
    for _, x in matrices(batches, SCALE, LIMIT):
        total, rows = total + exact_products(x - mean), rows + len(x)
    if rows:
        i, j = np.triu_indices(len(mean))
        sums = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), sums], ["i", "j", "s"])


class Whitening:
    """What a pass needs: n, the mean in two parts, r = S - n * mean, the projection and the explained shares."""

    def __init__(self, n: int, mean: np.ndarray, rest: list[int], products: np.ndarray, components: int):
        width = len(mean)
        cov = np.array([[(n * products[i, j] - rest[i] * rest[j]) / (n * n) for j in range(width)] for i in range(width)], float)
        values, vectors = jacobi(cov)
        trace = float(np.trace(cov))
        self.n, self.mean, self.rest = n, mean, rest
        count = min(components, width)
        e = values[:count]
        self.live = e > trace * width * np.finfo(float).eps
        self.projection = np.where(self.live, vectors[:, :count] / np.sqrt(np.where(self.live, e, 1.0)), 0.0)
        self.explained = np.maximum(e, 0) / trace if trace > 0 else np.zeros(count)
        self.offset = np.array([r / n for r in rest], float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) - self.offset) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 over the dimensions, exact; it is n^2 * sum(y^2) - 2 * n * sum(y * r) + sum(r^2)."""
        y, n = x - self.mean, self.n
        small = max(1, int(np.abs(y).max(initial=0))) * len(self.mean) * max(1, *map(abs, self.rest), int(np.abs(y).max(initial=0))) < 1 << 63
        kind = np.int64 if small else object
        squares, crossed = (y.astype(kind) ** 2).sum(axis=1), y.astype(kind) @ np.array(self.rest, kind)
        last = sum(r * r for r in self.rest)
        exact = (n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, crossed))
        return [d if d < 1 << 63 else None for d in exact]


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows of ``finite``, from two passes; None without rows."""
    sums = rows.select("_v").mapInArrow(_totals, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r.i: r for r in sums.collect()}  # a row for each dimension
    if not found:
        return None
    n, sums = found[0].n, [int(found[i].s) for i in range(len(found))]
    mean = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(mean, np.int64)
    parts = rows.select("_v").mapInArrow(lambda b: _scatter(centre, b), "i int, j int, s decimal(38,0)")
    products = np.zeros((len(mean), len(mean)), object)
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # half a square of the width
        products[r.i, r.j] = products[r.j, r.i] = int(r.s)
    return Whitening(n, centre, [s - n * m for s, m in zip(sums, mean)], products, components)


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, over the components that have variance."""
    live = np.flatnonzero(fit.live)
    if not len(live):
        return 0.0

    def run(batches):
        total, sums, seen = 0.0, 0.0, 0
        for _, x in matrices(batches, SCALE, LIMIT):
            z = fit.whitened(x)[:, live]
            total, sums, seen = total + z.T @ z, sums + z.sum(axis=0), seen + len(z)
        if seen:
            i, j = np.triu_indices(len(live))
            k = np.arange(len(live))
            columns = [np.concatenate([i, k]), np.concatenate([j, np.full(len(k), -1)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(np.concatenate([total[i, j], sums]))], ["i", "j", "s"])

    merged = rows.select("_v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    found = {(r.i, r.j): r.s / fit.n for r in merged}
    return max(abs(v - found[i, -1] * found[j, -1] - (i == j)) for (i, j), v in found.items() if j >= 0)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component from 1, n, deviation, whitened, explained, identity_error) of each kept vector and component."""
    rows = finite(df, id_col, vector_col)
    fit = fitted(rows, components)
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, fit)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    count = len(fit.explained)

    def run(batches):
        for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
            for _, x in matrices([batch], SCALE, LIMIT):
                each = np.repeat(np.arange(len(x)), count)
                columns = [
                    batch.column("_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()), pa.array(np.full(len(each), fit.n)),
                    pa.array(fit.deviations(x), pa.int64()).take(pa.array(each)), pa.array(fit.whitened(x).reshape(-1)), pa.array(np.tile(fit.explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("_id", "_v").mapInArrow(run, schema)
