"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, in whole numbers.

The codebooks of all parts are small and of fixed size, so tasks get them whole. An Arrow batch finds all distances of a
part by |x|^2 - 2 x.c + |c|^2 with exact 64-bit matrix products, and takes the first of the least. A round sends one row
for each used entry from each task: counts and sums are merged by a grouped shuffle, and the driver sees one row for
each entry of each part, whatever the number of vectors.

Defined results: a vector that is null, empty, or holds a null or non-finite component is dropped, and so is one that hasn't the
commonest width; components beyond +-LIMIT / SCALE count as that; of one id the least vector can start an entry, and the rows
without an id can start one entry, after all others; repeated rows are coded one by one; fewer ids than entries give fewer
entries; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verselake.llm import skew
from verselake.llm.vectors import finite, matrices
from verselake.session import written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Distances of vectors of up to 64 components within this fit 64 bits.
LIMIT = 1 << 27


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part of each vector; x is (vectors, parts, width), books (parts, entries, width)."""
    index = np.empty(x.shape[:2], np.int64)
    least = np.empty(x.shape[:2], np.int64)
    norms = (books * books).sum(axis=2)
    for p, book in enumerate(books):
        apart = norms[p] - 2 * (x[:, p] @ book.T)
        index[:, p] = apart.argmin(axis=1)
        least[:, p] = np.take_along_axis(apart, index[:, p, None], 1)[:, 0]
    return index, least + (x * x).sum(axis=2)


def first_vectors(rows: DataFrame, count: int) -> list[list[float]]:
    """The least vector of each of the least ids. A pass takes the first rows after the last id, so only an id with very many
    rows needs more than one."""
    found: list[list[float]] = []
    rest = rows.filter("_id is not null")
    while len(found) < count:
        some = rest.orderBy("_id", "_v").limit(count).select("_id", "_v").collect()
        if not some:
            break
        firsts: dict = {}
        for r in some:
            firsts.setdefault(r["_id"], r["_v"])
        found += firsts.values()
        rest = rows.filter(F.col("_id") > F.lit(some[-1]["_id"]))
    if len(found) < count:
        found += [r["_v"] for r in rows.filter("_id is null").orderBy("_v").limit(1).select("_v").collect()]
    return found[:count]


def _sums(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums) of the entries that a task's vectors are nearest to."""
    parts, entries, width = books.shape
    count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for _, x in matrices(batches, SCALE, LIMIT):
        x = x.reshape(len(x), parts, width)
        index, _ = nearest(x, books)
        for p in range(parts):
            count[p] += np.bincount(index[:, p], minlength=entries)
            for j in range(width):
                # Sums of a batch of whole numbers this small are exact as doubles.
                total[p, :, j] += np.bincount(index[:, p], x[:, p, j], minlength=entries).astype(np.int64)
    at = np.nonzero(count)
    columns = [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of rows of ``finite``; None without rows."""
    start = first_vectors(rows, entries)
    if not start:
        return None
    if len(start[0]) % parts:
        raise ValueError(f"vectors of {len(start[0])} components have no {parts} equal parts")
    books = np.clip(np.floor(np.array(start) * SCALE), -LIMIT, LIMIT).astype(np.int64)
    books = books.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("_v").mapInArrow(lambda b, books=books: _sums(books, b), "part int, entry int, n long, sums array<long>")
        merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", j)).alias(f"s{j}") for j in range(books.shape[2])))
        for r in merged.collect():  # at most parts * entries rows
            books[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(books.shape[2])]
    return books


def _coded(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch, x in matrices(batches, SCALE, LIMIT):
        index, apart = nearest(x.reshape(len(x), parts, width), books)
        codes = [r.tobytes().hex() for r in index.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(codes), pa.array(apart.sum(axis=1))], ["_id", "_label", "code", "error"])


def with_label_sums(rows: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """rows with the sum of a value over equal labels, nulls together."""
    sums = rows.groupBy(F.col(label).alias("_l")).agg(F.sum(value).alias(out), F.count("*").alias("_n"))
    return skew.join(rows, sums, [], "_n", rows.count(), same=F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(_id, _label, code, error) of rows (_id, _v, _label)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long"
    return rows.select("_id", "_v", "_label").mapInArrow(lambda b: _coded(books, b), schema)


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code", out: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for, as doubles."""

    def run(batches):
        for batch in batches:
            hexes = batch.column(batch.schema.get_field_index(code_col)).to_pylist()
            at = [list(bytes.fromhex(c)) if c is not None else None for c in hexes]
            vectors = [None if k is None else (books[np.arange(len(k)), k].reshape(-1) / SCALE).tolist() for k in at]
            yield batch.append_column(out, pa.array(vectors, pa.list_(pa.float64())))

    return codes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + f", `{out}` array<double>")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of each vector that is kept."""
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    rows = finite(df, id_col, vector_col, label.alias("_label"))
    books = trained(rows, parts, entries, rounds)
    if books is None:
        none = rows.select(F.col("_id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return none.limit(0)
    coded = written(encode(rows, books), "codes")
    summed = with_label_sums(coded, "_label", "error", "label_error")
    return summed.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
