"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes of the UTF-8 text is mixed into 64 bits; where its last k bits are all ones, a chunk of block size
2^k ends. The block size is the greatest with FEWEST boundaries or more, so it follows from the text alone and boundaries of a
block size are boundaries of all smaller ones; a text that repeats a passage so often that this gives more than MOST takes
the next block size. A fingerprint is ``k:chunks:chunks``: two letters (12 bits of a CRC) for each chunk at 2^k, and the
same at 2^(k+1); every byte is in one chunk of either. Two fingerprints are compared by edit distance over chunks at block
sizes that both have; their likeness is the best of 1 - distance / longer, and 0 where the block sizes are more than a
factor of 2 apart.

``with_neighbours`` fingerprints a text, an edited text that takes its end from the next document, and compares. Rows are dealt by
ranges of (id, hash of the text, place), so that a hot id is spread; a task streams its rows in order and leaves its
first and last row, whose neighbour another task has, as the two edges of its range, which meet in a second small step.

Defined results: a null text is an empty text; an empty text has the fingerprint ``1::`` and likeness 1 to an empty one, 0 to any
other; null ids come first; rows of one id are ordered by a hash of their text; a single document is its own next one;
repeated rows each have a result; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from verselake.operators.edits import distance
from verselake.session import written

WINDOW, LEAST = 7, 1
FEWEST, MOST = 32, 1024
#: Odd multipliers of the rolling hash and of its mixing.
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once.
SLAB = 1 << 18
#: Rows that are taken out of an Arrow batch at once.
PART_ROWS = 256
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def levels(data: bytes) -> np.ndarray:
    """How many last bits of the mixed rolling hash at each byte are ones; before the text stand zero bytes."""
    out = np.empty(len(data), np.uint8)
    padded = np.frombuffer(bytes(WINDOW - 1) + data, np.uint8)
    for a in range(0, len(data), SLAB):
        b = min(a + SLAB, len(data))
        x = padded[a : b + WINDOW - 1].astype(np.uint64)
        h = x[: b - a].copy()
        for k in range(1, WINDOW):
            h *= ROLL
            h += x[k : k + b - a]
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        out[a:b] = np.bitwise_count(h ^ (h + np.uint64(1))) - 1
    return out


def _signature(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *(ends + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    sums = (zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:]))
    return "".join(LETTERS[s & 63] + LETTERS[(s >> 6) & 63] for s in sums)


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    at = levels(data)
    reached = np.cumsum(np.bincount(at, minlength=66)[::-1])[::-1]
    size = max(LEAST, int(np.argmin(reached >= FEWEST)) - 1)
    size += int(reached[size] > MOST)
    ends = np.flatnonzero(at >= size)
    return f"{size}:{_signature(data, ends)}:{_signature(data, ends[at[ends] > size])}"


def likeness(one: str | None, other: str | None) -> float | None:
    """0 to 1; null where a fingerprint is null."""
    if one is None or other is None:
        return None
    if one == other:
        return 1.0
    both = []
    for f in (one, other):
        size, *signatures = f.split(":")
        both.append({int(size) + i: [s[k : k + 2] for k in range(0, len(s), 2)] for i, s in enumerate(signatures)})
    a, b = both
    longer = {k: max(len(a[k]), len(b[k])) for k in a.keys() & b.keys()}
    return max((1 - distance(a[k], b[k]) / n for k, n in longer.items() if n), default=0.0)


def fingerprint_column(text: Column) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fingerprint)

    return run(text.cast("string"))


def likeness_column(one: Column, other: Column) -> Column:
    @pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(one, other)


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many of the following text's first."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_DONE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _DONE.split(", ")]


def _result(text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    changed_print = own if changed == text else fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, own, changed_print, likeness(own, changed_print), likeness(own, next_print)


def _streamed(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a task's rows but the last; its first and last row with their texts as edges."""
    part, before = TaskContext.get().partitionId(), None
    types = [kind, *(pa.int64() if n == "n_chars" else pa.float64() if n.startswith("near") else pa.string() for n in _NAMES), pa.int32(), pa.string(), pa.string()]
    names = ["_id", *_NAMES, "_part", "_edge", "_t"]
    blank = (None,) * len(_NAMES)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
        rows = []
        for i, text in zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist()):
            own = fingerprint(text)
            if before is None:
                rows.append((i, *blank[:2], own, *blank[3:], part, "first", text))
            else:
                rows.append((before[0], *_result(before[1], before[2], text, own), part, None, None))
            before = i, text, own
        if rows:
            yield batch_of(rows)
    if before is not None:
        yield batch_of([(before[0], *blank[:2], before[2], *blank[3:], part, "last", before[1])])


def with_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row; the next document is
    the one after it in ascending order of the id, after the last the first."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    order = ["_id", "_h", "_m"]
    placed = rows.select("*", F.xxhash64("_t").alias("_h"), F.monotonically_increasing_id().alias("_m")).repartitionByRange(*order).sortWithinPartitions(*order)
    ids = placed.schema["_id"].dataType
    kind = to_arrow_type(ids)
    streamed = placed.select("_id", "_t").mapInArrow(lambda b: _streamed(kind, b), f"_id {ids.simpleString()}, {_DONE}, _part int, _edge string, _t string")
    table = written(streamed, "fingerprints")
    firsts, lasts = (table.filter(F.col("_edge") == e).select("_id", "_part", "fingerprint", "_t") for e in ("first", "last"))
    parts = sorted(r["_part"] for r in firsts.select("_part").collect())  # one number for each range
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "_part int, _next int")
    heads = firsts.select(F.col("_part").alias("_next"), F.col("_t").alias("_following"), F.col("fingerprint").alias("_print"))
    meeting = lasts.join(F.broadcast(after), "_part").join(heads, "_next").select("_id", "_t", "fingerprint", "_following", "_print")

    def finish(batches):
        for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
            found = [_result(*values) for values in zip(*(batch.column(c).to_pylist() for c in ("_t", "fingerprint", "_following", "_print")))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *map(pa.array, zip(*found))], ["_id", *_NAMES])

    closed = meeting.mapInArrow(finish, f"_id {ids.simpleString()}, {_DONE}")
    return table.filter("_edge is null").select("_id", *_NAMES).unionByName(closed).withColumnRenamed("_id", id_col)
