"""Sharding by vector bin packing.

Rows of one text are a group with a vector of bytes, tokens (words between white space) and rows. Groups are pooled by size
class and hash, so what the driver packs has a bound at every input size and pools of short and of long texts differ in
shape; a group above 1/HOT of all bytes, tokens or rows is packed on its own. Each item goes to the shard where the dot
product of its vector with the residual capacity is highest, largest items first; only shards that still have room for
the item's bytes are asked while there are any.

A group stays whole. The exception is one with more than ``ROOM`` of a shard's bytes, which the law (bytes near equal) doesn't
let any shard hold beside its share of the rest: it is cut by row hash into as few parts as fit. Rows and tokens never cut one.

Defined results: a null text has size 1 and the crc32 of an empty text; repeated rows are rows of their own; null ids
are kept (they come first in a shard's order within their pool); other columns are ignored, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verselake.session import written

SHARDS = 8
#: Hash pools of a size class (a power of two of bytes), and the number of classes.
POOLS, CLASSES = 128, 32
#: A group above 1/HOT of all bytes, tokens or rows is packed on its own; fewer than 3 * HOT such groups exist. Its rows are
#: numbered in slices of at most about that share, so no task sorts the whole of it.
HOT = 1024
#: Share of a shard's bytes that a whole group may take.
ROOM = 0.9


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``vectors``: bytes, tokens, rows)."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    residual = np.full((shards, share.shape[1]), 1.0 / shards)
    out = np.empty(len(vectors), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        score = residual @ share[i]
        fits = residual[:, 0] >= share[i, 0]
        best = np.where(fits, score, -np.inf) if fits.any() else residual[:, 0]
        out[i] = int(np.argmax(best))
        residual[out[i]] -= share[i]
    return out


def described(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.greatest(F.size(F.split(F.trim(text), r"\s+")), F.lit(1)).cast("long").alias("tokens"),
        F.md5(F.encode(text, "UTF-8")).alias("grp"),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.lit(1)).alias("has_text"),
    )


def heavy_groups(rows: DataFrame, hot: int, shards: int) -> DataFrame:
    """(grp, slices, parts) of the groups above 1/hot of anything: slices to number their rows by, parts to cut them into."""
    sums = lambda: (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = rows.agg(*sums()).first()
    share = F.greatest(*(F.col(c) / F.lit(max(1, total[c] or 0)) for c in "btn"))
    slices, parts = F.ceil(share * hot).cast("int"), F.ceil(F.col("b") / max(1, total["b"] or 0) * shards / ROOM).cast("int")
    heavy = rows.groupBy("grp").agg(*sums()).withColumn("share", share).filter(F.col("share") * hot > 1)
    return heavy.select("grp", slices.alias("slices"), parts.alias("parts"))


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, pools: int = POOLS, hot: int = HOT) -> DataFrame:
    """(id_col, size, text_crc32, tokens, shard, slot) of each row; slots of a shard are 0, 1, 2..."""
    spark = df.sparkSession
    rows = written(described(df, id_col, text_col), "described")
    # Fewer than 3 * hot rows by construction, safe to broadcast.
    heavy = F.broadcast(heavy_groups(rows, hot, shards))
    size_class = F.least(F.floor(F.log2("size")), F.lit(CLASSES - 1))
    light = F.concat_ws("/", F.lit("p"), size_class, F.pmod(F.xxhash64("grp"), F.lit(pools)))
    pooled = rows.join(heavy, "grp", "left").select(
        *rows.columns,
        F.when(F.col("slices").isNull(), light).otherwise(F.col("grp")).alias("pool"),
        F.coalesce(F.pmod(F.xxhash64("_id", F.lit("slice")), F.col("slices")), F.lit(0)).cast("int").alias("slice"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
    )
    sums = pooled.groupBy("pool", "slice").agg(F.max("parts").alias("parts"), F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    slices = sums.orderBy("pool", "slice").collect()  # at most CLASSES * pools, and 6 * hot slices of heavy groups
    items: dict[tuple[str, int], np.ndarray] = {}
    for r in slices:
        item = (r.pool, r.slice % r.parts)
        items[item] = items.get(item, np.zeros(3)) + (r.b, r.t, r.n)
    shard_of = dict(zip(items, pack(np.array([*items.values()]).reshape(-1, 3), shards).tolist()))
    begin, placed = [0] * shards, []
    for r in slices:
        s = shard_of[r.pool, r.slice % r.parts]
        placed.append((r.pool, r.slice, s, begin[s]))
        begin[s] += r.n
    plan = F.broadcast(spark.createDataFrame(placed, "pool string, slice int, shard int, begin long"))
    order = Window.partitionBy("pool", "slice").orderBy("_id", "text_crc32", "size", "has_text")
    return pooled.join(plan, ["pool", "slice"]).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        "tokens",
        "shard",
        (F.col("begin") + F.row_number().over(order) - 1).cast("long").alias("slot"),
    )
