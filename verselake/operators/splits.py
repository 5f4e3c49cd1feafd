"""Leakage-safe splits: test speakers share no clip with training, dev speakers and songs are drawn by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verselake.session import written

#: Places (from 1) in the order of non-test speakers by clip count that become the dev set.
DEV_RANKS = (10, 12)
NEGATIVE_TEST, NEGATIVE_DEV = 30, 10


def speaker_split(clips: DataFrame, test_stems: DataFrame, speakers: DataFrame, dev_ranks: tuple[int, int] = DEV_RANKS) -> DataFrame:
    """clips (stem, ...) with (speaker, split, drop_reason). ``speakers`` maps stem to speaker; a clip of a test speaker
    that isn't itself a test clip leaks a voice and gets no split. Ranks are made over one row for each speaker, never over clips."""
    known = speakers.groupBy("stem").agg(F.max("speaker").alias("speaker"))
    test = test_stems.select("stem").distinct().withColumn("_test", F.lit(True))
    test_speakers = known.join(test, "stem").select("speaker").distinct().withColumn("_heard", F.lit(True))
    counts = known.groupBy("speaker").agg(F.count("*").alias("_n"))
    free = counts.join(test_speakers, "speaker", "left_anti")
    # The dev speakers are a slice of fixed length near the top, so a top-k is enough.
    top = free.orderBy(F.desc("_n"), "speaker").limit(dev_ranks[1])
    rank = F.row_number().over(Window.orderBy(F.desc("_n"), "speaker"))
    dev = top.withColumn("_r", rank).filter(F.col("_r").between(*dev_ranks)).select("speaker", F.lit(True).alias("_dev"))
    joined = (
        clips.join(known, "stem", "left")
        .withColumn("speaker", F.coalesce("speaker", F.lit("")))
        .join(test, "stem", "left")
        .join(test_speakers, "speaker", "left")
        .join(F.broadcast(dev), "speaker", "left")
    )
    split = F.when(F.col("_test"), "test").when(F.col("_heard"), None).when(F.col("_dev"), "dev").otherwise("train")
    return (
        joined.withColumn("split", split)
        .withColumn("drop_reason", F.when(F.col("split").isNull(), "speaker_leak"))
        .drop("_test", "_heard", "_dev")
    )


def report(split_rows: DataFrame, by: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """Counts of each source by split, zero where there are none."""
    return split_rows.groupBy(by).pivot("split", list(splits)).count().na.fill(0, list(splits))


def drop_reasons(split_rows: DataFrame) -> DataFrame:
    return split_rows.filter("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


def speakers_by_split(split_rows: DataFrame) -> DataFrame:
    return split_rows.filter("split is not null").groupBy("split").agg(F.count_distinct(F.when(F.col("speaker") != "", F.col("speaker"))).alias("speakers"))


def last_songs(rows: DataFrame, song: str, test: int = 2, dev: int = 2) -> DataFrame:
    """rows with split: the last songs in order are test, those before them dev. Only the last few songs are ranked."""
    top = rows.select(song).distinct().orderBy(F.desc(song)).limit(test + dev)
    place = F.row_number().over(Window.orderBy(F.desc(song)))
    held = top.withColumn("_p", place).select(song, F.when(F.col("_p") <= test, "test").otherwise("dev").alias("_s"))
    return rows.join(F.broadcast(held), song, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")


def by_rank(rows: DataFrame, key: str, test: int = NEGATIVE_TEST, dev: int = NEGATIVE_DEV) -> DataFrame:
    """rows with split: the first keys in order are test, the next dev, the rest train; keys are unique."""
    head = rows.select(key).orderBy(key).limit(test + dev)
    place = F.row_number().over(Window.orderBy(key))
    held = head.withColumn("_p", place).select(key, F.when(F.col("_p") <= test, "test").otherwise("dev").alias("_s"))
    return rows.join(F.broadcast(held), key, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")


def route_source(stem: str):
    """Kind of a clip by the prefix of its id."""
    kinds = {"cv_": "nan", "mir1k_": "mir1k", "jamendo_": "jamendo", "speech_": "speech", "neg_": "negatives"}
    out = F.lit("unknown_prefix")
    for prefix, kind in kinds.items():
        out = F.when(F.col(stem).startswith(prefix), kind).otherwise(out)
    return out


def keep_text_rows(rows: DataFrame, stem: str = "stem", text: str = "text", compat: bool = True) -> DataFrame:
    """rows with (negative, drop_reason): an empty text is a label for negatives and a defect for all others. In compat
    mode only the id's prefix makes a negative; otherwise a ``negative`` column of the rows does as well."""
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    marked = F.col(stem).startswith("neg_")
    if not compat and "negative" in rows.columns:
        marked = marked | F.coalesce("negative", F.lit(False))
    return rows.withColumn("negative", empty & marked).withColumn("drop_reason", F.when(empty & ~marked, "empty_text"))


def numbered(rows: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """rows with their place (from 0) in the order of a key. Rows are dealt by ranges and numbered within each; only one
    count for each range meets in one place."""
    keys = [key] if isinstance(key, str) else key
    ranged = written(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + place).drop("_range", "_start")


def oversample(rows: DataFrame, minority: str, key: str, ratio: float) -> DataFrame:
    """rows in which the minority repeats in cycles, by its place in the order of the key, until it is 1/ratio of the
    others; ``copy`` counts the repeats of a row from 0."""
    n_min, n_all = rows.agg(F.count_if(F.col(minority)), F.count("*")).first()
    others = rows.filter(~F.coalesce(F.col(minority), F.lit(False))).withColumn("copy", F.lit(0))
    if not n_min:
        return others
    target = max(n_min, int((n_all - n_min) // ratio))
    small = numbered(rows.filter(minority), key, "_i")
    last = F.floor((F.lit(target) - F.col("_i") - 1) / F.lit(n_min)).cast("int")
    return others.unionByName(small.select("*", F.explode(F.sequence(F.lit(0), last)).alias("copy")).drop("_i"))


def hash_sample(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly floor(n * fraction) rows, those with the least hashes of the key. Places are counted by ranges of the hash, so
    the sample may be of any size."""
    placed = numbered(rows.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed))), ["_hash", key], "_place")
    return placed.filter(F.col("_place") < int(rows.count() * fraction)).select(*rows.columns)


def first_per_source(rows: DataFrame, source: str, order: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each source in order; all of them without a limit."""
    if not limit:
        return rows
    place = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return rows.withColumn("_r", place).filter(F.col("_r") <= limit).drop("_r")


def validated_or_all(validated: DataFrame | None, *parts: DataFrame) -> DataFrame:
    """The validated list if there is one, else the union of the other lists; columns by name."""
    if validated is not None or not parts:
        return validated
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def manifest_union(packed: DataFrame, *rest: DataFrame) -> DataFrame:
    """Packed and single rows in one manifest; a column that a side lacks is null."""
    return validated_or_all(None, packed, *rest)
