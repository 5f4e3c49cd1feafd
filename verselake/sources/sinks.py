"""Writers: split manifests, corpus tables with idempotent keys, transcript bundles, pitch tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verselake.functions import text as X


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines by split; absent fields are left out of a line."""
    rows.filter("split is not null").write.partitionBy("split").mode("overwrite").option("ignoreNullFields", True).json(path)


def append_new(rows: DataFrame, path: str, key: str = "file_name") -> DataFrame:
    """Append the rows whose key isn't in the table at ``path`` (of one key one row), and return them as written."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def bundle_names(rows: DataFrame, stamp: str, title: str, id_col: str) -> DataFrame:
    """rows that have text, with a file stem of stamp and slug that no other row of one stem shares (-2, -3, ...)."""
    base = F.concat_ws("-", F.date_format(stamp, "yyyyMMdd-HHmmss"), F.nullif(X.slug(F.col(title)), F.lit("")))
    kept = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_stem", base)
    place = F.row_number().over(Window.partitionBy("_stem").orderBy(id_col))
    return kept.withColumn("stem", F.when(place == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit("-"), place.cast("string")))).drop("_stem")


def bundle_json(title: Column | str, created: Column | str, blocks: Column | str) -> Column:
    return F.to_json(F.struct(F.col(title).alias("title"), F.col(created).alias("createdAt"), F.col(blocks).alias("blocks")))


def write_bundles(rows: DataFrame, path: str) -> None:
    """Named bundles, one folder for each stem."""
    rows.select("stem", F.col("text").alias("value")).write.partitionBy("stem").mode("overwrite").text(path)


def csv_cell(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def pitch_csv(rows: DataFrame, by: str) -> DataFrame:
    """(by, csv) with a blank line between blocks; rows have block, pos, time_seconds, hz, intensity, text."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws(",", number("time_seconds"), number("hz"), number("intensity"), csv_cell("text"))
    blocks = rows.groupBy(by, "block").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("s"))
    texts = blocks.select(by, "block", F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("b"))
    whole = texts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("block", "b"))).alias("s"))
    return whole.select(by, F.concat(F.lit("time_seconds,hz,intensity,text\n"), F.array_join(F.transform("s", lambda x: x["b"]), "\n\n")).alias("csv"))


def report(metrics: DataFrame, model: str, source: str) -> DataFrame:
    """One row with the nested report: model to source to its metrics."""
    values = [c for c in metrics.columns if c not in (model, source)]
    per_source = metrics.groupBy(model).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, F.struct(*values).alias("m"))))).alias("s"))
    return per_source.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(model, "s"))))).alias("report"))
