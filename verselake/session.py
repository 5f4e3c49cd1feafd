"""Session helpers: shipping the package to executors and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_verselake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), "verselake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("verselake", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._verselake_shipped = True


def scratch_uri(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or a local one where that is unset and everything
    runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="verselake-"))
    return _OWN_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_uri(spark)}/verselake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again: all that was made from them must be written itself."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out to every core, by columns or evenly, for costly work on few bytes: what is sized by its bytes alone ends in
    one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
