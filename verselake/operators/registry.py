"""The model registry as a table: tolerant reading, upsert that keeps places, shadowed union, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("asr", "voice", "translate", "enhance")
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def valid(entries: DataFrame, kinds=KINDS) -> DataFrame:
    """Entries with a well-formed id, a model and a known kind; of one id the first."""
    good = entries.filter(F.col("id").rlike(ID_PATTERN) & (F.trim("model") != "") & F.col("kind").isin(*kinds))
    return first_wins(good, ["id"], "pos")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """table with changed rows in their old places and new ones after the last."""
    last = table.agg(F.coalesce(F.max(pos), F.lit(-1)).alias("_last"))
    others = [c for c in table.columns if c not in (key, pos)]
    both = table.join(changes.select(key, F.col(pos).alias("_p"), *(F.col(c).alias(f"_{c}") for c in others), F.lit(True).alias("_has")), key, "full_outer")
    both = both.join(F.broadcast(last))
    new = [F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in others]
    return both.select(key, F.coalesce(F.col(pos), F.col("_last") + 1 + F.col("_p")).alias(pos), *new)


def remove(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def with_shadow(presets: DataFrame, deployed: DataFrame) -> DataFrame:
    """Presets, then the deployed entries whose id and model no preset has; of one id or one model the first."""
    own = first_wins(first_wins(deployed, ["id"], "pos"), ["model"], "pos")
    fresh = own.join(presets.select("id"), "id", "left_anti").join(presets.select("model"), "model", "left_anti")
    columns = [*presets.columns, "origin"]
    return presets.withColumn("origin", F.lit("preset")).select(columns).unionByName(fresh.withColumn("origin", F.lit("deployed")).select(columns))


def active(models: DataFrame, model: str, default: str = "current") -> DataFrame:
    """One row with the id of a model, or the default."""
    return models.agg(F.coalesce(F.min_by(F.when(F.col("model") == model, F.col("id")), F.when(F.col("model") == model, F.col("pos"))), F.lit(default)).alias("active"))


def missing_files(present, required):
    """Names that are required and not there."""
    return F.array_except(F.array(*map(F.lit, required)), present)


def favourites_first(voices: DataFrame) -> DataFrame:
    return voices.orderBy(F.desc("favorite"), F.desc("created_at"), "id")
