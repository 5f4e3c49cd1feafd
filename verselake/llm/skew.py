"""Joins on keys of which few may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT of the rows is hot; fewer than HOT keys can be, so their rows of a table may be broadcast.
HOT = 1000


def join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", same: Column | None = None) -> DataFrame:
    """rows joined (inner or left) with a table of unique keys, whose column ``count`` says how many of the ``total`` rows each
    key has. Hot keys meet by broadcast, the others by a shuffle in which none has more than 1/HOT of the rows. ``same`` is
    the condition if it isn't equality by name; the keys of both sides stay then. The column count goes."""
    on = keys if same is None else same
    hot = F.broadcast(table.filter(F.col(count) * HOT > total).drop(count))
    rest = table.filter(F.col(count) * HOT <= total).drop(count)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(rest, on, how))
