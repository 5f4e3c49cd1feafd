"""Ordered folds: the rows of a key in their order stream past a small state, so no task holds a whole key."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold(Protocol):
    def add(self, *values) -> Iterable[tuple]:
        """Rows that are complete once this row is seen."""

    def finish(self) -> Iterable[tuple]:
        """Rows that the end of the key completes."""


def ordered_fold(df: DataFrame, by: list[str], order: list[str], inputs: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """(by, schema): what ``make``'s fold gives for each key, from ``inputs`` of its rows in order. One shuffle by the key and
    a sort inside partitions; nulls are a key of their own."""
    names = {f.name: f.dataType.simpleString() for f in df.select(*by).schema}
    full = ", ".join(f"`{c}` {names[c]}" for c in by) + f", {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(full))
    placed = df.repartition(*by).sortWithinPartitions(*by, *order).select(*by, *inputs)
    n = len(by)

    def run(batches):
        key, state = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else ((),) * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or values[:n] != key:
                    if state is not None:
                        rows += [(*key, *r) for r in state.finish()]
                    key, state = values[:n], make()
                rows += [(*key, *r) for r in state.add(*values[n:])]
            yield batch_of(rows)
        if state is not None:
            yield batch_of([(*key, *r) for r in state.finish()])

    return placed.mapInArrow(run, full)
