"""Ordered folds over streams: a key's fold object is its state from batch to batch, in order of arrival or of event time.

``folded_stream`` is the streaming twin of ``operators.folds.ordered_fold``: rows of a key must come in order across batches and are
sorted inside one. A row that ends its key, or no row for ``idle`` seconds of processing time, finishes the fold and removes
the state.

``in_event_time`` takes rows in any order. Rows wait in a buffer until their key has seen an event ``delay`` later, then go through
the fold in order of event time; a row that comes after its turn goes out as late, with the count of its key's late rows so far, so none
is lost silently. A key that the query's watermark (``bound`` seconds behind the newest event) has passed is flushed and its state
removed by an event-time timer. Rows even older than that are dropped by Spark, which counts them (``dropped_rows``).
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verselake.operators.folds import Fold, ordered_fold

#: Seconds of processing time without a row after which a key's state goes. With it a query looks at the clock again and again, so
#: a run over what is there (availableNow) must pass None.
IDLE = 3600.0


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def _plain(value):
    """pandas' missing values and numbers as Python's."""
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float) and value != value:
        return None
    return value.item() if hasattr(value, "item") and getattr(value, "ndim", 1) == 0 else value


def folded_stream(
    stream: DataFrame, by: list[str], order: list[str], inputs: list[str], make: Callable[[], Fold], schema: str, ends: Callable[..., bool] | None = None, idle: float | None = IDLE,
    bind: Callable[[Fold], None] | None = None,
) -> DataFrame:
    """(by, schema) of a streaming DataFrame; ``ends`` says of a row's inputs whether its key ends with it. ``bind`` gives a fold
    that comes out of the state what it doesn't carry, such as models."""
    names = [*by, *StructType.fromDDL(schema).names]

    def kept(state) -> Fold:
        fold = pickle.loads(state.get[0])
        if bind is not None:
            bind(fold)
        return fold

    def run(key, frames, state):
        if state.hasTimedOut:
            fold = kept(state)
            state.remove()
            yield _frame([(*key, *r) for r in fold.finish()], names)
            return
        fold, live, out = kept(state) if state.exists else make(), True, []
        frame = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        for values in frame[inputs].itertuples(index=False, name=None):
            if not live:
                fold, live = make(), True
            plain = [_plain(v) for v in values]
            out += fold.add(*plain)
            if ends is not None and ends(*plain):
                out += fold.finish()
                live = False
        if live:
            state.update((cloudpickle.dumps(fold),))
            if idle is not None:
                state.setTimeoutDuration(int(idle * 1000))
        elif state.exists:
            state.remove()
        yield _frame([(*key, *r) for r in out], names)

    rows = stream.select(*dict.fromkeys([*by, *order, *inputs]))
    timeout = "NoTimeout" if idle is None else "ProcessingTimeTimeout"
    return rows.groupBy(*by).applyInPandasWithState(run, f"{_kinds(stream, by)}, {schema}", "state binary", "append", timeout)


class Reordered:
    """What a key carries: the buffer, its fold, how far it has been released, and the count of its late rows."""

    def __init__(self, make: Callable[[], Fold], delay: float):
        self.fold, self.delay = make(), delay
        self.waiting: list[tuple] = []
        self.newest: float | None = None
        self.late, self.arrived = 0, 0

    def take(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """(late, seconds, count, fold's row or the late inputs) of rows (seconds, order, inputs)."""
        for seconds, order, values in rows:
            if self.newest is not None and seconds <= self.newest - self.delay:
                self.late += 1
                yield True, seconds, self.late, values
                continue
            self.arrived += 1
            heapq.heappush(self.waiting, (seconds, order, self.arrived, values))
            self.newest = seconds if self.newest is None else max(self.newest, seconds)
            if seconds == self.newest:
                yield from self._release(self.newest - self.delay)

    def _release(self, upto: float) -> Iterator[tuple]:
        while self.waiting and self.waiting[0][0] <= upto:
            seconds, _, _, values = heapq.heappop(self.waiting)
            for r in self.fold.add(*values):
                yield False, seconds, self.late, r

    def close(self) -> Iterator[tuple]:
        yield from self._release(float("inf"))
        for r in self.fold.finish():
            yield False, self.newest, self.late, r


def in_event_time(stream: DataFrame, by: list[str], time: str, order: list[str], inputs: list[str], make: Callable[[], Fold], schema: str, delay: float, bound: float) -> DataFrame:
    """(by, late, event_seconds, late_count, schema, late_<input> for each input) of a streaming DataFrame whose ``time`` is a
    timestamp. Rows of one time are ordered by ``order``. ``bound`` must be at least ``delay``."""
    if bound < delay:
        raise ValueError("a key's rows wait for `delay` seconds, so the watermark must be `bound` >= `delay` behind")
    outs = StructType.fromDDL(schema).names
    late_names = [f"late_{c}" for c in inputs]
    late_kinds = ", ".join(f"`late_{f.name}` {f.dataType.simpleString()}" for f in stream.select(*inputs).schema)
    names = [*by, "late", "event_seconds", "late_count", *outs, *late_names]
    full = f"{_kinds(stream, by)}, late boolean, event_seconds double, late_count long, {schema}, {late_kinds}"

    def rows_of(key, found) -> pd.DataFrame:
        blank_out, blank_late = (None,) * len(outs), (None,) * len(inputs)
        return _frame([(*key, late, at, n, *(blank_out if late else r), *(r if late else blank_late)) for late, at, n, r in found], names)

    def run(key, frames, state):
        if state.hasTimedOut:
            held = pickle.loads(state.get[0])
            state.remove()
            yield rows_of(key, held.close())
            return
        held = pickle.loads(state.get[0]) if state.exists else Reordered(make, delay)
        frame = pd.concat(list(frames), ignore_index=True)
        values = (tuple(map(_plain, v)) for v in frame[inputs].itertuples(index=False, name=None))
        places = (tuple(map(_plain, v)) for v in frame[order].itertuples(index=False, name=None))
        found = list(held.take(zip(frame["_seconds"].tolist(), places, values)))
        state.update((cloudpickle.dumps(held),))
        wake = max(int(held.newest * 1000) + 1, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(wake)
        yield rows_of(key, found)

    at = F.unix_micros(F.col("_at")) / 1_000_000
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).filter("_at is not null").withWatermark("_at", f"{bound} seconds").withColumn("_seconds", at)
    rows = timed.select(*dict.fromkeys([*by, "_at", "_seconds", *order, *inputs]))
    return rows.groupBy(*by).applyInPandasWithState(run, full, "state binary", "append", "EventTimeTimeout")


def event_time_batch(rows: DataFrame, by: list[str], time: str, order: list[str], inputs: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """What ``in_event_time`` gives for rows none of which is late: a fold in order of event time."""
    return ordered_fold(rows.filter(F.col(time).isNotNull()), by, [time, *order], inputs, make, schema)


def dropped_rows(query) -> int:
    """Rows that a streaming query's watermark has dropped, by its recent progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
