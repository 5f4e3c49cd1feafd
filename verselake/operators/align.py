"""Lyrics against timed characters: alignment, interpolation, clamping, and joins of times to spans."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verselake.functions import text as T

#: Cells of the table of costs that is kept at once; longer texts are halved until a part fits.
MAX_CELLS = 4_000_000


def _costs(left: np.ndarray, right: np.ndarray, keep: bool) -> np.ndarray:
    """Edit costs of every start of left against every start of right, or the last row of them alone."""
    step = np.arange(len(right) + 1, dtype=np.int32)
    row = step
    table = np.empty((len(left) + 1, len(right) + 1), np.int32) if keep else None
    if keep:
        table[0] = row
    for i, x in enumerate(left):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (right != x))
        row = np.minimum.accumulate(new - step) + step
        if keep:
            table[i + 1] = row
    return table if keep else row


def diagonals(left: list, right: list, most_cells: int = MAX_CELLS) -> list[tuple[int, int]]:
    """Pairs of places on the diagonal steps of an optimal edit path, ties to the diagonal. Texts whose table is too large are
    cut where an optimal path crosses the middle, so memory grows with their lengths, not with the product."""
    code: dict = {}
    a, b = (np.array([code.setdefault(x, len(code)) for x in side], np.int64) for side in (left, right))
    out: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i0, i1, j0, j1 = parts.pop()
        if i0 == i1 or j0 == j1:
            continue
        if (i1 - i0 + 1) * (j1 - j0 + 1) > most_cells and i1 - i0 > 1:
            mid = (i0 + i1) // 2
            head = _costs(a[i0:mid], b[j0:j1], False)
            tail = _costs(a[mid:i1][::-1], b[j0:j1][::-1], False)[::-1]
            cut = j0 + int(np.argmin(head + tail))
            parts += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
            continue
        cost = _costs(a[i0:i1], b[j0:j1], True)
        i, j = i1 - i0, j1 - j0
        while i and j:
            if cost[i, j] == cost[i - 1, j - 1] + (a[i0 + i - 1] != b[j0 + j - 1]):
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
            elif cost[i, j] == cost[i - 1, j] + 1:
                i -= 1
            else:
                j -= 1
    return sorted(out)


def aligned_pairs(left: list, right: list, most_cells: int = MAX_CELLS) -> list[tuple[int, int]]:
    """The diagonal pairs whose elements are equal."""
    return [(i, j) for i, j in diagonals(left, right, most_cells) if left[i] == right[j]]


def filled_spans(spans: list[tuple[float, float] | None], first: float, last: float) -> list[tuple[float, float]]:
    """Unplaced runs share the time between their placed neighbours (or the edges) evenly."""
    out, i, n = list(spans), 0, len(spans)
    while i < n:
        if out[i] is not None:
            i += 1
            continue
        j = i
        while j < n and out[j] is None:
            j += 1
        lo = out[i - 1][1] if i else first
        hi = max(lo, out[j][0] if j < n else last)
        width = (hi - lo) / (j - i)
        for k in range(i, j):
            out[k] = (lo + (k - i) * width, lo + (k - i + 1) * width)
        i = j
    return out


def monotonic(spans: DataFrame, by: str, order: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that never begin before an earlier one ends."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.max(F.greatest(F.col(start), F.col(end), F.lit(0.0))).over(before), F.lit(0.0))
    return spans.withColumn("_m", held).withColumn(start, F.greatest(start, "_m")).withColumn(end, F.greatest(end, start)).drop("_m")


def _sounds(ch: str) -> bool:
    return not ch.isspace() and not unicodedata.category(ch).startswith("P")


def align_lyrics(lyrics: DataFrame, chars: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(id, line, pos, char, start, end, matched, anchored) of every sounding lyric character. lyrics has (id, lyrics), chars
    (id, char, start, end); both are folded to lower case to compare. A character is anchored where one was heard in its
    place, and matched where that is the same one; the others share the time between. Where nothing was heard there are no
    times. One recording is aligned in one task."""
    kind = lyrics.schema[id_col].dataType.simpleString()

    def run(text: pd.DataFrame, timed: pd.DataFrame) -> pd.DataFrame:
        columns = [id_col, "line", "pos", "char", "start", "end", "matched", "anchored"]
        if not len(text) or text["lyrics"].iloc[0] is None:
            return pd.DataFrame(columns=columns)
        timed = timed if len(timed) else pd.DataFrame({"char": [], "start": [], "end": []}, dtype=object)
        heard = timed[timed["start"].notna() & timed["end"].notna()].sort_values(["start", "end"])
        heard = heard[np.array([bool(c) and _sounds(c[0]) for c in heard["char"]], bool)]
        starts, ends = heard["start"].to_numpy(float), np.maximum(heard["start"].to_numpy(float), heard["end"].to_numpy(float))
        lines = [s for s in (x.strip() for x in text["lyrics"].iloc[0].split("\n")) if s and not (s[0] in "[【" and s[-1] in "]】")]
        want = [(n, c) for n, line in enumerate(lines) for c in line if _sounds(c)]
        name = text[id_col].iloc[0]
        if not len(starts):
            return pd.DataFrame([(name, n, k, c, None, None, False, False) for k, (n, c) in enumerate(want)], columns=columns)
        spans: list = [None] * len(want)
        matched, keys, heard_keys = [False] * len(want), [c.lower() for _, c in want], [c.lower() for c in heard["char"]]
        for i, j in diagonals(keys, heard_keys):
            spans[i], matched[i] = (starts[j], ends[j]), keys[i] == heard_keys[j]
        anchored = [s is not None for s in spans]
        held, rows = 0.0, []
        for k, ((n, c), (a, b)) in enumerate(zip(want, filled_spans(spans, float(starts.min()), float(ends.max())))):
            a = max(a, held)
            held = max(a, b)
            rows.append((name, n, k, c, a, held, matched[k], anchored[k]))
        return pd.DataFrame(rows, columns=columns)

    schema = f"`{id_col}` {kind}, line int, pos int, char string, start double, end double, matched boolean, anchored boolean"
    return lyrics.select(id_col, "lyrics").groupBy(id_col).cogroup(chars.select(id_col, "char", "start", "end").groupBy(id_col)).applyInPandas(run, schema)


def line_summary(aligned: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """Each line's text, span and matched share."""
    return aligned.groupBy(id_col, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "").alias("text"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.avg(F.col("matched").cast("double")).alias("matched_ratio"),
        F.avg(F.col("anchored").cast("double")).alias("anchored_ratio"),
    )


def alignment_totals(aligned: DataFrame, chars: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(id, matched_ratio, anchored_ratio, dropped) of each recording with lyrics; dropped counts what was heard and has no
    place in them."""
    totals = aligned.groupBy(id_col).agg(
        F.avg(F.col("matched").cast("double")).alias("matched_ratio"), F.avg(F.col("anchored").cast("double")).alias("anchored_ratio"), F.count_if("anchored").alias("_n")
    )
    usable = F.col("start").isNotNull() & F.col("end").isNotNull() & T.sounding("char")
    heard = chars.groupBy(id_col).agg(F.count_if(usable).alias("_heard"))
    return totals.join(heard, id_col, "left").select(id_col, "matched_ratio", "anchored_ratio", (F.coalesce("_heard", F.lit(0)) - F.col("_n")).alias("dropped"))


def at_time(times: DataFrame, spans: DataFrame, by: str, time: str, bucket: float) -> DataFrame:
    """times with the first span (least pos) that holds the time, or null. Spans are dealt into time buckets they touch,
    so the join is on equal keys and a bucket holds few spans."""
    dealt = spans.select(
        by, F.col("start").alias("_a"), F.col("end").alias("_z"), "pos", "char",
        F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest("start", "end") / bucket))).alias("_b"),
    )
    keyed = times.withColumn("_b", F.floor(F.col(time) / bucket))
    inside = (F.col("_a") <= F.col(time)) & (F.col(time) < F.col("_z"))
    hits = keyed.join(dealt, [by, "_b"]).filter(inside).groupBy(*times.columns).agg(F.min(F.struct("pos", "char")).alias("_hit"))
    out = times.join(hits, times.columns, "left")
    return out.select(*times.columns, F.col("_hit.pos").alias("pos"), F.coalesce("_hit.char", F.lit("")).alias("char"))


def even_chars(words: DataFrame, word: str = "word", start: str = "start", end: str = "end") -> DataFrame:
    """One row for each character of a word that isn't white space, with an even share of its time; the last ends exactly
    with the word."""
    chars = F.filter(F.split(F.regexp_replace(word, r"(?U)\s+", ""), ""), lambda c: c != "")
    keep = [c for c in words.columns if c not in (word, start, end)]
    cut = words.select(*keep, F.col(start).alias("_a"), F.col(end).alias("_z"), F.size(chars).alias("_n"), F.posexplode(chars).alias("i", "char"))
    share = (F.col("_z") - F.col("_a")) / F.col("_n")
    return cut.select(
        *keep, "i", "char", (F.col("_a") + F.col("i") * share).alias("start"),
        F.when(F.col("i") == F.col("_n") - 1, F.col("_z")).otherwise(F.col("_a") + (F.col("i") + 1) * share).alias("end"),
    )


def timed_chars(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, char, start, end) of nested blocks (characters: char, startSeconds, endSeconds), rows without a bound left out."""
    flat = blocks.select(id_col, F.explode("blocks").alias("b")).select(id_col, F.explode("b.characters").alias("c"))
    known = flat.filter(F.col("c.startSeconds").isNotNull() & F.col("c.endSeconds").isNotNull())
    return known.select(id_col, "c.char", F.col("c.startSeconds").alias("start"), F.greatest("c.startSeconds", "c.endSeconds").alias("end"))


def islands(rows: DataFrame, by: str, order: str, end: str, start: str, gap: float, marker: str | None = None) -> DataFrame:
    """rows with paragraph: a new one after a gap, or at a marked row."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce(F.col(start) - F.lag(end).over(w) > gap, F.lit(False))
    if marker:
        new = new | F.coalesce(F.col(marker), F.lit(False))
    return rows.withColumn("_new", new.cast("int")).withColumn("paragraph", F.sum("_new").over(w)).drop("_new")
