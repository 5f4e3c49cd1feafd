"""Lyric lines to training chunks: timed lines, gaps, merging, packing, quality gate, resume."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verselake.operators.folds import ordered_fold

STAMP = r"\[(\d{1,3}):(\d{1,2}(?:[.:]\d{1,3})?)\]"
META_LINE = r"(?i)^\s*\[(ti|ar|al|by|re|ve|offset|length|tool)\b[^\]]*\]\s*$"
MAX_LINE, HARD_MIN, HARD_MAX, MIN_RMS = 25.0, 0.8, 25.0, 5e-4


def parse_lrc(songs: DataFrame, id_col: str = "song_id", text_col: str = "text") -> DataFrame:
    """(id, pos, start, text): one row for each time stamp, in time order (of equal times in file order)."""
    lines = songs.select(id_col, F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("_line", "_raw")).filter(~F.col("_raw").rlike(META_LINE))
    stamps = F.regexp_extract_all("_raw", F.lit(STAMP), F.lit(0))
    timed = lines.select(id_col, "_line", "_raw", F.posexplode(stamps).alias("_k", "_stamp"))
    minutes, rest = F.regexp_extract("_stamp", STAMP, 1), F.regexp_extract("_stamp", STAMP, 2)
    out = timed.select(
        id_col,
        (minutes.cast("int") * 60 + F.regexp_replace(rest, ":", ".").cast("double")).alias("start"),
        F.trim(F.regexp_replace("_raw", STAMP, "")).alias("text"),
        "_line",
        "_k",
    )
    order = Window.partitionBy(id_col).orderBy("start", "_line", "_k")
    return out.withColumn("pos", F.row_number().over(order) - 1).select(id_col, "pos", "start", "text")


def line_ends(entries: DataFrame, duration: str = "duration", id_col: str = "song_id", max_line: float = MAX_LINE) -> DataFrame:
    """(id, pos, start, end, text): a line ends at the next entry, blank ones included, within its cap and the audio."""
    following = F.lead("start").over(Window.partitionBy(id_col).orderBy("pos"))
    end = F.least(F.coalesce(following, F.col(duration)), F.col("start") + max_line, F.col(duration))
    ended = entries.withColumn("end", end)
    return ended.filter((F.trim("text") != "") & (F.col("start") < F.col(duration)) & (F.col("end") > F.col("start"))).select(id_col, "pos", "start", "end", "text")


def gaps(chunks: DataFrame, songs: DataFrame, min_dur: float, max_dur: float, pad: float, id_col: str = "song_id") -> DataFrame:
    """(id, start, end): what lies before, between and after a song's chunks, padded and cut into equal pieces."""
    by = Window.partitionBy(id_col).orderBy("start", "end")
    after = chunks.join(songs, id_col).select(
        id_col, "duration", F.col("end").alias("lo"), F.coalesce(F.lead("start").over(by), F.col("duration")).alias("hi")
    )
    firsts = chunks.groupBy(id_col).agg(F.min("start").alias("hi"))
    before = songs.join(firsts, id_col, "left").select(id_col, "duration", F.lit(0.0).alias("lo"), F.coalesce("hi", "duration").alias("hi"))
    padded = before.unionByName(after).select(
        id_col, (F.col("lo") + pad).alias("lo"), (F.least("hi", "duration") - pad).alias("hi")
    )
    span = F.col("hi") - F.col("lo")
    pieces = F.greatest(F.lit(1), F.ceil(span / max_dur)).cast("int")
    stepped = padded.filter(span >= min_dur).withColumns({"n": pieces, "step": span / pieces}).filter(F.col("step") >= min_dur)
    cut = stepped.select(id_col, "lo", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return cut.select(id_col, (F.col("lo") + F.col("i") * F.col("step")).alias("start"), (F.col("lo") + (F.col("i") + 1) * F.col("step")).alias("end"))


def negative_budget(gap_rows: DataFrame, chunk_counts: DataFrame, ratio: float, good: Column | None = None, id_col: str = "song_id") -> DataFrame:
    """The longest good gaps of each song, as many as its chunks allow (rounded up)."""
    kept = gap_rows.filter(good) if good is not None else gap_rows
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.col("end") - F.col("start")), "start"))
    return kept.join(chunk_counts, id_col).withColumn("rank", place).filter(F.col("rank") <= F.ceil(F.col("n_chunks") * ratio)).drop("n_chunks")


class LineMerger:
    """Greedy merge: a chunk that is still too short takes the next line if it is near and the whole fits."""

    def __init__(self, min_dur: float, max_dur: float, max_gap: float, joiner: str):
        self.min_dur, self.max_dur, self.max_gap, self.joiner = min_dur, max_dur, max_gap, joiner
        self.open: tuple[float, float, list[str]] | None = None
        self.made = 0

    def add(self, start: float, end: float, text: str | None):
        if not (text or "").strip():
            return ()
        if self.open is not None:
            first, last, texts = self.open
            if last - first < self.min_dur and start - last <= self.max_gap and end - first <= self.max_dur:
                texts.append(text)
                self.open = (first, end, texts)
                return ()
        closed = self.finish()
        self.open = (start, end, [text])
        return closed

    def finish(self):
        if self.open is None:
            return ()
        self.made += 1
        return ((self.made - 1, self.open[0], self.open[1], self.joiner.join(self.open[2]).strip()),)


def merge_lines(lines: DataFrame, id_col: str = "song_id", min_dur: float = 1.0, max_dur: float = 20.0, max_gap: float = 2.0, joiner: str = " ") -> DataFrame:
    """(id, pos, start, end, text) of chunks; a fold over each song's ordered lines."""
    make = partial(LineMerger, min_dur, max_dur, max_gap, joiner)
    return ordered_fold(lines, [id_col], ["start", "pos"], ["start", "end", "text"], make, "pos int, start double, end double, text string")


class BinPacker:
    """A bin closes when the next clip would pass the target; each clip goes on with its bin and the bin's length so far."""

    def __init__(self, target: float, gap: float):
        self.target, self.gap = target, gap
        self.number, self.length, self.size = 0, 0.0, 0

    def add(self, dur: float, *rest):
        if self.size and self.length + self.gap + dur > self.target:
            self.number, self.length, self.size = self.number + 1, 0.0, 0
        self.length += dur + (self.gap if self.size else 0.0)
        self.size += 1
        return ((dur, *rest, self.number, self.length),)

    def finish(self):
        return ()


def pack_windows(clips: DataFrame, by: str, order: list[str], target: float = 25.0, gap: float = 0.3, blocks: int = 1, seed: int = 42) -> DataFrame:
    """clips (dur, ...) with (block, bin): greedy packing of each speaker's clips in order. A speaker with very many clips can
    be dealt by hash into ``blocks`` that are packed on their own."""
    dealt = clips.withColumn("block", F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(blocks)).cast("int")).withColumn("dur", F.coalesce("dur", F.lit(0.0)).cast("double"))
    rest = [f for f in dealt.schema if f.name not in (by, "block", "dur")]
    schema = "dur double, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "bin int, bin_dur double"
    return ordered_fold(dealt, [by, "block"], order, ["dur", *(f.name for f in rest)], partial(BinPacker, target, gap), schema)


def packed_rows(packed: DataFrame, by: str, order: list[str], id_col: str, text_col: str | None = None, joiner: str = "，") -> DataFrame:
    """One row for each bin: its clips in order, joined text, count and length."""
    fields = F.struct(*order, F.col(id_col).alias("_id"), *([F.col(text_col).alias("_text")] if text_col else []))
    grouped = packed.groupBy(by, "block", "bin").agg(
        F.array_sort(F.collect_list(fields)).alias("_s"), F.count("*").alias("n"), F.round(F.max("bin_dur"), 2).alias("dur")
    )
    out = {"audios": F.transform("_s", lambda x: x["_id"])}
    if text_col:
        out["text"] = F.array_join(F.transform("_s", lambda x: x["_text"]), joiner)
    return grouped.withColumns(out).drop("_s")


def pack_stats(packed: DataFrame) -> DataFrame:
    return packed.agg(
        F.count("*").alias("windows"), F.round(F.sum("dur") / 3600, 4).alias("hours"), F.round(F.avg("dur"), 2).alias("mean_dur"), F.round(F.avg("n"), 2).alias("clips_per_window")
    )


def passes_quality(duration: Column, text: Column, rms: Column, allow_empty: bool = False) -> Column:
    good = duration.between(HARD_MIN, HARD_MAX) & (rms >= MIN_RMS)
    return good if allow_empty else good & (F.trim(F.coalesce(text, F.lit(""))) != "")


def not_yet_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier run has written."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def join_by_priority(left: DataFrame, right: DataFrame, key: str, priority: str) -> DataFrame:
    """left with the right row of least priority for each key."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(priority))
    return left.join(right.withColumn("_r", first).filter("_r = 1").drop("_r"), key)
