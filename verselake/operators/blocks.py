"""Transcript blocks and their notes: nested arrays read, refined and written with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verselake.operators import music

#: Seconds of a note without a stored duration, the least rest that is sung, and the syllable for a token without a character.
NOTE_SECONDS, LEAST_REST, SYLLABLE = 0.4, 0.08, "啦"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_position(blocks: DataFrame, refined: DataFrame, id_col: str, fields: list[str], array: str = "blocks") -> DataFrame:
    """blocks with ``fields`` taken from the refined block at the same place; places that only one side has stay as they are,
    a document without refined blocks too."""
    other = refined.select(id_col, F.col(array).alias("_refined"))
    at = lambda i: F.get(F.coalesce("_refined", F.array().cast(refined.schema[array].dataType)), i)
    one = lambda b, i: F.when(at(i).isNull(), b).otherwise(b.withField(fields[0], at(i)[fields[0]]) if len(fields) == 1 else _with_fields(b, at(i), fields))
    return blocks.join(other, id_col, "left").withColumn(array, F.transform(array, one)).drop("_refined")


def _with_fields(block: Column, source: Column, fields: list[str]) -> Column:
    for f in fields:
        block = block.withField(f, source[f])
    return block


def segment_max(segments: Column | str) -> Column:
    """Greatest number among an array of texts; nulls and what isn't a number are left out."""
    return F.array_max(F.filter(F.transform(_c(segments), lambda x: x.try_cast("double")), lambda x: x.isNotNull()))


def has_pitch(hz: Column | str, contour: Column | str, start: Column | str, end: Column | str, tokens: Column | str) -> Column:
    """Whether a note can be sung: a pitch, a contour with one, both ends of a glide, or a readable degree token."""
    above = lambda x: F.coalesce(_c(x) > 0, F.lit(False))
    some = lambda a, f: F.coalesce(F.exists(_c(a), f), F.lit(False))
    read = some(tokens, lambda t: F.coalesce(music.degree_semitones(t).isNotNull(), F.lit(False)))
    return above(hz) | some(contour, lambda x: F.coalesce(x > 0, F.lit(False))) | (above(start) & above(end)) | read


def sing_notes(text: Column | str, tokens: Column | str, durations: Column | str) -> Column:
    """Array of (char, token, seconds): characters and degree tokens paired by place. The last token repeats (or 1), a missing
    character is a syllable; stored durations count if there is one for each note, else their sum is shared evenly."""
    chars = F.filter(F.split(F.trim(_c(text)), ""), lambda c: F.trim(c) != "")
    degrees = F.filter(F.split(F.trim(F.coalesce(_c(tokens), F.lit(""))), r"\s+"), lambda t: t != "")
    stored = F.coalesce(_c(durations), F.array().cast("array<double>"))
    n = F.greatest(F.size(chars), F.size(degrees))
    total = F.when(F.size(stored) > 0, F.aggregate(stored, F.lit(0.0), lambda a, x: a + x)).otherwise(n * NOTE_SECONDS)
    own = F.size(stored) == n
    last = F.coalesce(F.get(degrees, F.size(degrees) - 1), F.lit("1"))

    def note(i: Column) -> Column:
        seconds = F.when(own & (F.coalesce(F.get(stored, i), F.lit(0.0)) != 0), F.get(stored, i)).otherwise(total / n)
        return F.struct(F.coalesce(F.get(chars, i), F.lit(SYLLABLE)).alias("char"), F.coalesce(F.get(degrees, i), last).alias("token"), F.round(seconds, 3).alias("seconds"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), note)).otherwise(F.array().cast("array<struct<char:string,token:string,seconds:double>>"))


def response_characters(chars: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, text, startSeconds, endSeconds, characters) of timed characters (char, start, end): bounds of a line to two
    digits, of a character to three."""
    row = F.struct(
        order, "char", F.round("start", 3).alias("startSeconds"), F.round("end", 3).alias("endSeconds"),
        F.round(F.greatest(F.lit(0.0), F.col("end") - F.col("start")), 3).alias("durationSeconds"),
    )
    lines = chars.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_c"), F.round(F.min("start"), 2).alias("startSeconds"), F.round(F.max("end"), 2).alias("endSeconds"))
    bare = F.transform("_c", lambda c: c.dropFields(order))
    return lines.select(*by, F.array_join(F.transform("_c", lambda c: c["char"]), "").alias("text"), "startSeconds", "endSeconds", bare.alias("characters"))


def payload_number(raw: Column | str, field: str, default: float) -> Column:
    """A finite number of a JSON payload, or the default where it is missing, no number, or not finite."""
    value = F.get_json_object(_c(raw), f"$.{field}").try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value).otherwise(F.lit(float(default)))


def duration_glyph(beats: Column | str) -> Column:
    """(underlines, dotted, dashes) of the nearest note value; plain without a positive length."""
    beats = _c(beats)
    glyphs = []
    for value, _ in music.NOTE_VALUES:
        dotted = value in (1.5, 0.75, 0.375)
        plain = value / 1.5 if dotted else value
        lines = {0.5: 1, 0.25: 2}.get(plain, 0)
        glyphs.append((value, lines, dotted, int(value) - 1 if value >= 2 else 0))
    options = F.array(*(F.struct(F.abs(F.log(beats / v)).alias("d"), F.lit(i).alias("i"), F.lit(u).alias("underlines"), F.lit(d).alias("dotted"), F.lit(n).alias("dashes")) for i, (v, u, d, n) in enumerate(glyphs)))
    best = F.array_min(options)
    shape = lambda u, d, n: F.struct(u.alias("underlines"), d.alias("dotted"), n.alias("dashes"))
    return F.when((beats > 0) & (beats < float("inf")), shape(best["underlines"], best["dotted"], best["dashes"])).otherwise(shape(F.lit(0), F.lit(False), F.lit(0)))


class GlossaryFold:
    """Replacements learnt in order: a known source gets its new target in its place, a new one goes last, and beyond the
    capacity the oldest goes."""

    def __init__(self, capacity: int = 200, term_chars: int = 80):
        self.capacity, self.term_chars = capacity, term_chars
        self.terms: dict[str, str] = {}

    def add(self, source: str | None, target: str | None):
        source, target = (source or "").strip(), (target or "").strip()
        if source and target and source != target and max(len(source), len(target)) <= self.term_chars:
            self.terms[source] = target
            if len(self.terms) > self.capacity:
                del self.terms[next(iter(self.terms))]
        return ()

    def finish(self):
        return [(i, a, b) for i, (a, b) in enumerate(self.terms.items())]
