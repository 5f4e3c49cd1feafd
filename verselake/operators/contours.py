"""Pitch curves of notes as Columns: slides, what a note's curve is made from, and sampling of a curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verselake.operators import music

#: Points of a slide, half its width and the range of its centre as shares of the note, place without a measured one.
POINTS, HALF_WIDTH, EARLIEST, LATEST, MIDDLE = 9, 0.18, 0.15, 0.85, 0.5
#: What stands for a voiced note and a breath without a character.
VOICED_CHAR, BREATH_CHAR = "a", "h"
VOICE_HZ = 165.0


def slide_place(place: Column) -> Column:
    """A measured place inside the note, else the middle."""
    return F.when((place > 0) & (place < 1), place).otherwise(MIDDLE)


def portamento(first: Column, last: Column, place: Column) -> Column:
    """The first pitch, a straight slide about the place, the last pitch."""
    centre = F.least(F.lit(LATEST), F.greatest(F.lit(EARLIEST), slide_place(place)))
    done = lambda k, at: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k / (POINTS - 1) - at + HALF_WIDTH) / (2 * HALF_WIDTH)))
    points = F.sequence(F.lit(0), F.lit(POINTS - 1))
    whole = F.struct(first.alias("first"), last.alias("last"), centre.alias("centre"))
    return music.held(whole, lambda s: F.transform(points, lambda k: s["first"] + (s["last"] - s["first"]) * done(k.cast("double"), s["centre"])))


def slide_steps(token: Column, first: Column, last: Column) -> Column:
    """(first, last) semitones of a slide from its two degree tokens, or else from the halves of a token with an arrow; null if
    that isn't two different degrees."""
    arrow = F.when(token.contains(music.UP), music.UP).when(token.contains(music.DOWN), music.DOWN)
    at = F.locate(music.UP, token)
    at = F.when(at > 0, at).otherwise(F.locate(music.DOWN, token))
    half = lambda given, own: music.degree_semitones(F.coalesce(F.nullif(given, F.lit("")), F.when(arrow.isNotNull(), own)))
    a, b = half(first, F.substring(token, F.lit(1), at - 1)), half(last, F.substring(token, at + 1, F.length(token)))
    return music.held(F.struct(a.alias("first"), b.alias("last")), lambda s: F.when(F.abs(s["first"] - s["last"]) > 1e-6, s))


def curve(note: Column, tonic: Column, measured: bool) -> Column:
    """The pitch curve of a note (struct of hz, contour, start_hz, end_hz, degree, degree_start, degree_end, glide_mid) in Hz, null for
    a rest. Measured singing follows the recorded contour, else a slide between its ends, else its pitch. Written singing follows the
    degrees against the tonic: a slide, else one degree, else the measured pitch."""
    hz = F.when(note["hz"] > 0, F.array(note["hz"]))
    if measured:
        recorded = F.filter(note["contour"], lambda x: x > 0)
        slide = portamento(note["start_hz"], note["end_hz"], note["glide_mid"])
        return F.when(F.size(recorded) > 0, recorded).when((note["start_hz"] > 0) & (note["end_hz"] > 0), slide).otherwise(hz)
    steps = slide_steps(F.coalesce(note["degree"], F.lit("")), note["degree_start"], note["degree_end"])
    pitch = lambda s: tonic * F.pow(F.lit(2.0), s / 12)
    single = music.held(music.degree_semitones(note["degree"]), lambda one: F.when(one.isNotNull(), F.array(pitch(one))).otherwise(hz))
    slid = lambda s: portamento(pitch(s["first"]), pitch(s["last"]), note["glide_mid"])
    return F.when(tonic > 0, music.held(steps, lambda s: F.when(s.isNotNull(), slid(s)).otherwise(single))).otherwise(hz)


def resolved(note: Column, tonic: Column, measured: bool) -> Column:
    """(char, freq, contour, duration, kind, intensity) of a note that also has char, kind, duration and intensity: voiced with
    a curve, a breath (if it says so), or a rest."""
    breath = F.lower(F.trim(F.coalesce(note["kind"], F.lit("")))) == "breath"
    char = F.nullif(F.trim(F.coalesce(note["char"], F.lit(""))), F.lit(""))
    kind = lambda contour: F.when(breath, "breath").when(contour.isNotNull(), "voiced").otherwise("rest")
    return music.held(F.when(~breath, curve(note, tonic, measured)), lambda contour: F.struct(
        F.coalesce(char, F.when(breath, BREATH_CHAR).otherwise(VOICED_CHAR)).alias("char"), F.get(contour, 0).alias("freq"), contour.alias("contour"),
        note["duration"].alias("duration"), kind(contour).alias("kind"), F.coalesce(note["intensity"], F.lit(0.0)).alias("intensity"),
    ))


def _between(points: Column, place: Column) -> Column:
    """The value at a place (in steps between points) of a curve of straight lines."""
    low = F.floor(place).cast("int")
    a, b = F.get(points, low), F.coalesce(F.get(points, low + 1), F.get(points, low))
    return a + (b - a) * (place - low)


def pitches(contour: Column, count: Column) -> Column:
    """The curve at ``count`` instants from its first to its last point, within the singable range; one usual pitch without a curve."""
    points = F.transform(contour, lambda x: F.least(F.lit(music.HIGHEST_VOICE), F.greatest(F.lit(music.LOWEST_VOICE), x)))
    most = F.greatest(count, F.lit(1))
    last = F.size(points) - 1
    along = F.transform(F.sequence(F.lit(0), most - 1), lambda k: _between(points, k * last / F.greatest(most - 1, F.lit(1))))
    flat = F.array_repeat(F.coalesce(F.get(points, 0), F.lit(VOICE_HZ)), most.cast("int"))
    return F.when((F.coalesce(F.size(points), F.lit(0)) > 1) & (count > 1), along).otherwise(flat)


def steps(contour: Column, count: int) -> Column:
    """The curve at the middles of ``count`` equal parts."""
    last = F.size(contour) - 1
    along = F.transform(F.sequence(F.lit(0), F.lit(max(1, count) - 1)), lambda k: _between(contour, (k + 0.5) / max(1, count) * last))
    return F.when(last > 0, along).otherwise(F.array_repeat(F.get(contour, 0), max(1, count))) if count > 1 else F.array(F.get(contour, 0))
