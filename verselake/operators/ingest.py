"""Corpus ingest: songs with sound and lyrics to clips of a training corpus, with resume.

A source gives three tables: songs (song_id, lang, is_mix), sound (rec_id = song_id, first, samples) and timed lines (song_id, pos,
start, end, text). Lines are normalised and merged into chunks, padded, cut out of the sound and held to the quality gate; mixed
songs give some of their longest loud gaps as clips without text. Each clip has a name that follows from its song and place, so
a run takes up where an earlier one stopped: songs of which any clip is in the corpus are left out before their sound is read.

The corpus is a folder: ``clips`` with one WAV file for each clip, and a table of batches (``sources.commits``) with their metadata.
Files are written first and under their final names, a batch of metadata becomes visible by one commit, so a killed run leaves
at most files that the next one writes again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verselake.functions import signal as S
from verselake.functions import text as T
from verselake.operators import corpus, sound
from verselake.session import written
from verselake.sources import files, wav
from verselake.sources.commits import BatchTable

LINES = "song_id string, pos int, start double, end double, text string"
#: Names of the languages of the first source, by code.
NAMES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}


@dataclass(frozen=True)
class Rules:
    """Rate of the clips, limits of chunks in seconds, padding, what clips without text may be."""

    rate: int = 16_000
    min_chunk: float = 1.0
    max_chunk: float = 20.0
    pad: float = 0.1
    negative_share: float = 0.08
    min_negative: float = 3.0
    lowercase: bool = False
    pairs: tuple[tuple[str, str], ...] = ()


def at_rate(audio: DataFrame, rates: DataFrame, rate: int, piece: int = sound.PIECE) -> DataFrame:
    """audio at another rate, by linear interpolation; rates has (rec_id, rate). Each task makes the samples whose place falls in
    its piece, from the piece and the sample after it."""

    @pandas_udf("first long, samples array<float>")
    def run(first: pd.Series, samples: pd.Series, old: pd.Series, at: pd.Series) -> pd.DataFrame:
        out = []
        for a, x, r, p in zip(first, samples, old, at):
            low, high = -(-p * piece * rate // r), -(-(p + 1) * piece * rate // r)
            # The last sample of a recording stands for what comes after it.
            places = np.arange(low, high) * r / rate
            places = places[places < a + len(x)] if len(x) <= piece else places
            made = np.interp(places - a, np.arange(len(x)), np.asarray(x, float)) if len(x) else places
            out.append({"first": int(low), "samples": made.astype(np.float32).tolist()})
        return pd.DataFrame(out, columns=["first", "samples"])

    same = audio.join(rates.filter(F.col("rate") == rate).select("rec_id"), "rec_id", "left_semi").select("rec_id", "first", "samples")
    other = sound.cut(audio.join(rates.filter(F.col("rate") != rate), "rec_id", "left_semi"), piece, after=1).join(rates, "rec_id")
    other = other.filter(F.col("first") < (F.col("piece") + 1) * piece)
    made = other.select("rec_id", run("first", "samples", F.col("rate").cast("long"), "piece").alias("m")).select("rec_id", "m.first", "m.samples")
    return same.unionByName(made).filter(F.size("samples") > 0)


def chunks(songs: DataFrame, lines: DataFrame, rules: Rules) -> DataFrame:
    """(song_id, pos, start, end, text, lang): normalised lines merged into chunks, with the joiner of the song's language."""
    known = lines.join(songs.select("song_id", "lang"), "song_id")
    clean = T.training_normalize("text", "lang", rules.pairs, rules.lowercase)
    kept = known.withColumn("text", clean).filter("text <> ''")
    parts = []
    for joiner in ("", " "):
        some = kept.filter(T.joiner("lang") == joiner).select("song_id", "pos", "start", "end", "text")
        parts.append(corpus.merge_lines(some, "song_id", rules.min_chunk, rules.max_chunk, joiner=joiner))
    return parts[0].unionByName(parts[1]).join(songs.select("song_id", "lang"), "song_id")


def clip_name(song: str, place: Column) -> Column:
    return F.format_string("%s_%04d", F.coalesce(F.nullif(T.sanitize_id(song), F.lit("")), F.lit("song")), place)


def clips(songs: DataFrame, audio: DataFrame, lines: DataFrame, rules: Rules) -> DataFrame:
    """(clip, song_id, lang, text, duration, samples) of what passes the gate; audio is at ``rules.rate``."""
    length = sound.lengths(audio).select(F.col("rec_id").alias("song_id"), (F.col("n") / rules.rate).alias("duration"))
    found = written(chunks(songs, lines, rules).join(length, "song_id"), "chunks")
    inside = found.select(
        "song_id", "pos", "lang", "text", F.greatest(F.col("start") - rules.pad, F.lit(0.0)).alias("start"), F.least(F.col("end") + rules.pad, "duration").alias("end")
    )
    counts = found.groupBy("song_id").agg(F.count("*").alias("n_chunks"))
    share = rules.negative_share
    mixes = songs.filter("is_mix").select("song_id", "lang").join(length, "song_id").join(counts, "song_id")
    budget = F.rint(F.col("n_chunks") * (share / max(1e-6, 1 - share)))
    # What lies between chunks is numbered by length before it is heard, so names don't depend on the gate.
    free = corpus.gaps(found.select("song_id", "start", "end"), mixes.select("song_id", "duration"), max(rules.min_negative, corpus.HARD_MIN), rules.max_chunk, rules.pad)
    longest = F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc(F.col("end") - F.col("start")), "start")) - 1
    silent = free.withColumn("rank", longest).join(mixes.withColumn("budget", budget).select("song_id", "lang", "n_chunks", "budget"), "song_id").filter("budget >= 1")
    silent = silent.select("song_id", (F.col("n_chunks") + F.col("rank")).cast("int").alias("pos"), "lang", F.lit("").alias("text"), "start", "end", "budget")
    spans = inside.withColumn("budget", F.lit(None).cast("double")).unionByName(silent) if share > 0 else inside.withColumn("budget", F.lit(None).cast("double"))
    keyed = spans.withColumnRenamed("song_id", "rec_id")
    cut = sound.sounds(keyed, audio, ["pos"], "start", "end", rules.rate)
    whole = keyed.join(cut, ["rec_id", "pos"])
    # Edges are cut down to whole samples on both sides.
    taken = F.slice("samples", 1, F.greatest(F.floor(F.col("end") * rules.rate) - F.floor(F.col("start") * rules.rate), F.lit(0)).cast("int"))
    heard = whole.withColumn("samples", taken).withColumn("seconds", F.size("samples") / rules.rate)
    good = corpus.passes_quality(F.col("seconds"), F.col("text"), S.array_rms(F.col("samples")), allow_empty=True) & (F.col("budget").isNotNull() | (F.trim("text") != ""))
    kept = heard.filter(good)
    place = F.row_number().over(Window.partitionBy("rec_id", F.col("budget").isNull()).orderBy("pos"))
    allowed = kept.withColumn("_k", place).filter(F.col("budget").isNull() | (F.col("_k") <= F.col("budget")))
    return allowed.select(clip_name("rec_id", F.col("pos")).alias("clip"), F.col("rec_id").alias("song_id"), "lang", "text", F.round("seconds", 3).alias("duration"), "samples")


class Corpus:
    """A corpus folder."""

    def __init__(self, spark: SparkSession, folder: str, rules: Rules = Rules()):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules
        self.table = BatchTable(spark, f"{self.folder}/metadata")

    def metadata(self) -> DataFrame | None:
        """(clip, song_id, lang, text, duration)."""
        return self.table.read()

    def left_to_do(self, songs: DataFrame) -> DataFrame:
        """Songs of which no clip is in the corpus."""
        done = self.metadata()
        return songs if done is None else corpus.not_yet_done(songs, done, "song_id")

    def ingest(self, songs: DataFrame, audio: Callable[[DataFrame], DataFrame], lines: DataFrame, batch: str) -> int:
        """Adds the songs that aren't there yet; how many clips that gave. ``audio`` gives the sound of the songs it is asked
        for, at the corpus's rate."""
        todo = written(self.left_to_do(songs), "songs")
        if todo.isEmpty():
            return 0
        made = written(clips(todo, audio(todo), lines, self.rules), "clips")
        n = made.count()
        if n:
            wav.write(made.select(F.col("clip").alias("rec_id"), F.lit(0).cast("long").alias("first"), "samples"), f"{self.folder}/clips", self.rules.rate)
        self.table.append(made.drop("samples"), batch, ["clip"])
        return n


def heard(spark: SparkSession, folder: str, rate: int, channel: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """The sound of songs from a folder of WAV files that bear their stems, at a rate; of one channel, or of all averaged."""
    wav.register(spark)
    read = spark.read.format("wav").option("channel", "" if channel is None else channel).load(folder)

    def of(songs: DataFrame) -> DataFrame:
        # Files of songs that aren't asked for are read and dropped here, before anything is shuffled.
        mine = read.join(songs.select(F.col("stem").alias("rec_id"), F.col("song_id").alias("_song")), "rec_id").drop("rec_id").withColumnRenamed("_song", "rec_id")
        rates = mine.groupBy("rec_id").agg(F.max("rate").alias("rate"))
        return at_rate(mine.select("rec_id", "first", "samples"), rates, rate)

    return of


def local_songs(spark: SparkSession, folder: str, lang: str, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(songs, lines) of a folder of lyric files with stamps; songs without any are left to an aligner."""
    texts = files.lyrics(spark, folder).filter("timed").select("song_id", "text")
    songs = texts.select("song_id", F.col("song_id").alias("stem"), F.lit(lang).alias("lang"), F.lit(True).alias("is_mix"))
    entries = corpus.parse_lrc(texts)
    # The last line of a song goes on for as long as a line may; the clip ends with the sound.
    ends = corpus.line_ends(entries.withColumn("duration", F.lit(1e9)))
    return songs, ends.select("song_id", "pos", "start", "end", "text")


def annotated_songs(spark: SparkSession, root: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """(songs, lines) of a corpus with one list of songs (a language column, a file column) and a file of timed lines for each."""
    listed = spark.read.csv(f"{root}/JamendoLyrics.csv", header=True, escape='"', multiLine=True)
    language = next(c for c in listed.columns if "lang" in c.lower())
    names = F.filter(F.array(*(F.col(f"`{c}`").cast("string") for c in listed.columns)), lambda v: F.lower(v).endswith(".mp3"))
    stem = F.regexp_replace(F.element_at(F.split(F.get(names, 0), "/"), -1), r"\.[^.]*$", "")
    picked = listed.filter(T.language_matches(F.col(f"`{language}`"), lang, NAMES)).select(stem.alias("stem")).filter("stem <> ''").distinct()
    songs = picked.select(F.concat(F.lit("jamendo_"), "stem").alias("song_id"), "stem", F.lit(lang).alias("lang"), F.lit(True).alias("is_mix"))
    raw = spark.read.option("pathGlobFilter", "*.csv").schema("value string").text(f"{root}/annotations/lines", wholetext=True)
    rows = raw.select(files.stem(files._name()).alias("stem"), F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r\n|\n")).alias("pos", "line"))
    parsed = rows.withColumn("r", F.from_csv("line", "a string, z string, text string", {"escape": '"'}))
    timed = parsed.select("stem", "pos", F.col("r.a").try_cast("double").alias("start"), F.col("r.z").try_cast("double").alias("end"), F.trim("r.text").alias("text"))
    good = timed.filter("start is not null and end is not null and text <> ''").withColumn("song_id", F.concat(F.lit("jamendo_"), "stem"))
    lines = good.select("song_id", "pos", "start", "end", "text")
    return songs.join(lines.select("song_id").distinct(), "song_id", "left_semi"), lines


def clip_songs(spark: SparkSession, wav_folder: str, lyrics_folder: str) -> tuple[DataFrame, DataFrame]:
    """(songs, lines) of short clips that have a lyric file of their own: one line over the whole clip, phrases joined."""
    texts = files.decoded_text(spark, lyrics_folder, "*.txt")
    text = F.trim(F.regexp_replace(F.translate("text", "_", " "), r"\s+", " "))
    known = texts.select(F.col("name").alias("stem"), text.alias("text")).filter("text <> ''").withColumn("song_id", F.concat(F.lit("mir1k_"), "stem"))
    songs = known.select("song_id", "stem", F.lit("zh-TW").alias("lang"), F.lit(False).alias("is_mix"))
    wav.register(spark)
    ends = spark.read.format("wav").load(wav_folder).groupBy(F.col("rec_id").alias("stem")).agg(F.max((F.col("first") + F.size("samples")) / F.col("rate")).alias("end"))
    lines = known.join(ends, "stem").select("song_id", F.lit(0).alias("pos"), F.lit(0.0).alias("start"), "end", "text")
    return songs, lines
