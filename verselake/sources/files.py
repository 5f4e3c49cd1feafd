"""Readers of transcripts, lyrics, manifests and registries. A bad row becomes a null or is left out, never a failed job."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verselake.functions import text as X
from verselake.operators.splits import validated_or_all

CHARACTER = (
    "char string, startSeconds double, endSeconds double, durationSeconds double, hz double, jianpu string, jianpuStart string, "
    "jianpuEnd string, minHz double, maxHz double, isGlide boolean, centsOff double, intensity double, beats double, noteValue string, tuning string"
)
BLOCK = (
    "text string, startSeconds double, endSeconds double, segmentKind string, "
    "pitch struct<medianHz:double,minHz:double,maxHz:double,voicedRatio:double>, "
    f"characters array<struct<{CHARACTER}>>, translation string, speaker int"
)
META = f"title string, createdAt string, blocks array<struct<{BLOCK}>>"
CORPUS = "file_name string, transcription string, duration double, language string, source_dataset_or_song_id string"
MANIFEST = "id string, audio string, text string, lang string, source string, split string, speaker string, negative boolean"
PREDICTION = "id string, ref string, hyp string, no_speech_prob double, rms double"
GOLD = "id string, words array<struct<word:string,start:double,end:double>>"
REGISTRY = "version int, presets array<struct<id:string,label:string,model:string,kind:string,note:string>>"
VOICE = "id string, name string, favorite boolean, created_at string, updated_at string, sample_rate int, duration_seconds double, has_sample boolean"
AUDIO = ("wav", "mp3", "m4a", "webm", "ogg", "flac")


def stem(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def _name() -> Column:
    """The file's path as it is in its store; in the metadata blanks and the like are escaped."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_order() -> Column:
    """The place of a row in its file: splits by their start, rows of a split as they are read."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_row"))


def _whole(spark: SparkSession, folder: str, glob: str, value: str) -> DataFrame:
    read = spark.read.option("pathGlobFilter", glob).schema("value string")
    return read.text(folder, wholetext=True).select(stem(_name()).alias("doc_id"), F.col("value").alias(value), F.col("_metadata.file_modification_time").alias("mtime"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each text file with what its siblings of one stem add: title, blocks, whether there is audio. A title
    falls back to the first line that isn't blank, then to the id; a sibling that isn't JSON counts as absent."""
    texts = _whole(spark, folder, "*.txt", "text")
    meta = _whole(spark, folder, "*.json", "raw").select("doc_id", F.from_json("raw", META).alias("m"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(AUDIO) + "}").load(folder)
    audio = found.select(stem("path").alias("doc_id")).distinct().withColumn("_audio", F.lit(True))
    joined = texts.join(meta, "doc_id", "left").join(audio, "doc_id", "left")
    title = F.coalesce(F.nullif(F.trim("m.title"), F.lit("")), F.nullif(X.first_line("text"), F.lit("")), F.col("doc_id"))
    has_degree = F.exists(F.flatten(F.transform("m.blocks", lambda b: F.coalesce(b["characters"], F.array()))), lambda c: F.coalesce(c["jianpu"], F.lit("")) != "")
    return joined.select(
        "doc_id", title.alias("title"), "text", "mtime",
        F.coalesce("m.createdAt", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("created_at"),
        F.coalesce("_audio", F.lit(False)).alias("has_audio"), F.coalesce(has_degree, F.lit(False)).alias("has_jianpu"), F.col("m.blocks").alias("blocks"),
    )


def lyrics(spark: SparkSession, folder: str) -> DataFrame:
    """(song_id, text, timed): lyric files, timed by suffix or because a line starts with a stamp."""
    read = spark.read.option("pathGlobFilter", "*.{lrc,txt}").schema("value string").text(folder, wholetext=True)
    timed = F.lower(_name()).endswith(".lrc") | F.col("value").rlike(r"(?m)^\s*\[\d{1,3}:\d{1,2}")
    return read.select(stem(_name()).alias("song_id"), F.col("value").alias("text"), timed.alias("timed"))


def corpus_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CORPUS, multiLine=True, escape='"', mode="PERMISSIVE")


def clip_table(spark: SparkSession, path: str) -> DataFrame:
    """(stem, speaker, sentence) of a tab-separated clip list; of one stem the last row."""
    rows = spark.read.csv(path, header=True, sep="\t", quote="", schema="client_id string, path string, sentence string")
    placed = rows.withColumn("_at", file_order())
    return placed.groupBy(stem("path").alias("stem")).agg(F.max_by("client_id", "_at").alias("speaker"), F.max_by("sentence", "_at").alias("sentence"))


def clip_stems(spark: SparkSession, *paths: str) -> DataFrame:
    """(stem) of the clips that any of the lists names; a list that isn't there counts as empty."""
    found = [clip_table(spark, p).select("stem") for p in paths if exists(spark, p)]
    return reduce(DataFrame.union, found).distinct() if found else spark.createDataFrame([], "stem string")


def common_voice(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, speaker, sentence) of a corpus folder: its validated list if it has one, else its train, dev and test lists."""
    lists = [f"{folder}/{n}.tsv" for n in ("validated", "train", "dev", "test")]
    names = lists[:1] if exists(spark, lists[0]) else [p for p in lists[1:] if exists(spark, p)]
    if not names:
        return spark.createDataFrame([], "stem string, speaker string, sentence string")
    return validated_or_all(None, *(clip_table(spark, p) for p in names))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a path, in whatever store it is."""
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException:
        return False


def clip_stem(chunk: Column | str) -> Column:
    """Clip id of a numbered chunk id."""
    return F.regexp_replace(F.regexp_replace(chunk, "^cv_", ""), r"_\d+$", "")


def manifest(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    rows = spark.read.json(path, schema=MANIFEST, mode="PERMISSIVE").filter("id is not null")
    return rows.filter(F.col("id").startswith(prefix)) if prefix else rows


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Dumped predictions with the run (folder) and source (file) that they come from."""
    tag = F.regexp_extract(_name(), r"([^/]*?)(_preds)?/[^/]*$", 1)
    return spark.read.json(path, schema=PREDICTION).filter("id is not null").select("*", tag.alias("tag"), stem(_name()).alias("source"))


def alignment_gold(spark: SparkSession, path: str) -> DataFrame:
    """(id, words) of rows with words; no rows where there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], GOLD)
    return spark.read.json(path, schema=GOLD).filter(F.size("words") > 0)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, text) of a three-column list; rows without numbers (a header) or text go."""
    rows = spark.read.csv(path, schema="a string, z string, text string", escape='"')
    numbers = rows.select(F.col("a").try_cast("double").alias("start"), F.col("z").try_cast("double").alias("end"), F.trim("text").alias("text"))
    return numbers.filter("start is not null and end is not null and text <> ''")


#: Rows that a replacement table may have: they become one chain of expressions, as a hand-made list may.
MOST_PAIRS = 10_000


def replacement_pairs(spark: SparkSession, path: str, most: int = MOST_PAIRS) -> list[tuple[str, str]]:
    """Replacement table, longest source first, of equals in file order. A table of more than ``most`` rows is an error."""
    rows = spark.read.csv(path, schema="old string, new string").filter("old is not null and old <> ''").filter(~F.lower("old").isin("from", "來源"))
    placed = rows.withColumn("_at", file_order()).orderBy("_at").limit(most + 1).collect()
    if len(placed) > most:
        raise ValueError(f"{path} has more than {most} replacements")
    return sorted(((r.old, r.new or "") for r in placed), key=lambda p: -len(p[0]))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, label, model, kind, note); a file that isn't a registry gives no rows."""
    read = spark.read.json(path, schema=REGISTRY, multiLine=True, mode="PERMISSIVE")
    return read.select(F.posexplode("presets").alias("pos", "p")).select("pos", "p.*").filter("id is not null")


def voices(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.json").json(folder, schema=VOICE, multiLine=True).filter("id is not null")


def decoded_text(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, text) of files in UTF-8 or, failing that, cp950; what neither reads has replacement marks."""
    def read(raw: bytes) -> str:
        for encoding in ("utf-8-sig", "cp950"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                pass
        return raw.decode("utf-8", "replace")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"name": f["name"], "text": [read(bytes(b)) for b in f["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(stem("path").alias("name"), "content").mapInPandas(run, "name string, text string")


def pitch_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(name, pos, time_seconds, hz, intensity, text, after_blank) of pitch files: a blank line marks the next row."""
    read = spark.read.option("pathGlobFilter", "*.csv").schema("value string").text(folder, wholetext=True)
    lines = read.select(stem(_name()).alias("name"), F.posexplode(F.split("value", r"\r\n|\n")).alias("pos", "line"))
    w = Window.partitionBy("name").orderBy("pos")
    blank = F.coalesce(F.lag(F.trim("line") == "").over(w), F.lit(False))
    parsed = lines.withColumn("after_blank", blank).withColumn("r", F.from_csv("line", "time_seconds double, hz double, intensity double, text string"))
    return parsed.filter("r.time_seconds is not null").select("name", "pos", "r.*", "after_blank")


def imported_blocks(raw: Column | str) -> Column:
    """Blocks of a transcript document in any of its three shapes: {blocks}, {transcriptBlocks}, or a bare list."""
    block = f"array<struct<{BLOCK}>>"
    whole = F.from_json(raw, f"blocks {block}, transcriptBlocks {block}")
    return F.coalesce(whole["blocks"], whole["transcriptBlocks"], F.from_json(raw, block))


def tone(spark: SparkSession, rate: int, seconds: float, hz: float, amplitude: float = 0.5) -> DataFrame:
    """(i, sample) of a synthetic tone."""
    return spark.range(int(rate * seconds)).select(F.col("id").alias("i"), (amplitude * F.sin(2 * 3.141592653589793 * hz * F.col("id") / rate)).alias("sample"))
