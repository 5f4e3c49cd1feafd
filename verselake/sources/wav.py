"""WAV files as a data source: ``spark.read.format("wav")`` and back.

A read gives rows (path, rec_id, rate, first, samples): pieces of at most ``piece`` samples of each file, -1 to 1, of the
``channel`` asked for or of all averaged. Pieces are partitions (a run of small files shares one), so a long file is read by many tasks, each holding a
piece. A write takes rows (rec_id, first, samples) that come with each recording's pieces together and in order, as ``write``
sees to, streams each recording into a file of 16-bit samples, and moves files into place when the whole job has succeeded.

Paths are what pyarrow's file systems take (local, S3, HDFS, GCS). PCM of 8, 16, 24 and 32 bits and 32-bit floats are read; a header
whose length is unknown (0 or all ones) means up to the end of the file. Other files are an error that names them.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, rec_id string, rate int, first long, samples array<float>"
PIECE = 1 << 18
#: Format codes of integers, floats, and of headers that tell the format further on.
INTEGER, REAL, EXTENDED = 1, 3, 0xFFFE
UNKNOWN = (0, 0xFFFFFFFF)
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class Format:
    """What a header says: where samples begin, how many of them there are on each channel."""

    rate: int
    channels: int
    width: int
    real: bool
    offset: int
    count: int

    def decoded(self, data: bytes, channel: int | None = None) -> np.ndarray:
        """Samples of whole frames: of one channel (the last one if there are fewer), or of all averaged."""
        if self.real:
            x = np.frombuffer(data, "<f4").astype(np.float32)
        elif self.width == 1:
            x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
        elif self.width == 3:
            parts = np.frombuffer(data, np.uint8).reshape(-1, 3)
            x = (np.pad(parts, ((0, 0), (1, 0))).reshape(-1).view("<i4") / 2.0**31).astype(np.float32)
        else:
            x = (np.frombuffer(data, f"<i{self.width}") / 2.0 ** (8 * self.width - 1)).astype(np.float32)
        frames = x.reshape(-1, self.channels)
        return x if self.channels == 1 else frames.mean(axis=1) if channel is None else frames[:, min(channel, self.channels - 1)]


def read_format(file, size: int, name: str) -> Format:
    """The header of an open file of ``size`` bytes."""
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError(f"{name} is no WAV file")
    found, at = None, 12
    while at + 8 <= size:
        file.seek(at)
        kind, length = struct.unpack("<4sI", file.read(8))
        if kind == b"fmt ":
            body = file.read(min(length, 40))
            if len(body) < 16:
                raise ValueError(f"{name} ends in its header")
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
            if code == EXTENDED and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            width = bits // 8
            if (code, width) not in {(INTEGER, 1), (INTEGER, 2), (INTEGER, 3), (INTEGER, 4), (REAL, 4)} or not channels or not rate:
                raise ValueError(f"{name} has samples of format {code} with {bits} bits on {channels} channels")
            found = channels, rate, width, code == REAL
        elif kind == b"data":
            if found is None:
                raise ValueError(f"{name} has samples before their format")
            channels, rate, width, real = found
            room = size - at - 8
            usable = room if length in UNKNOWN else min(length, room)
            return Format(rate, channels, width, real, at + 8, usable // (width * channels))
        at += 8 + length + length % 2
    raise ValueError(f"{name} has no samples")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), os.path.abspath(uri)) if "://" not in uri and not uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


def _listed(uri: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the WAV files in a folder and below, or of one file, in order."""
    fs, path = _opened(uri)
    info = fs.get_file_info(path)
    infos = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    return sorted((prefix + i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.path.lower().endswith(".wav"))


def _rec(path: str) -> str:
    return path.rpartition("/")[2].rsplit(".", 1)[0]


class Pieces(InputPartition):
    """(uri, bytes, from, to) of pieces of files, in bytes of the file's samples."""

    def __init__(self, parts: list[tuple[str, int, int | None]]):
        super().__init__(None)
        self.parts = parts


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))
        self.channel = int(options["channel"]) if options.get("channel") else None

    def partitions(self) -> list[Pieces]:
        """Ranges of pieces of about equal size by the files' lengths alone; no file is opened here."""
        out, now, held = [], [], 0
        for uri, size in _listed(self.path):
            # The least bytes a sample can take is one; what lies past a file's real end is empty.
            pieces = max(1, -(-size // (2 * self.piece)))
            for k in range(pieces):
                now.append((uri, size, k, k == pieces - 1))
                held += min(size, 2 * self.piece)
                if held >= 2 * self.piece:
                    out.append(Pieces(now))
                    now, held = [], 0
        return [*out, Pieces(now)] if now or not out else out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float32())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for uri, size, k, last in partition.parts:
            fs, path = _opened(uri)
            with fs.open_input_file(path) as file:
                form = read_format(file, size, uri)
                begin = k * self.piece
                # The last one named has all that is left, in pieces of its own.
                stop = form.count if last else min(form.count, begin + self.piece)
                while begin < stop:
                    n = min(self.piece, stop - begin)
                    file.seek(form.offset + begin * form.width * form.channels)
                    samples = form.decoded(file.read(n * form.width * form.channels), self.channel)
                    row = [[uri], [_rec(uri)], [form.rate], [begin], [samples]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)
                    begin += n


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceWriter):
    """Each task writes files aside, the driver moves them when all have succeeded."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.rate = options["path"], int(options["rate"])
        self.aside, self.overwrite = f"_writing-{uuid.uuid4().hex}", overwrite

    def write(self, rows) -> Written:
        fs, folder = _opened(self.path)
        fs.create_dir(f"{folder}/{self.aside}", recursive=True)
        files, now, out, at = [], None, None, 0
        for row in rows:
            if row["rec_id"] != now or out is None:
                if out is not None:
                    out.close()
                now, at = row["rec_id"], 0
                aside = f"{folder}/{self.aside}/{uuid.uuid4().hex}.wav"
                files.append((aside, f"{folder}/{now}.wav"))
                out = fs.open_output_stream(aside)
                size = 2 * row["n"]
                out.write(HEADER.pack(b"RIFF", (36 + size) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, INTEGER, 1, self.rate, 2 * self.rate, 2, 16, b"data", min(size, 0xFFFFFFFF)))
            while at < row["first"]:
                gap = min(PIECE, row["first"] - at)
                out.write(bytes(2 * gap))
                at += gap
            samples = np.round(np.clip(np.asarray(row["samples"], float), -1, 1) * 32767).astype("<i2")
            out.write(samples.tobytes())
            at += len(samples)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        fs, folder = _opened(self.path)
        moves = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            kept = {target for _, target in moves}
            for uri, _ in _listed(self.path) if fs.get_file_info(folder).type == pafs.FileType.Directory else []:
                path = _opened(uri)[1]
                if path not in kept and self.aside not in path:
                    fs.delete_file(path)
        for aside, target in moves:
            fs.move(aside, target)
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, folder = _opened(self.path)
        if fs.get_file_info(f"{folder}/{self.aside}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.aside}")


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def write(audio: DataFrame, folder: str, rate: int, mode: str = "append") -> None:
    """Writes recordings (rec_id, first, samples), one file each; what lies between pieces is silence."""
    register(audio.sparkSession)
    n = audio.groupBy("rec_id").agg(F.max(F.col("first") + F.size("samples")).alias("n"))
    rows = audio.select("rec_id", F.col("first").cast("long").alias("first"), F.col("samples").cast("array<float>").alias("samples")).join(n, "rec_id")
    placed = rows.repartition("rec_id").sortWithinPartitions("rec_id", "first")
    placed.write.format("wav").option("rate", rate).mode(mode).save(folder)
