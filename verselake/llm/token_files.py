"""Token ids as Arrow files with fixed-size-list batches.

Documents are sorted by id over ranges; each range becomes one Arrow file on storage that all executors share, holding
its ids end to end in rows of ``seq_len`` ids with a mask of the same shape (false only on the padding of the last row).
A row sits at a known place of a mapped file, so any sequence is read without a copy. A manifest row for each document
names its file and its place in it; files of a repeated task get a name of their own, and only files in the manifest count.

Tokenising splits a text at ASCII white space, where no token of this vocabulary crosses, and looks its words up in a cache
of bounded size. New words of Latin letters, digits and symbols are lower-cased and cut as the vocabulary does it, and the
tokenizers library gets each distinct piece once, many in a call. Other words go to the library as they are, also those that
may hold an added token, which it takes out as its id, and all words of a vocabulary that doesn't cut like this one.

Defined results: a null text is an empty text (only the end id); rows with one id are ordered by their text; null ids
come first; other columns are ignored, whatever their names; an empty table gives an empty table and no file.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verselake.session import scratch_path, written

SEQ_LEN = 2048
#: Rows of a record batch, and entries of the word cache.
BATCH_ROWS, CACHE_ENTRIES = 512, 1 << 20
#: Bytes of text that a file holds about, and rows whose mean size tells how many files that makes.
FILE_BYTES, SIZED_ROWS = 256 << 20, 1000
#: Characters of the words that are looked up together, and words that go to the library as one text.
BLOCK_CHARS, JOINED = 1 << 16, 256
#: Below this code point no character changes with its neighbours when it is normalised, and lower case is the same everywhere.
LATIN_END = "\u0300"
_LATIN = [c for c in map(chr, range(0x21, ord(LATIN_END))) if c.isprintable() and max(c.lower()) < LATIN_END]
_LETTERS = re.escape("".join(c for c in _LATIN if c.isalpha()))
_NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
#: The vocabulary's own split, over printable characters below LATIN_END in lower case.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """The library's tokenizer with the same model, for pieces that are normalised and split already, between spaces."""
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer(tokenizer(path).model)
    bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), bytes_of])
    return out


class Words(dict):
    """Cache from a white-space-free word to the bytes of its ids. What is full becomes the older generation, from which words
    that come again move to the newer one. Whether a vocabulary cuts Latin words as ``_PIECES`` does is tried at the start."""

    def __init__(self, path: str, dtype: str):
        super().__init__()
        self.tokenizer, self.dtype, self.older = tokenizer(path), dtype, {}
        ends = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.word_end = np.array([t.endswith("</w>") for t in ends], bool)
        # Added tokens are looked for before letters are lower-cased; what may hold one in either case is left as it is.
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.pieces, self.latin = pieces(path), True
        probe = [w for c in _LATIN for w in (c, f"A{c}b", f"9{c}'S", f"{c}'Re")]
        self.learn(probe)
        self.latin = all(self[w] == ids for w, ids in zip(probe, self._whole(probe)))
        self.clear()

    def learn(self, new: Iterable[str]) -> None:
        """Enters words that the cache lacks."""
        new = [*new]
        if len(self) + len(new) > CACHE_ENTRIES // 2:
            self.older = dict(self)
            self.clear()
        older, stems, ask, parts = self.older, {}, [], []
        for w in new:
            known = older.get(w)
            if known is not None:
                self[w] = known
                continue
            low = w.lower()
            if not self.latin or (not low.isascii() and max(low) >= LATIN_END):
                ask.append(w)
            elif low.isalpha():
                stems[low] = None
                if low != w:
                    parts.append((w, (low,)))
            elif low.isprintable() and not ("<" in low and self.added.search(low)):
                some = _PIECES.findall(low)
                stems.update(dict.fromkeys(some))
                if len(some) > 1 or low != w:
                    parts.append((w, some))
            else:
                ask.append(w)
        self.update((w, older[w]) for w in stems if w in older)
        self._joined([w for w in stems if w not in self])
        self.update(zip(ask, self._whole(ask)))
        for w, some in parts:
            self[w] = b"".join([self[p] for p in some])

    def _joined(self, stems: list[str]) -> None:
        """Pieces that the library takes out of a text as they are; many make one text, whose ids show where each ends."""
        size = np.dtype(self.dtype).itemsize
        for k in range(0, len(stems), JOINED):
            some = stems[k : k + JOINED]
            # This call keeps no offsets of characters, which nothing reads.
            ids = np.array(self.pieces.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            edges = [0, *((np.flatnonzero(self.word_end[ids]) + 1) * size).tolist()]
            joined = ids.astype(self.dtype).tobytes()
            cut = [joined[i:j] for i, j in zip(edges, edges[1:])]
            self.update(zip(some, cut if len(cut) == len(some) else self._whole(some)))

    def _whole(self, words: list[str]) -> list[bytes]:
        """The ids of words that the library normalises and splits itself."""
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if words else ()
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]


@functools.lru_cache(maxsize=2)
def words(path: str, dtype: str) -> Words:
    return Words(path, dtype)


def tokenised(texts: list[str], path: str, dtype: str):
    """The ids of each text as bytes of ``dtype``."""
    cache = words(path, dtype)
    for some in _blocks(texts):
        split = [*map(_split, some)]
        flat = [*itertools.chain.from_iterable(split)]
        found = [*map(cache.get, flat)]
        # In order of appearance, so that what is read next lies near in memory.
        new = dict.fromkeys(w for w, ids in zip(flat, found) if ids is None)
        if new:
            cache.learn(new)
            found = [cache[w] if ids is None else ids for w, ids in zip(flat, found)]
        begin = 0
        for s in split:
            yield b"".join(found[begin : begin + len(s)])
            begin += len(s)


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts that are looked up together."""
    begin, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= BLOCK_CHARS or i + 1 == len(texts):
            yield texts[begin : i + 1]
            begin, chars = i + 1, 0


#: str.split() also splits at white space outside ASCII and at the separators 1C to 1F; the vocabulary's own pattern
#: decides about those, so a text that has them is cut at ASCII white space only.
_EXOTIC = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _split(text: str) -> list[str]:
    exotic = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _EXOTIC.search(text)
    return [w.decode() for w in text.encode().split()] if exotic else text.split()


def _schema(dtype: str, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class Writer:
    """Packs ids into rows of equal length and writes them batch by batch."""

    def __init__(self, uri: str, seq_len: int, dtype: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.seq_len, self.dtype, self.schema = seq_len, np.dtype(dtype), _schema(dtype, seq_len)
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.size = [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH_ROWS * self.seq_len * self.dtype.itemsize:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        step = BATCH_ROWS * self.seq_len
        whole = len(ids) if last else len(ids) // step * step
        for i in range(0, whole, step):
            part = ids[i : min(i + step, whole)]
            padded = np.zeros(-(-len(part) // self.seq_len) * self.seq_len, self.dtype)
            padded[: len(part)] = part
            mask = np.arange(len(padded)) < len(part)
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(padded), self.seq_len),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len),
            ]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        rest = ids[whole:].tobytes()
        self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        self._write(True)
        self.out.close()
        self.sink.close()


class Reader:
    """Random access to the sequences of a file; a local file is mapped, so nothing is copied before it is asked for."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, tuple[np.ndarray, pa.BooleanArray]] = (-1, (np.zeros(0), pa.array([], pa.bool_())))

    def batch(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and masks of batch i, end to end; the last batch asked for is kept."""
        if self.last[0] != i:
            got = self.file.get_batch(i)
            self.last = (i, (got.column(0).values.to_numpy(zero_copy_only=True), got.column(1).values))
        return self.last[1]

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(row // BATCH_ROWS)
        at = (row % BATCH_ROWS) * self.seq_len
        return ids[at : at + self.seq_len], mask.slice(at, self.seq_len).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start..start + n of the file's stream."""
        step, parts = BATCH_ROWS * self.seq_len, []
        end = start + n
        while start < end:
            ids, _ = self.batch(start // step)
            at = start % step
            parts.append(ids[at : at + end - start])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def close(self) -> None:
        self.source.close()


def files_for(rows: DataFrame) -> int:
    """How many files hold the texts at about FILE_BYTES each, by their number and the mean size of a few; at least one for each
    shuffle partition. It sizes files only: every row is written."""
    few = rows.limit(SIZED_ROWS).agg(F.avg(F.octet_length("_text")).alias("b")).first()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(rows.count() * (few["b"] or 0) / FILE_BYTES))


def write_files(
    df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, folder: str | None = None
) -> DataFrame:
    """Write the files and return their manifest (id_col, part, at, n_tokens, file), ``at`` counting within the file."""
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    dtype = "<u2" if max(tokenizer(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    end = np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize
    chosen = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = chosen.schema["_id"].dataType.simpleString()
    # Ranges of ids alone: the sample that finds them goes to the driver, and texts must not.
    ordered = chosen.repartitionByRange(files_for(chosen), "_id").sortWithinPartitions("_id", "_text")

    def run(batches):
        from pyspark import TaskContext

        writer, uri, at = None, "", 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
                writer = Writer(uri, seq_len, dtype)
            starts, counts = [], []
            for ids in tokenised(batch.column(1).to_pylist(), tokenizer_path, dtype):
                writer.add(ids + end)
                n = len(ids) // width + 1
                starts.append(at)
                counts.append(n)
                at += n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([part] * len(starts), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([uri] * len(starts), pa.string()),
                ],
                ["_id", "part", "at", "n_tokens", "file"],
            )
        if writer is not None:
            writer.close()

    # Written once, so no later step can repeat the tasks that write files.
    return written(ordered.mapInArrow(run, f"_id {kind}, part int, at long, n_tokens long, file string"), "manifest").withColumnRenamed("_id", id_col)


def with_global_start(manifest: DataFrame) -> DataFrame:
    """Add ``start``: how many ids all files hold before this place. One row for each file reaches the driver's side of
    the window, never one for each document."""
    files = manifest.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    return manifest.join(F.broadcast(starts), "file").withColumn("start", (F.col("file_start") + F.col("at")).cast("long")).drop("file_start")


def read_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) read back from the files, the checksum over 32-bit little-endian ids."""
    placed = with_global_start(manifest).select(F.col(id_col).alias("_id"), "start", "n_tokens", "file", "at")
    kind = placed.schema["_id"].dataType.simpleString()

    def run(batches):
        readers: dict[str, Reader] = {}
        for batch in batches:
            sums = []
            for file, at, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_pylist()):
                if file not in readers:
                    for r in readers.values():
                        r.close()
                    readers = {file: Reader(file)}
                sums.append(zlib.crc32(readers[file].tokens(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], ["_id", "start", "n_tokens", "ids_crc32"])

    out = placed.mapInArrow(run, f"_id {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("_id", id_col)
