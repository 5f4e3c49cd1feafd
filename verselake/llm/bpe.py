"""Byte-level BPE encoding and decoding.

Pre-tokenisation finds every boundary of a whole batch of texts at once, without a regular expression: code points
are mapped to classes by a lookup array, each class (with what follows it) is a transition function over four states,
and an associative scan composes these functions, so the state before every code point is known without a loop over
code points. The slices between boundaries go through pair merging once per distinct slice (cached, within a bound in
bytes); the byte offset of every token is kept and lets the decoder place any range of tokens.

Defined results: a null text is an empty text (no ids); repeated rows give repeated rows; null ids are kept; columns
other than the id and text columns are ignored, whatever their names; an empty table gives an empty table. Memory
grows with the batch (about a quarter of a million code points, or the longest single text).
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verselake.llm.memory import released

OTHER, LETTER, NUMBER, SPACE, BLANK, END = 0, 1, 2, 3, 4, 5
#: Automaton states: FREE (the next code point is not glued), GLUED (a symbol joins what precedes), and the code
#: points still owed to a contraction.
FREE, GLUED, OWE1, OWE2 = 0, 1, 2, 3
CHUNK_CHARS = 1 << 18
#: Bytes that one generation of the cache of slices may hold, what an entry costs beside its own bytes, and the longest
#: slice that is kept.
CACHE_BYTES, ENTRY_BYTES, CACHED_SLICE = 32 << 20, 200, 64
#: Rows that are taken out of an Arrow batch at once, and tokens that are decoded at once.
PART_ROWS, DECODE_TOKENS = 256, 1 << 16
SCAN_BLOCK = 64
#: The white space of the split pattern, and its contractions by second and third letter.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACT_ONE = "stmd"
CONTRACT_TWO = ("re", "ve", "ll")


@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, from its general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1
    )
    out[WHITE_SPACE] = SPACE
    out[32] = BLANK
    return out


def _packed(*images: int) -> int:
    """A function on the four states, two bits for each image."""
    return sum(v << (2 * s) for s, v in enumerate(images))


#: Transition function of each symbol: letters and numbers, others, blank, other white space, apostrophe that opens a
#: contraction of one or of two letters. The same for the first code point of a text, where any state counts as FREE.
_PLAIN = [
    _packed(FREE, FREE, FREE, OWE1),
    _packed(GLUED, GLUED, GLUED, GLUED),
    _packed(GLUED, GLUED, GLUED, GLUED),
    _packed(FREE, FREE, FREE, FREE),
    _packed(OWE1, GLUED, OWE1, OWE1),
    _packed(OWE2, GLUED, OWE2, OWE2),
]
_SYMBOLS = np.array([*_PLAIN, *(_packed(*[p & 3] * 4) for p in _PLAIN)], np.uint8)
_SYMBOL_OF_CLASS = np.array([1, 0, 0, 3, 2], np.uint8)


@functools.lru_cache(maxsize=1)
def compose_table() -> np.ndarray:
    """compose[(f << 8) | g]: first f, then g."""
    f, g = np.arange(256)[:, None], np.arange(256)[None, :]
    out = np.zeros((256, 256), np.uint8)
    for s in range(4):
        mid = (f >> (2 * s)) & 3
        out |= (((g >> (2 * mid)) & 3) << (2 * s)).astype(np.uint8)
    return out.ravel()


def scan_states(functions: np.ndarray) -> np.ndarray:
    """State after each position, from FREE, by a blocked associative scan of transition functions."""
    n = len(functions)
    if n <= SCAN_BLOCK:
        state, out = FREE, np.empty(n, np.uint8)
        for i, f in enumerate(functions.tolist()):
            state = (f >> (2 * state)) & 3
            out[i] = state
        return out
    compose = compose_table()
    blocks = -(-n // SCAN_BLOCK)
    padded = np.full(blocks * SCAN_BLOCK, _packed(0, 1, 2, 3), np.uint8)
    padded[:n] = functions
    prefix = np.ascontiguousarray(padded.reshape(blocks, SCAN_BLOCK).T)
    for j in range(1, SCAN_BLOCK):
        prefix[j] = compose[(prefix[j - 1].astype(np.uint16) << 8) | prefix[j]]
    carry = np.zeros(blocks, np.uint8)
    carry[1:] = scan_states(prefix[-1])[:-1]
    states = (prefix >> (2 * carry)) & 3
    return np.ascontiguousarray(states.T).ravel()[:n]


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. ``firsts``: positions at which the texts (none of them empty) start."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    cls = class_table()[points]
    is_first = np.zeros(n, bool)
    is_first[firsts] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, cls[:-1]
    before[firsts] = END
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = END, cls[1:]
    after[firsts[firsts > 0] - 1] = END
    symbol = _SYMBOL_OF_CLASS[cls]
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        last = n - 1
        one = np.where(after[quotes] != END, points[np.minimum(quotes + 1, last)], 0)
        far = np.minimum(quotes + 1, last)
        two = np.where((after[quotes] != END) & (after[far] != END), points[np.minimum(quotes + 2, last)], 0)
        symbol[quotes[np.isin(one, [ord(c) for c in CONTRACT_ONE])]] = 4
        pair = np.zeros(len(quotes), bool)
        for a, b in CONTRACT_TWO:
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[quotes[pair]] = 5
    symbol[is_first] += 6
    state = scan_states(_SYMBOLS[symbol])
    entry = np.empty(n, np.uint8)
    entry[0], entry[1:] = FREE, state[:-1]
    entry[firsts] = FREE
    contraction_over = np.zeros(n, bool)
    contraction_over[1:] = (entry[:-1] == OWE1) & (entry[1:] == FREE)
    owed = entry >= OWE1
    word = (cls == LETTER) | (cls == NUMBER)
    starts = np.where(
        word,
        ~owed & (before != BLANK) & ((before != cls) | contraction_over),
        np.where(
            cls == OTHER,
            entry != GLUED,
            ((before != SPACE) & (before != BLANK)) | ((after != SPACE) & (after != BLANK) & (after != END)),
        ),
    )
    starts[firsts] = True
    return starts


class Merger(dict):
    """Cache from a slice's bytes to its ids as little-endian unsigned 32-bit integers. What is full becomes the older
    generation, from which slices that come again move to the newer one."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older, self.held = ranks, {}, 0

    def __missing__(self, piece: bytes) -> bytes:
        if len(piece) > CACHED_SLICE:
            return self._ids(piece)
        if self.held >= CACHE_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        known = self.older.get(piece)
        self[piece] = out = self._ids(piece) if known is None else known
        self.held += ENTRY_BYTES + len(piece) + len(out)
        return out

    def _ids(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        ids = [whole] if whole is not None else self._merge(piece) if len(piece) <= CACHED_SLICE else self._merge_long(piece)
        return np.array(ids, "<u4").tobytes()

    def _merge(self, piece: bytes) -> list[int]:
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((r for r in pairs if r is not None), default=None)
            if best is None:
                return [self.ranks[p] for p in parts]
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges from a heap over a linked list, for slices of any length."""
        get, n = self.ranks.get, len(piece)
        ends, prev, following = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, end = heapq.heappop(heap)
            j = following[i]
            if not alive[i] or j >= n or ends[j] != end or get(piece[i:end]) != rank:
                continue
            alive[j] = 0
            ends[i], following[i] = end, following[j]
            if following[i] < n:
                prev[following[i]] = i
                if (r := get(piece[i : ends[following[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[following[i]]))
            if prev[i] >= 0 and (r := get(piece[prev[i] : end])) is not None:
                heapq.heappush(heap, (r, prev[i], end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : ends[i]]])
            i = following[i]
        return out


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(read_ranks(path))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and the start and length of each id."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    length = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(length) - length, length


def slices(texts: list[str]) -> Iterator[list[bytes]]:
    """The pre-tokens of each text, as bytes."""
    begin = 0
    while begin < len(texts):
        end, chars = begin, 0
        while end < len(texts) and (end == begin or chars + len(texts[end]) <= CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        part = texts[begin:end]
        begin = end
        joined = "".join(part)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = joined.encode()
        edges = np.cumsum([0, *map(len, part)])
        firsts = np.unique(edges[:-1][np.diff(edges) > 0])
        starts = np.flatnonzero(token_starts(points, firsts))
        if len(data) == len(points):
            byte_at = starts
        else:
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            byte_at = (np.cumsum(width) - width)[starts]
        cuts = [*byte_at.tolist(), len(data)]
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        of_text = np.searchsorted(starts, edges).tolist()
        for a, b in zip(of_text, of_text[1:]):
            yield pieces[a:b]


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[bytes, bytes]]:
    """For each text its ids and the byte offset of each token, as little-endian unsigned 32-bit integers."""
    cache, (_, _, length) = merger(path), vocabulary(path)
    for pieces in slices(texts):
        ids = b"".join(map(cache.__getitem__, pieces))
        size = length[np.frombuffer(ids, "<u4")]
        yield ids, (np.cumsum(size) - size).astype("<u4").tobytes()


def decode_ids(ids: bytes, offsets: bytes, path: str) -> bytes:
    """The bytes of a run of tokens, each placed at its offset (relative to the first)."""
    token = np.frombuffer(ids, "<u4")
    pool, start, length = vocabulary(path)
    at = np.frombuffer(offsets, "<u4").astype(np.int64)
    out = []
    for i in range(0, len(token), DECODE_TOKENS):
        some, place = token[i : i + DECODE_TOKENS], at[i : i + DECODE_TOKENS]
        size = length[some]
        total = int(place[-1] - place[0] + size[-1])
        shift = np.repeat(start[some] - (place - place[0]), size)
        out.append(pool[np.arange(total) + shift].tobytes())
    return b"".join(out)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, PART_ROWS) for i in range(0, batch.num_rows, PART_ROWS))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    """(_id, ids, offsets), and the bytes that the ids decode to, of batches of (_id, _text), in parts of bounded size."""
    names = ["_id", "ids", "offsets", "decoded"][: 3 + decoded]
    for batch in parts(batches):
        begin, held, rows = 0, 0, []
        for ids, offsets in encode_texts([t or "" for t in batch.column(1).to_pylist()], path):
            rows.append((ids, offsets, decode_ids(ids, offsets, path)) if decoded else (ids, offsets))
            held += len(ids)
            if held > CHUNK_CHARS * 8 or begin + len(rows) == batch.num_rows:
                values = [pa.array(column, pa.binary()) for column in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(rows)), *values], names)
                begin, held, rows = begin + len(rows), 0, []


def _mapped(df: DataFrame, ranks_path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    chosen = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = chosen.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, ids binary, offsets binary" + (", decoded binary" if decoded else "")

    def run(batches):
        yield from released(_encoded(batches, ranks_path, decoded))
        merger(ranks_path).older = {}

    return chosen.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary, offsets binary) of each row; see the module for both formats."""
    return _mapped(df, ranks_path, id_col, text_col, False)


def round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with ``decoded``, the bytes that ids and offsets decode to, from one pass with one vocabulary."""
    return _mapped(df, ranks_path, id_col, text_col, True)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, decoded binary) of rows of ``encode``."""
    chosen = df.select(F.col(id_col).alias("_id"), "ids", "offsets")
    kind = chosen.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in parts(batches):
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            decoded = [decode_ids(a or b"", b or b"", ranks_path) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoded, pa.binary())], ["_id", "ids", "decoded"])

    return chosen.mapInArrow(run, f"_id {kind}, ids binary, decoded binary").withColumnRenamed("_id", id_col)


def digests(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and describe both by digests."""
    return round_trip(df, ranks_path, id_col, text_col).select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
