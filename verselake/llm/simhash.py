"""SimHash near-dedup with BK-trees.

A text's fingerprint is the majority bit of the hashes of its word shingles. Rows with one fingerprint are folded into
a class first. Any two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit blocks, so classes
are dealt into shards by (block, value); the BK-tree of a shard travels with its queries to one task, where each query
follows only edges whose length differs from its own distance by at most the radius. A shard beyond ``SHARD_ROWS`` is
dealt again by the blocks of its other bits, which loses no pair. A shard returns a spanning forest of its links (never
all pairs), and the forests are joined by distributed connected components.

The trees aren't sent to every executor: together they hold all fingerprints, which has no bound; the shuffle sends
each shard's tree only where its queries are.

Defined results: null and word-less texts have fingerprint zero and link like any other; rows with one text share a
component; rows with a null id are kept, name no component, and get a null one if no row of their fingerprint has an id;
other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verselake.llm import skew
from verselake.llm.components import connected_components
from verselake.llm.memory import released
from verselake.session import discard, unused, written

BITS = 64
#: A shard of more classes than this is dealt again by its other bits.
SHARD_ROWS = 2048
#: Classes that a task gathers before it builds their trees, and (query, tree size) pairs that it searches at once.
GATHER_ROWS, SEARCH_PAIRS = 200_000, 4_000_000
SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle (bytes outside A-Z kept as they are; words end at ASCII white space)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    of = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(shingle)))
    return np.fromiter((of(s, SEED) for s in map(b" ".join, runs)), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 60_000):
        part = hashes[i : i + 60_000].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long): the fingerprint's bits as a signed long."""
    chosen = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = chosen.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.fromiter(
                (majority(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["_id", "fp"])

    return chosen.mapInArrow(lambda batches: released(run(batches)), f"_id {kind}, fp long").withColumnRenamed("_id", id_col)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class BKForest:
    """BK-trees of many shards side by side: node i has a first parent edge of integer Hamming length; children of a
    node have distinct lengths. Arrays instead of objects, built and searched level by level."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        n = len(fps)
        self.fps, self.root = fps, np.empty(n, np.int64)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
        self.root[:] = first[inverse]
        at = self.root.copy()
        waiting = np.flatnonzero(at != np.arange(n))
        while len(waiting):
            length = popcount(fps[waiting] ^ fps[at[waiting]]).astype(np.int64)
            slot = at[waiting] * (BITS + 1) + length
            _, head, group = np.unique(slot, return_index=True, return_inverse=True)
            child = waiting[head]
            parent[child], edge[child] = at[child], length[head]
            at[waiting] = child[group]
            keep = np.ones(len(waiting), bool)
            keep[head] = False
            waiting = waiting[keep]
        key = np.where(parent >= 0, parent * (BITS + 1) + edge, -1)
        self.by_key = np.argsort(key, kind="stable")
        self.keys = key[self.by_key]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) arrays of all pairs within the radius in one tree; queries are node numbers."""
        q, node = queries, self.root[queries]
        while len(q):
            d = popcount(self.fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            base = node * (BITS + 1)
            low = np.searchsorted(self.keys, base + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, base + np.minimum(d + radius, BITS), "right")
            width = high - low
            total = int(width.sum())
            if not total:
                return
            q = np.repeat(q, width)
            node = self.by_key[np.arange(total) + np.repeat(low - (np.cumsum(width) - width), width)]

    def forest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of all links within the radius: (node, root of its tree)."""
        n = len(self.fps)
        label = np.arange(n)
        size = np.bincount(self.root, minlength=n)[self.root]
        order = np.argsort(self.root, kind="stable")
        cut = np.cumsum(size[order]) // SEARCH_PAIRS
        for block in np.split(order, np.flatnonzero(np.diff(cut)) + 1):
            for a, b in self.search(block, radius):
                label = merge_labels(label, a, b)
        apart = np.flatnonzero(label != np.arange(n))
        return apart, label[apart]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a node number no larger than the node's own) after joining a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        la, lb = la[differ], lb[differ]
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def _widths(bits: int, blocks: int) -> list[int]:
    return [bits * (i + 1) // blocks - bits * i // blocks for i in range(blocks)]


def _block(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def block_keys(fp: Column, blocks: int) -> list[Column]:
    """The values of consecutive bit blocks of a fingerprint."""
    widths = _widths(BITS, blocks)
    return [_block(fp, sum(widths[:i]), w) for i, w in enumerate(widths)]


def other_bits(fp: Column, blocks: int, i: int) -> tuple[Column, int]:
    """The fingerprint without block i, and how many bits that is."""
    widths = _widths(BITS, blocks)
    start, width = sum(widths[:i]), widths[i]
    low = _block(fp, 0, start) if start else F.lit(0).cast("long")
    rest = BITS - start - width
    high = _block(fp, start + width, rest) if rest else F.lit(0).cast("long")
    return low.bitwiseOR(F.shiftleft(high, start)), BITS - width


def sharded(classes: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard binary-safe key columns s0..s3, fp, rep): each class once for each block, crowded shards dealt again."""
    blocks = radius + 1
    fp = F.col("fp")
    dealt = classes.select(
        "fp", "rep", F.posexplode(F.array(*block_keys(fp, blocks))).alias("s0", "s1")
    )
    crowded = dealt.groupBy("s0", "s1").count().filter(F.col("count") > shard_rows).select("s0", "s1", F.lit(True).alias("crowded"), "count")
    marked = skew.join(dealt, crowded, ["s0", "s1"], "count", classes.count() * blocks, "left")
    sub = F.lit(None)
    for i in reversed(range(blocks)):
        bits, n = other_bits(fp, blocks, i)
        widths = _widths(n, blocks)
        values = F.array(*(_block(bits, sum(widths[:j]), w) for j, w in enumerate(widths)))
        sub = F.when(F.col("s0") == i, values).otherwise(sub)
    one = F.array(F.lit(-1).cast("long"))
    return marked.select(
        "s0", "s1", F.posexplode(F.when(F.col("crowded"), sub).otherwise(one)).alias("s2", "s3"), "fp", "rep"
    )


def spanning(rep: np.ndarray, forest: BKForest, radius: int) -> pd.DataFrame:
    node, root = forest.forest(radius)
    return pd.DataFrame({"u": rep[node], "v": rep[root]})


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between the reps of classes that share a shard, those that span what it connects."""
    key = ["s0", "s1", "s2", "s3"]

    def links(gathered: list[pd.DataFrame], tail: bool) -> tuple[pd.DataFrame | None, list[pd.DataFrame]]:
        all_rows = pd.concat(gathered, ignore_index=True) if len(gathered) > 1 else gathered[0]
        if not len(all_rows):
            return None, []
        code = (all_rows[key].ne(all_rows[key].shift())).any(axis=1).cumsum().to_numpy()
        whole = len(code) if tail else int(np.searchsorted(code, code[-1]))
        if not whole:
            return None, [all_rows]
        part = all_rows.iloc[:whole]
        rep = part["rep"].to_numpy()
        forest = BKForest(part["fp"].to_numpy().view(np.uint64), code[:whole])
        return spanning(rep, forest, radius), [all_rows.iloc[whole:]]

    def run(frames):
        gathered, held = [], 0
        for frame in frames:
            gathered.append(frame)
            held += len(frame)
            if held >= GATHER_ROWS:
                out, gathered = links(gathered, False)
                held = sum(map(len, gathered))
                if out is not None:
                    yield out
        if gathered:
            out, _ = links(gathered, True)
            if out is not None:
                yield out

    placed = shards.repartition(*key).sortWithinPartitions(*key)
    return placed.mapInPandas(lambda batches: released(run(batches)), "u long, v long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(id_col, fp, component): texts whose fingerprints are linked by steps of at most ``radius`` bits share a
    component, named by its least id."""
    prints = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    return components_of(prints, id_col, radius, shard_rows)


def components_of(prints: DataFrame, id_col: str, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``near_duplicates`` of given fingerprints (id_col, fp)."""
    classes = written(prints.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("least"), F.count("*").alias("n")), "classes")
    named = classes.filter("least is not null").select("fp", F.col("least").alias("rep"), "n")
    links = shard_links(sharded(named, radius, shard_rows), radius)
    found = connected_components(links)
    component = named.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component"), "n"
    )
    return skew.join(prints, component, ["fp"], "n", prints.count(), "left").select(id_col, "fp", "component")


# Near-duplicates by similarity. A pair as similar as 0.8 differs in about ten bits of its fingerprints, too many for bit
# blocks to deal shards by. So the BK-trees propose what lies within their radius, and shards by min-hashes propose the rest:
# each of BANDS shards of a class is named by two min-hashes, and a pair at 0.8 shares none with a chance of
# (1 - 0.8 ** 2) ** BANDS, under one in a million. Whatever is proposed is held to the exact Jaccard similarity of the shingle
# sets, of 32-bit hashes. First each member of a shard is held to the shard's head, its least member. A shard whose members
# are connected by then has nothing left to find; in the others every pair that isn't connected yet is held to it, in cells of
# bounded size.
BANDS, SIMILAR, RADIUS = 14, 0.8, 2
#: Shingles that a block of a crowded shard holds on average at most.
BLOCK_SHINGLES = 1_000_000
#: Members that are held to one head in one task are at most about 1/SLICES of all such pairs; fewer than SLICES heads have
#: more and are sliced, so their table may be broadcast.
SLICES = 1000
_SALTS = np.random.default_rng(SEED).integers(1, 1 << 63, (2, 2 * BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS values, each of two min-hashes of a set of shingle hashes; of no shingle zeros."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    least = np.full(2 * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 20_000):
        mixed = hashes[None, i : i + 20_000] * _SALTS[0][:, None]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _SALTS[1][:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    two = least.reshape(BANDS, 2)
    return ((two[:, 0] ^ (two[:, 1] >> np.uint64(31))) * _SALTS[0, 0] ^ two[:, 1]).view(np.int64)


def folded_digest(text: str | None) -> bytes:
    """128 bits of the folded words."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split()), SEED)


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id_col, folded, fp, bands, size): digest of the folded words, fingerprint, band values, number of distinct shingles."""
    chosen = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                folded, fps, bands, sizes = [], [], [], []
                for text in part.column(1).to_pylist():
                    hashes = shingle_hashes(text, shingle)
                    distinct = np.unique(hashes)
                    folded.append(folded_digest(text))
                    fps.append(majority(hashes))
                    bands.append(band_keys(distinct))
                    sizes.append(len(distinct))
                lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(bands) + 1, BANDS, dtype=np.int32), np.concatenate(bands))
                columns = [pa.array(folded, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists, pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["_id", "folded", "fp", "bands", "size"])

    return chosen.mapInArrow(lambda batches: released(run(batches)), "_id long, folded binary, fp long, bands array<long>, size long").withColumnRenamed("_id", id_col)


def shingle_sets(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(rep, folded, set): 32 bits of the distinct shingle hashes of each row, ascending as unsigned numbers."""
    chosen = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column(1).to_pylist()
                sets = [np.unique((shingle_hashes(t, shingle) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in texts]
                columns = [pa.array([folded_digest(t) for t in texts], pa.binary()), pa.array(sets, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["rep", "folded", "set"])

    return chosen.mapInArrow(lambda batches: released(run(batches)), "rep long, folded binary, set array<int>")


def band_members(classes: DataFrame) -> DataFrame:
    """(s0, s1, head, rep, folded, size): classes by each band value that another class shares, with the shard's least class.
    Of shards with the same members one is kept."""
    dealt = classes.select("rep", "folded", "size", F.posexplode("bands").alias("s0", "s1"))
    one = F.xxhash64("rep", "folded")
    shards = dealt.groupBy("s0", "s1").agg(
        F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(F.xxhash64(one, F.lit(SEED))).alias("y"), F.min(F.struct("rep", "folded", "size")).alias("head")
    ).filter("n > 1")
    chosen = shards.groupBy("n", "x", "y").agg(F.min(F.struct("s0", "s1", "head")).alias("s"))
    return skew.join(dealt, chosen.select("s.s0", "s.s1", "s.head", "n"), ["s0", "s1"], "n", classes.count() * BANDS)


def tree_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(head, rep, folded, size), written: what the BK-trees over the fingerprints link, and classes of one fingerprint."""
    named = written(classes.groupBy("fp").agg(F.min(F.struct("rep", "folded", "size")).alias("first")), "named")
    by_id = written(named.groupBy(F.col("first.rep").alias("r")).agg(F.min("first").alias("first"), F.min("fp").alias("fp")), "nodes")
    links = written(shard_links(sharded(by_id.select("fp", F.col("r").alias("rep")), radius), radius), "links")
    roots = links.join(by_id.select(F.col("r").alias("v"), F.col("first").alias("head")), "v").join(by_id.select(F.col("r").alias("u"), "first"), "u")
    alike = classes.join(named, "fp").select(F.col("first").alias("head"), "rep", "folded", "size")
    out = written(roots.select("head", "first.*").union(alike), "near")
    discard(named, by_id, links)
    return out


def star_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): reps of the pairs (head, rep, folded), without repeats, that are as similar. Pairs of one head are sliced, the
    head's set goes to each slice once, and members stream past it."""
    total = pairs.count()
    many = pairs.groupBy("head").count().filter(F.col("count") * SLICES > total)
    many = F.broadcast(many.select("head", F.ceil(F.col("count") * SLICES / max(total, 1)).alias("slices")))
    cut = pairs.join(many, "head", "left").withColumn("slice", F.pmod(F.xxhash64("rep", "folded"), F.coalesce("slices", F.lit(1))))
    members = cut.join(sets, ["rep", "folded"]).select("head", "slice", F.lit(1).alias("role"), "rep", "set")
    heads = cut.select("head", "slice").distinct().withColumns({"rep": F.col("head.rep"), "folded": F.col("head.folded")})
    heads = heads.join(sets, ["rep", "folded"]).select("head", "slice", F.lit(0).alias("role"), "rep", "set")
    key = ["head.rep", "head.folded", "slice"]
    placed = heads.union(members).repartition(*key).sortWithinPartitions(*key, "role").select("role", "rep", "set")

    def run(batches):
        head, own = None, np.zeros(0, np.uint32)
        for batch in batches:
            role, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy().view(np.uint32)
            us, vs = [], []
            edges = [0, *np.flatnonzero(role == 0).tolist(), len(role)]
            for a, z in zip(edges, edges[1:]):
                if a < z and role[a] == 0:
                    head, own, a = int(rep[a]), flat[at[a] : at[a + 1]].copy(), a + 1
                if a == z:
                    continue
                sizes = np.diff(at[a : z + 1]).astype(np.int64)
                values = flat[at[a] : at[z]]
                if len(own):
                    spot = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    inside = np.concatenate([[0], np.cumsum(own[spot] == values)])
                else:
                    inside = np.zeros(len(values) + 1, np.int64)
                ends = np.cumsum(sizes)
                shared = inside[ends] - inside[ends - sizes]
                union = sizes + len(own) - shared
                hits = np.flatnonzero((shared >= similarity * union) & (union > 0)) + a
                us += rep[hits].tolist()
                vs += [head] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return placed.mapInArrow(lambda batches: released(run(batches)), "u long, v long")


def cells_of(members: DataFrame, found: DataFrame, shard_rows: int) -> DataFrame:
    """(s0..s3, rep, folded, label): members (s0, s1, rep, folded, size) of the shards that ``found`` (node, component) leaves
    in several components, as cells in which each pair of a shard that isn't connected yet meets. A crowded shard is cut
    into blocks, those of its largest component apart: they meet the others' blocks, but not each other."""
    labelled = members.join(found, F.col("rep") == F.col("node"), "left").select("s0", "s1", "rep", "folded", "size", F.coalesce("component", "rep").alias("label"))
    parts = labelled.groupBy("s0", "s1", "label").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    shards = parts.groupBy("s0", "s1").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max(F.struct("n", "total", "label")).alias("most")
    ).filter("parts > 1")
    blocks = lambda n, total: F.ceil(F.greatest(n / max(shard_rows, 1), total / BLOCK_SHINGLES, F.lit(1))).cast("long")
    fits = blocks(F.col("n"), F.col("total")) == 1
    cuts = shards.select(
        "s0", "s1", F.col("most.label").alias("most"),
        F.when(fits, 0).otherwise(F.least(blocks(F.col("most.n"), F.col("most.total")), F.col("most.n"))).alias("own_blocks"),
        F.least(blocks(F.col("n") - F.col("most.n"), F.col("total") - F.col("most.total")), F.col("n") - F.col("most.n")).alias("blocks"),
    )
    # As a table of its own it is broadcast if it is small, and a crowded shard's side of the join can be split if not.
    marked = labelled.join(written(cuts, "cuts"), ["s0", "s1"])
    among = (F.col("label") == F.col("most")) & (F.col("own_blocks") > 0)
    spread = F.xxhash64(F.lit(SEED), "rep", "folded")
    own = F.when(among, F.pmod(spread, F.col("own_blocks"))).otherwise(F.col("own_blocks") + F.pmod(spread, F.col("blocks")))
    others = F.sequence(F.when(among, F.col("own_blocks")).otherwise(F.lit(0)).cast("long"), F.col("own_blocks") + F.col("blocks") - 1)
    met = marked.select("s0", "s1", "rep", "folded", "label", own.alias("own"), F.explode(others).alias("other"))
    return met.select("s0", "s1", F.least("own", "other").alias("s2"), F.greatest("own", "other").alias("s3"), "rep", "folded", "label")


def linked(sets: list[np.ndarray], similarity: float, labels: list[int]) -> tuple[list[int], list[int]]:
    """Links that span what the pairs of at least this Jaccard similarity connect, beside what ``labels`` do. Sets that share
    most come first; a set is held against all others at once, by the postings of its members, unless it is linked to all it
    could be."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings = owner[np.argsort(code, kind="stable")]
    end = np.cumsum(count)
    at = np.concatenate([[0], np.cumsum(size)])
    weight = np.bincount(owner, weights=count[code], minlength=n)
    label, waiting = np.unique(labels, return_inverse=True)[1], np.ones(n, bool)
    us: list[int] = []
    vs: list[int] = []
    for q in np.argsort(-weight, kind="stable").tolist():
        waiting[q] = False
        open_ = waiting & (label != label[q])
        if not open_.any():
            continue
        mine = code[at[q] : at[q + 1]]
        width = count[mine]
        total = int(width.sum())
        where = np.arange(total) + np.repeat(end[mine] - np.cumsum(width), width)
        shared = np.bincount(postings[where], minlength=n)
        union = size[q] + size - shared
        hits = np.flatnonzero(open_ & (shared >= similarity * union) & (union > 0))
        if len(hits):
            joined, first = np.unique(label[hits], return_index=True)
            us += [q] * len(first)
            vs += hits[first].tolist()
            label[np.isin(label, joined)] = label[q]
    return us, vs


def cell_links(cells: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between the reps of classes (s0..s3, rep, set, label) that share a cell but no label, verified exactly."""
    key = ["s0", "s1", "s2", "s3"]

    def run(batches):
        now, reps, sets, labels = None, [], [], []

        def links():
            us, vs = linked(sets, similarity, labels) if len(set(labels)) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([reps[i] for i in us], pa.int64()), pa.array([reps[i] for i in vs], pa.int64())], ["u", "v"])

        for batch in batches:
            rep, at, label = batch.column(4).to_pylist(), batch.column(5).offsets.to_numpy(), batch.column(6).to_pylist()
            flat = batch.column(5).values.to_numpy()
            for i, cell in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if cell != now:
                    if len(sets) > 1:
                        yield links()
                    now, reps, sets, labels = cell, [], [], []
                reps.append(rep[i])
                labels.append(label[i])
                sets.append(flat[at[i] : at[i + 1]])
        if len(sets) > 1:
            yield links()

    placed = cells.select(*key, "rep", "set", "label").repartition(*key).sortWithinPartitions(*key)
    return placed.mapInArrow(lambda batches: released(run(batches)), "u long, v long")


def similar_components(
    df: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = SIMILAR, radius: int = RADIUS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(id_col, component): texts linked by steps of at least this Jaccard similarity of their shingles share the least id of
    them. Rows without an id have a null component."""
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    prints = written(sketches(rows, "doc", "text", shingle), "sketches")
    first = (F.any_value(c).alias(c) for c in ("fp", "bands", "size"))
    classes = written(prints.filter("doc is not null").groupBy("folded").agg(F.min("doc").alias("rep"), *first), "classes")
    members = written(band_members(classes), "members")
    near = tree_pairs(classes, radius)
    proposed = members.select("head", "rep", "folded", "size").union(near).distinct()
    # Sets of less similar sizes can't be as similar.
    sizes = F.col("size"), F.col("head.size")
    apart = (F.col("head.rep") != F.col("rep")) & (F.least(*sizes) >= similarity * F.greatest(*sizes))
    pairs = written(proposed.filter(apart).select("head", "rep", "folded"), "pairs")
    discard(near)
    asked = members.select(F.col("rep").alias("doc")).union(pairs.select("rep")).union(pairs.select("head.rep")).distinct()
    sets = written(shingle_sets(rows.join(asked, "doc", "left_semi"), "doc", "text", shingle).dropDuplicates(["rep", "folded"]), "sets")
    stars = written(connected_components(star_links(pairs, sets, similarity)), "stars")
    cells = written(cells_of(members, stars, shard_rows), "cells")
    discard(members)
    more = cell_links(cells.join(sets, ["rep", "folded"]), similarity)
    found = connected_components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    discard(pairs, sets, stars, cells)
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("folded", F.coalesce("component", "rep").alias("component"))
    out = prints.join(named, "folded", "left")
    return out.select(F.col("doc").alias(id_col), F.when(F.col("doc").isNotNull(), F.col("component")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of docs, whole, that name their component: of rows that share that id all, and every row without an id."""
    found = similar_components(docs, id_col, text_col, shingle)
    name = unused(docs, "_gone")
    gone = found.filter(F.col(id_col) != F.col("component")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
