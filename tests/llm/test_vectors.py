import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verselake.llm import fuzzy_hash, vector_codes, whitening
from verselake.operators.edits import distance

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, width, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, width).astype(np.float32).tolist(), int(rng.integers(0, 4)) if i % 5 else None) for i in range(n)]
    return rows + rows[:copies]


#: Nulls in any column, empty vectors, other widths, components that aren't finite or very large, repeated rows.
ODD = [(900, None, 1), (901, [], 1), (902, [NAN] + [0.1] * 7, 1), (903, [INF] + [0.1] * 7, None), (904, [None] + [0.1] * 7, 2), (905, [0.5] * 5, 2)]
NO_ID = (None, [0.25] * 8, 1)


def odd_table(spark, rows):
    clash = {n: F.lit("clash") for n in ("_id", "_v", "w", "count", "part", "entry", "n", "sums", "code", "error", "_label", "_l", "_n", "component", "i", "j", "s", "whitened")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


def brute_codes(rows, parts, entries, rounds):
    """Loops over whole numbers, no arrays."""
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and len(v) == len(rows[0][1]) and all(x is not None and math.isfinite(x) for x in v)]
    width = len(good[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seen, starts = set(), []
    for i, v, _ in sorted(good, key=lambda r: (r[0] is None, r[0], r[1])):
        if i not in seen:
            seen.add(i)
            starts.append(v)
    books = [[cut(v, p) for v in starts[:entries]] for p in range(parts)]

    def near(v, p):
        apart = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
        return apart.index(min(apart)), min(apart)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups: dict = {}
            for _, v, _ in good:
                groups.setdefault(near(v, p)[0], []).append(cut(v, p))
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    out, sums = [], {}
    for i, v, label in good:
        found = [near(v, p) for p in range(parts)]
        error = sum(d for _, d in found)
        out.append((i, "".join(f"{k:02x}" for k, _ in found), error, label))
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((str(i), c, e, sums[label], digest) for i, c, e, label in out))


def test_codes_equal_brute_force(spark):
    for rows, entries in ((vectors(300, 8, copies=7), 16), (vectors(5, 8), 16), (vectors(60, 8) + [(i, [0.5] * 8, 3) for i in range(60, 160)], 8)):
        rows = rows + ODD + [NO_ID]
        got = vector_codes.compress(odd_table(spark, rows), parts=4, entries=entries).collect()
        assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows, 4, entries, 2)


def test_codes_of_extreme_tables(spark):
    for rows in ([], ODD[:5]):
        got = vector_codes.compress(odd_table(spark, rows))
        assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    huge = [(1, [1e30, -1e30, 0.0, 0.0], 1), (2, [0.0] * 4, 1), (2, [0.0] * 4, 1)]
    got = {r.vec_id: (r.code, r.error) for r in vector_codes.compress(odd_table(spark, huge), parts=4).collect()}
    assert got == {1: ("00000000", 0), 2: ("01010000", 0)}
    alone = vector_codes.compress(odd_table(spark, [(None, [1.0] * 4, None)] * 3), parts=2)
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in alone.collect()] == [(None, "0000", 0, 0)] * 3
    with pytest.raises(ValueError):
        vector_codes.compress(odd_table(spark, [(1, [1.0] * 5, None)]), parts=2)


def test_rare_and_common_labels_and_decoding(spark):
    rows = spark.range(4000).selectExpr("id as _id", "if(id % 2 = 0, null, if(id % 4 = 1, 7, id)) as _label", "id as error")
    got = vector_codes.with_label_sums(rows, "_label", "error", "total").collect()
    want: dict = {}
    for r in got:
        want[r["_label"]] = want.get(r["_label"], 0) + r["error"]
    assert len(got) == 4000 and all(r.total == want[r["_label"]] for r in got)
    table = odd_table(spark, vectors(40, 8))
    base = vector_codes.finite(table, "vec_id", "embedding", F.col("label").alias("_label"))
    books = vector_codes.trained(base, 4, 64, 1)
    back = vector_codes.decode(vector_codes.encode(base, books), books).collect()
    assert all(np.abs(np.array(r.vector) - np.array(dict((i, v) for i, v, _ in vectors(40, 8))[r["_id"]])).max() <= 1 / 256 for r in back)


def brute_whitening(rows, components):
    good = [(i, [math.floor(64 * float(x)) + 1_000_000 for x in v]) for i, v, _ in rows if v and len(v) == len(rows[0][1]) and all(x is not None and math.isfinite(x) for x in v)]
    n, width = len(good), len(good[0][1])
    sums = [sum(v[d] for _, v in good) for d in range(width)]
    centred = [[Fraction(n * x - s, n) for x, s in zip(v, sums)] for _, v in good]
    cov = np.array([[float(sum(c[a] * c[b] for c in centred) / n) for b in range(width)] for a in range(width)])
    values, vec = np.linalg.eigh(cov)
    order = np.argsort(-values)
    deviations = [sum((n * x - s) ** 2 for x, s in zip(v, sums)) for _, v in good]
    z = np.array([[float(x) for x in c] for c in centred]) @ vec[:, order]
    return good, n, deviations, values[order], z / np.sqrt(np.maximum(values[order], 1e-300)), values.sum()


def test_whitening_equals_brute_force(spark):
    rows = vectors(120, 8, 3, copies=5) + ODD + [NO_ID]
    rows = [(i, None if v is None else [None if x is None else x * (1 + 40 * (k == 2)) for k, x in enumerate(v)], label) for i, v, label in rows]
    good, n, deviations, values, z, trace = brute_whitening(rows, 5)
    got = whitening.whiten(odd_table(spark, rows), components=5).collect()
    assert len(got) == len(good) * 5 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    key = lambda i, d: (str(i), d)
    want = sorted((key(i, d), k) for k, ((i, _), d) in enumerate(zip(good, deviations)))
    for c in range(1, 6):
        mine = sorted((key(r.vec_id, r.deviation), r.whitened, r.explained) for r in got if r.component == c)
        assert [k for k, _ in want] == [k for k, _, _ in mine]
        a, b = np.array([x for _, x, _ in mine]), z[[k for _, k in want], c - 1]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert abs(mine[0][2] / (values[c - 1] / trace) - 1) < 1e-9


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    want = np.sort(rng.uniform(1, 9, 24))[::-1]
    values, vec = whitening.jacobi((q * want) @ q.T)
    assert np.abs(values / want - 1).max() < 1e-13 and np.abs(vec.T @ vec - np.eye(24)).max() < 1e-13
    scale = 10.0 ** -np.arange(0, 12, 0.5)
    graded = scale[:, None] * ((q * want) @ q.T) * scale[None, :]
    values, vec = whitening.jacobi(graded)
    # The product of all eigenvalues is known, the least of which is about 1e-23 of the first.
    assert abs(np.log(values).sum() - np.log(want).sum() - 2 * np.log(scale).sum()) < 1e-9
    values, vec = whitening.jacobi(np.zeros((3, 3)))
    assert values.tolist() == [0, 0, 0] and np.array_equal(vec, np.eye(3))


def test_whitening_of_extreme_tables(spark):
    for rows in ([], ODD[:5]):
        assert whitening.whiten(odd_table(spark, rows)).count() == 0
    same = whitening.whiten(odd_table(spark, [(1, [0.5] * 4, 1)] * 3)).collect()
    assert len(same) == 12 and {(r.whitened, r.deviation, r.explained, r.identity_error) for r in same} == {(0.0, 0, 0.0, 0.0)}
    few = whitening.whiten(odd_table(spark, vectors(4, 8, 2))).collect()
    assert len(few) == 32 and {r.component for r in few if r.whitened} == {1, 2, 3} and few[0].identity_error < 1e-9
    huge = whitening.whiten(odd_table(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 0.5], 1), (3, [0.0, 0.25], 1)])).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and huge[0].identity_error < 1e-6
    y = np.array([[1 << 30, -3], [1 << 30, 5]])
    assert whitening.exact_products(y).tolist() == [[1 << 61, 1 << 31], [1 << 31, 34]]
    assert whitening.exact_products(y * 4)[0, 0] == 1 << 65


TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog " * 9, "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "é好😀" * 40 + "tail", "en"),
    (5, "same text here " * 12, "fr"),
    (5, "same text here " * 12, "fr"),
    (5, "other text of one id", "fr"),
    (None, "no id at all", None),
    (7, "z" * 50_000 + " é " + "word " * 20_000, "de"),
    (9, "abc", "de"),
]


def brute_print(text):
    """The module's rule by a loop over bytes."""
    data, mask = text.encode(), (1 << 64) - 1
    level = []
    for i in range(len(data)):
        h = 0
        for b in (bytes(6) + data)[i : i + 7]:
            h = (h * int(fuzzy_hash.ROLL) + b) & mask
        h ^= h >> 32
        h = h * int(fuzzy_hash.MIX) & mask
        h ^= h >> 29
        level.append(len(f"{h:064b}") - len(f"{h:064b}".rstrip("1")))
    at_least = lambda k: sum(x >= k for x in level)
    size = max([1] + [k for k in range(1, 66) if at_least(k) >= 32])
    size += at_least(size) > 1024

    def chunks(k):
        out, begin = [], 0
        for i, x in enumerate(level):
            if x >= k:
                out.append(data[begin : i + 1])
                begin = i + 1
        return out + ([data[begin:]] if data[begin:] else [])

    import zlib

    letters = lambda c: fuzzy_hash.LETTERS[zlib.crc32(c) % 64] + fuzzy_hash.LETTERS[zlib.crc32(c) // 64 % 64]
    return ":".join([str(size), *("".join(map(letters, chunks(k))) for k in (size, size + 1))])


def test_fingerprints_equal_brute_force(spark):
    for t in [t or "" for _, t, _ in TEXTS[:7]]:
        assert fuzzy_hash.fingerprint(t) == brute_print(t)
    long = TEXTS[8][1]
    whole = fuzzy_hash.levels(long.encode())
    slab, fuzzy_hash.SLAB = fuzzy_hash.SLAB, 1000
    try:
        assert np.array_equal(fuzzy_hash.levels(long.encode()), whole)
    finally:
        fuzzy_hash.SLAB = slab
    rng = np.random.default_rng(1)
    words = [f"w{int(i)}" for i in rng.integers(0, 500, 900)]
    text, other = " ".join(words), " ".join(f"w{int(i)}" for i in rng.integers(0, 500, 900))
    near = " ".join(words[:300] + ["new"] + words[300:])
    a, b, c = map(fuzzy_hash.fingerprint, (text, near, other))
    assert fuzzy_hash.likeness(a, b) > 0.9 and fuzzy_hash.likeness(a, c) < 0.15 and fuzzy_hash.likeness(a, a) == 1
    assert fuzzy_hash.likeness("1::", "1::") == 1 and fuzzy_hash.likeness("1::", "1:AA:AA") == 0 and fuzzy_hash.likeness(None, a) is None
    assert fuzzy_hash.likeness("2:AABB:AA", "3:AACC:AA") == 0.5 and fuzzy_hash.likeness("2:AABB:AA", "9:AABB:AA") == 0
    assert distance(a, c) > 20
    df = spark.createDataFrame([(text, near), (None, text)], "x string, y string")
    one, two = (fuzzy_hash.fingerprint_column(F.col(c)) for c in "xy")
    assert [round(r[0], 9) for r in df.select(fuzzy_hash.likeness_column(one, two)).collect()] == [round(fuzzy_hash.likeness(a, b), 9), 0.0]


def test_neighbours(spark):
    clash = {n: F.lit("clash") for n in ("_id", "_t", "_h", "_m", "_part", "_edge", "n_chars", "fingerprint", "_next")}
    rows = TEXTS + [(100 + i, f"text number {i} " * (i % 7), None) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(clash).repartition(7)
    got = fuzzy_hash.with_neighbours(table).collect()
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").select("t", F.xxhash64("t").alias("h")).distinct().collect()}
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(t) // 4
        changed = t[: len(t) - q] + following[:q]
        prints = [fuzzy_hash.fingerprint(x) for x in (t, changed, following)]
        want.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1], fuzzy_hash.likeness(prints[0], prints[1]), fuzzy_hash.likeness(prints[0], prints[2])))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    single = fuzzy_hash.with_neighbours(spark.createDataFrame(TEXTS[:1], "doc_id long, text string, lang string")).collect()
    assert [(r.near_next, r.n_chars) for r in single] == [(1.0, 396)]
    assert fuzzy_hash.with_neighbours(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


DATA = "/root/testdata/sf0.001"


def test_queries_on_the_small_tables(spark):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    from verselake.llm import queries

    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert queries.op11_vector_codes(spark, DATA).count() == n and queries.op12_whitening(spark, DATA).count() == 32 * n
    found = queries.op13_fingerprints(spark, DATA).agg(F.avg("near_edited"), F.avg("near_next"), F.count("*")).first()
    assert found[0] > 0.6 and found[1] < 0.2 and found[2] == spark.read.parquet(f"{DATA}/documents.parquet").count()
