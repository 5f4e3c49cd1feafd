import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from verselake.llm import bpe, decontaminate, html_text, labelled, quality_cnn, quality_rules, sharding, simhash, token_files, toxicity, urls  # noqa: E402
from verselake.llm import components  # noqa: E402
from verselake.llm.components import connected_components  # noqa: E402

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
#: Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash with ours.
ODD = [
    (1, "Hello world, it's a test's ''s  x\n\n y", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "same text here " * 12, "en"),
    (5, "same text here " * 12, "fr"),
    (5, "same text here " * 12, "fr"),
    (None, "no id at all", None),
    (6, "z" * 5000 + " 好 é 😀 \t" + "word " * 4000, "de"),
    (7, " \t\n ", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="session")
def odd(spark):
    clash = {n: F.lit("clash") for n in ("_id", "_text", "ids", "fp", "n", "k", "rep", "u", "v", "score", "component", "doc", "words", "pool", "size", "b", "_row", "_kept", "_gone", "_held", "s0", "least", "folded", "bands", "label", "slice")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(clash)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_tiktoken(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = np.random.default_rng(1)
    alphabet = [*"abstrevldm'' \t\n0129.!", "é", "\u3000", "\u00a0", "好", "\x1c", "'s", "'ll", "😀"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)] + [t or "" for _, t, _ in ODD] + ["a" * 2000]
    for text, (ids, offsets) in zip(texts, bpe.encode_texts(texts, RANKS)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert bpe.decode_ids(ids, offsets, RANKS) == text.encode()
        n = len(ids) // 8 * 4
        assert bpe.decode_ids(ids[:n], offsets[:n], RANKS) + bpe.decode_ids(ids[n:], offsets[n:], RANKS) == text.encode()
    rows = bpe.digests(odd, RANKS).collect()
    apart = {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(odd, RANKS), RANKS).collect()}
    assert apart == {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.round_trip(odd, RANKS).collect()}
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in rows) == want
    assert bpe.digests(empty(spark), RANKS).count() == 0


def test_scan_is_the_automaton():
    rng = np.random.default_rng(0)
    f = bpe._SYMBOLS[rng.integers(0, 12, 10_000)]
    state, want = 0, []
    for x in f.tolist():
        state = (x >> (2 * state)) & 3
        want.append(state)
    assert bpe.scan_states(f).tolist() == want


def brute_components(fps, radius):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= radius) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_simhash_components(spark, odd):
    rng = np.random.default_rng(3)
    fps = []
    for centre in rng.integers(0, 1 << 62, 6):
        for _ in range(25):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.append(x)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    for crowd in (2048, 5):
        got = {r.doc_id: r.component for r in simhash.components_of(prints, "doc_id", 2, crowd).collect()}
        assert [got[i] for i in range(len(fps))] == brute_components(fps, 2)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component for r in rows if r.doc_id in (2, 3, 7)} == {2}
    assert {r.fp for r in rows if r.doc_id in (2, 3, 7)} == {0} and [r.component for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(empty(spark)).count() == 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    assert simhash.majority(simhash.shingle_hashes("A  b\tC d", 3)) == h[0] & h[1]


def test_components_of_hubs(spark):
    """Hubs, chains, loops, repeated and reversed edges."""
    rng = np.random.default_rng(9)
    edges = [(500, int(i)) for i in range(1000, 1400)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7), (9, 8), (8, 9), (8, 9)]
    edges += [(int(a), int(b)) for a, b in rng.integers(3000, 3200, (120, 2))]
    want = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got.items() <= want.items() and all(want[n] == n for n in want.keys() - got.keys())


def test_words_are_learned_without_offsets():
    """The call that keeps offsets of characters isn't made, and the ids are the library's."""
    class Fast:
        def __init__(self, whole):
            self.encode_batch_fast = whole.encode_batch_fast

    texts = ["The cats, the CATS; Été été. a. . ### <s>x. don't", "ab\x1ccd\x85ef\u3000gh 好. É! ǅ. İs, 555-7800", "", "<UNK> </s>. Z"]
    cache = token_files.Words(WORDS, "<u2")
    whole, cache.tokenizer = cache.tokenizer, Fast(cache.tokenizer)
    split = [*map(token_files._split, texts)]
    cache.learn({w for s in split for w in s})
    got = [np.frombuffer(b"".join(map(cache.__getitem__, s)), "<u2").tolist() for s in split]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_words_are_learned_once(monkeypatch, tmp_path):
    """Latin words are cut without the library, which gets each piece once; a full cache keeps its words as the older generation."""
    cache, asked = token_files.Words(WORDS, "<u2"), []

    class Model:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split(" "))
            return self.model.encode_batch_fast(texts, **options)

    whole, cache.tokenizer, cache.pieces = cache.tokenizer, None, Model(cache.pieces)
    latin = [c for c in map(chr, range(0x21, 0x300)) if c.isprintable() and max(c.lower()) < "\u0300"]
    some = [w for c in latin for w in (c, f"Ab{c}c", c * 3, f"9{c}'S.", f"'{c}", f"{c}'Re")]
    cache.learn(dict.fromkeys(some))
    for w, e in zip(some, whole.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(cache[w], "<u2").tolist() == e.ids, w
    assert len(asked) == len(set(asked)) and "ab" in asked and "..." in asked and not {"ab$c", "Ab"} & {*asked}
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 2 * len(cache))
    asked.clear()
    cache.learn(["qzq"])
    assert len(cache) == 1
    cache.learn([*some[:9], "ABxyC..."])
    assert asked == ["qzq", "abxyc"] and all(w in cache for w in some[:9])
    # A vocabulary that cuts in another way is left to the library alone.
    whole = pytest.importorskip("tokenizers").Tokenizer.from_file(WORDS)
    whole.normalizer = None
    whole.save(f"{tmp_path}/cased.json")
    cased = token_files.Words(f"{tmp_path}/cased.json", "<u2")
    cased.learn(some)
    for w, e in zip(some, whole.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(cased[w], "<u2").tolist() == e.ids, w


def test_plans_of_components_stay_small(spark, monkeypatch):
    """No step of a round holds the plan of another one, and stars take no round."""
    leaves, put = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: (leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size()), put(df, label))[1])
    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    assert {r.component for r in connected_components(path).collect()} == {0} and max(leaves) <= 4
    leaves.clear()
    stars = spark.createDataFrame([(9, 1), (1, 8), (7, 2), (7, 2)], "u long, v long")
    assert {r.node: r.component for r in connected_components(stars).collect()} == {9: 1, 8: 1, 1: 1, 7: 2, 2: 2} and len(leaves) == 1


def test_plans_of_similar_components_stay_small(spark, monkeypatch):
    leaves, put = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, label: (leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size()), put(df, label))[1])
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "q r s t u v")], "doc_id long, text string")
    assert {r.doc_id: r.component for r in simhash.similar_components(rows, "doc_id", "text").collect()} == {1: 1, 2: 1, 3: 3} and max(leaves) <= 10


def test_similar_components(spark, odd):
    words = [f"w{i}" for i in range(200)]
    near = words[:100] + ["changed"] + words[101:]
    far = [w if i % 4 else f"{w}x" for i, w in enumerate(words)]
    rows = [(3, " ".join(words)), (9, " ".join(near)), (5, " ".join(far)), (8, " ".join(words)), (1, "w0 w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (2048, 0):
        assert {r.doc_id: r.component for r in simhash.similar_components(df, "doc_id", "text", shard_rows=crowd).collect()} == {3: 3, 9: 3, 8: 3, 5: 5, 1: 1}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3, 5]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 4, 6, None}
    assert simhash.keep_one(empty(spark)).count() == 0


def brute_similar(rows, shingle=5):
    sets = {i: set(simhash.shingle_hashes(t, shingle).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return label


def test_star_of_edited_copies(spark):
    """Variants that are near the base alone: Hamming order isn't Jaccard order."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(161, " ".join(base))]
    for k in range(60):
        words = list(base)
        for p in rng.choice(300, 5, replace=False):
            words[p] = f"v{k}x{p}"
        rows.append((100 + 2 * k, " ".join(words)))
    want = brute_similar(rows)
    assert len(set(want.values())) < 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component for r in simhash.similar_components(df, "doc_id", "text").collect()} == want


def test_families_of_edited_copies(spark):
    """Families of 40 with up to 6 of 150 words changed: components equal brute force, though every shard is crowded."""
    rng, rows = np.random.default_rng(15), []
    for family in range(5):
        base = [f"f{family}w{i}" for i in range(150)]
        for k in range(40):
            words = list(base)
            for p in rng.choice(150, int(rng.integers(1, 7)), replace=False):
                words[p] = f"v{family}x{k}x{p}"
            rows.append((int(family * 40 + k), " ".join(words)))
    rows += [(1000, ""), (1001, "one"), (1002, "ONE"), (1003, None), (1004, "one two three four five"), (1005, "one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_similar([(i, t) for i, t in rows if t])
    want |= {1000: 1000, 1003: 1000}
    assert {r.doc_id: r.component for r in simhash.similar_components(df, "doc_id", "text", shard_rows=7).collect()} == want


def test_crowded_shard_loses_no_pair(spark):
    """Classes that share one band value alone still meet, however crowded it is, unless a link connects them already."""
    rows = [(i, bytes([i]), 3, [7] + [100 * i + k for k in range(1, simhash.BANDS)]) for i in range(1, 30)]
    classes = spark.createDataFrame(rows, "rep long, folded binary, size long, bands array<long>")
    members = simhash.band_members(classes)
    assert {(r.head.rep, r.rep) for r in members.collect()} == {(1, i) for i in range(1, 30)}
    for joined in (0, 1, 20):
        found = spark.createDataFrame([(i, 1) for i in range(1, joined + 1)], "node long, component long")
        for crowd in (2048, 4):
            held = {}
            for r in simhash.cells_of(members, found, crowd).collect():
                held.setdefault((r.s0, r.s1, r.s2, r.s3), set()).add(r.rep)
            assert all(any({a, b} <= c for c in held.values()) for a in range(1, 30) for b in range(1, a) if a > joined)
            assert max(map(len, held.values())) <= (29 if crowd > 29 else 24)
    assert simhash.cells_of(members, spark.createDataFrame([(i, 1) for i in range(1, 30)], "node long, component long"), 4).count() == 0


def test_decontaminate(spark, odd):
    item = " ".join(f"i{k}" for k in range(50))
    edited = item.replace("i25", "other")
    half = " ".join(item.split()[:20])
    filler = " ".join(f"f{k}" for k in range(300))
    docs = [(1, f"{filler} {item.upper()} {filler}"), (2, f"{filler}, {edited}. {filler}"), (3, f"{filler} {half} {filler}"), (4, filler), (5, None), (6, "tiny item"), (7, ""), (None, item)]
    bench = spark.createDataFrame([(1, item), (2, "Tiny, item!"), (3, ""), (4, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id) for r in decontaminate.find(df, bench).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, 2), 7: (False, None), None: (True, 1)}
    assert sorted(r.doc_id for r in decontaminate.keep(df, bench).collect()) == [3, 4, 5, 7]
    assert decontaminate.find(df, bench.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.find(odd, bench).count() == len(ODD) and decontaminate.find(empty(spark), bench).count() == 0
    plan = decontaminate.find(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_windows(doc, item, k=5, limit=0.8):
    """Best similarity of any item-sized window, those cut by the end of the text included."""
    grams = lambda words: [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    have, want = grams(doc.split()), Counter(grams(item.split()))
    m, best = sum(want.values()), 0.0
    for s in range(len(have)):
        part = Counter(have[s : s + m])
        shared = sum((part & want).values())
        best = max(best, shared / (sum(part.values()) + m - shared))
    return best


def test_decontaminate_reordered_items(spark):
    """Swapped halves, sentences in another order, and items cut by the text's ends."""
    words = [f"i{k}" for k in range(59)]
    item, filler = " ".join(words), " ".join(f"f{k}" for k in range(80))
    texts = [" ".join([filler, *words[29:], *words[:29], filler]), " ".join([filler, *words[50:], *words[:50], filler]), " ".join([filler, *words[40:], *words[20:40], *words[:20], filler])]
    texts += [" ".join([filler, *words[:-6]]), " ".join([*words[6:], filler]), " ".join(words[25:53] + words[:25]), " ".join([*words[:30], filler, *words[30:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = [brute_windows(t, item) for t in texts]
    assert want[0] >= 0.8 > want[2] and min(want) < 0.8
    got = {r.doc_id: r.similarity for r in decontaminate.find(df, bench).collect()}
    assert [got[i] for i in range(len(texts))] == [pytest.approx(w) if w >= 0.8 else None for w in want]


def test_urls(spark):
    rows = [
        (1, "https://A.example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://b.net", "b.net", "", None, "allow"),
        (3, "http://b.net/", "b.net", "/", "net/", "block"),
        (4, "http://example.com/de/1#top", "example.com", "/de/1", "example.com/de/", "block"),
        (5, "http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme/casino", "", "", None, "allow"),
        (8, "x://casinos.com/a", "casinos.com", "/a", None, "allow"),
        (9, "x://my-casino.com/a", "my-casino.com", "/a", None, "block"),
        (10, "x://free.com/FREE/free", "free.com", "/FREE/free", None, "allow"),
        (11, "x://free.com/Bets", "free.com", "/Bets", None, "block"),
        (12, "x://h?a=casino", "h", "", None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumns({"host": F.lit(1), "_url": F.lit("z")})
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).orderBy("page_id").collect()]
    assert got == [(r[0], *r[2:]) for r in rows]


def brute_counts(text):
    words = quality_words(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    held = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if quality_words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


def quality_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_quality_rules(spark, odd):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([*"abc", "#x", "\n", "é😀", "\x1c", "a\n"], rng.integers(0, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(df).collect():
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    assert quality_rules.judge(odd).count() == len(ODD) and quality_rules.judge(empty(spark)).count() == 0
    good = "The cat sat on the mat and looked at the birds that were in the garden of my neighbour for a while."
    more = spark.createDataFrame([(1, good), (2, "%%% ".join(good.split())), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in quality_rules.keep(more).collect()] == [1]
    plan = quality_rules.keep(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and quality_rules.keep(odd).columns == odd.columns


PAGE = """<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=1>One</a></li></ul></nav><div class="cookie-notice">We use cookies, please agree to all of them now.</div>
<article><h1>Head</h1><p><b>First&nbsp;&amp; long paragraph of the text<br>goes on and on here.<p>Short.<div class="ad">Buy now, this is a long advert text, really.</div>
<form><input><button>Send</button></form><ul><li>item one</li></ul></article><aside>Related text that is long enough to be seen as content</aside>
<section id="comments"><p>A reader comment that is quite long and has no tags at all in it.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head\n\nFirst & long paragraph of the text goes on and on here.\n\nShort.\n\nitem one"
    assert html_text.main_text("") == html_text.main_text(None) == "" and html_text.main_text("<p>a<p>b &lt;") == "a\n\nb <"
    div = "<div class=nav><a>x</a><a>y</a></div><div><div><p>" + "long text " * 30 + "</p><p>Tail.</p></div></div>"
    assert html_text.main_text(div).endswith("Tail.") and "x" not in html_text.main_text(div).replace("text", "")
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "<p")], "page_id long, url string, html string").withColumn("text", F.lit(0))
    assert sorted(r.n_chars for r in html_text.extract(df).collect())[:3] == [0, 0, 2] and html_text.extract(df.filter("false")).count() == 0


def test_html_region_is_the_whole_article():
    """A heading and an introduction beside the block that holds over nine tenths of the text."""
    body = "".join(f"<p>{'long text of the article ' * 20}{i}</p>" for i in range(12))
    for tag in ("div", "section", "blockquote", "ul", "table"):
        inner = {"ul": f"<ul><li>{body}</li></ul>", "table": f"<table><tr><td>{body}</td></tr></table>"}.get(tag, f"<{tag}>{body}</{tag}>")
        for outer in ("article", "div", "body"):
            page = f"<body><{outer}><h1>Head</h1><p>An introduction of a few words, by someone.</p>{inner}<p>End note.</p></{outer}></body>"
            got = html_text.main_text(page).split("\n\n")
            assert got[:2] == ["Head", "An introduction of a few words, by someone."] and got[-1] == "End note." and len(got) == 15


def test_html_link_lines():
    """Lines of links beside the text go; links in the text, headings that are links, and lists in an article stay."""
    one, two = "A long first paragraph of the page. " * 6, "A long second paragraph of it, with <a href=x>a link</a> inside. " * 6
    plain = two.replace("<a href=x>", "").replace("</a>", "").strip()
    menu = "<div><a href=1>Imprint</a> <a href=2>Jobs</a></div><ul><li><a href=3>Terms</a><li><a href=4>Help</a></ul>"
    body = f"<h2><a href=5>Head</a></h2><p>{one}</p><p>{two}</p>"
    assert html_text.main_text(f"<body><div>{menu}{body}{menu}</div></body>") == f"Head\n\n{one.strip()}\n\n{plain}"
    listed = html_text.main_text(f"<article>{body}<ul><li><a href=6>Source</a></ul></article>")
    assert listed == f"Head\n\n{one.strip()}\n\n{plain}\n\nSource"
    open_link = html_text.main_text(f"<body><a href=1><p>{one}</p><p>{one}</p></body>")
    assert open_link == f"{one.strip()}\n\n{one.strip()}"


def plain_article(html):
    """A second, plainer reading of well-formed pages: what stands in the article's blocks, tags and markup dropped."""
    import html as entities
    import re

    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    inner = re.sub(r"(?s)<(aside|nav|form|footer|script|style|header|figure-ad)\b.*?</\1>", " ", inner)
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|blockquote|div|table|tr|td)\b[^>]*>", inner)
    texts = [" ".join(entities.unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"(?s)<!--.*?-->|<(?!br)[^>]*>", "", p))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_html_equals_plain_reading():
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice([*"aeioulmnrst"], int(rng.integers(2, 9))))
    text = lambda n: " ".join(word() for _ in range(n))
    marks = ("&amp;", "&nbsp;", "&eacute;", "&#8212;", "<b>bold</b>", "<i>a</i>", "<br>", "<a href='x'>link</a>", "<!-- note -->", "\n\t ")
    for _ in range(60):
        blocks = []
        for _ in range(int(rng.integers(3, 12))):
            kind = str(rng.choice(["p", "p", "p", "h2", "blockquote", "ul"]))
            inside = f"{text(int(rng.integers(1, 60)))} {rng.choice(marks)} {text(int(rng.integers(5, 40)))}"
            blocks.append(f"<ul><li>{inside}</li><li>{text(3)}</li></ul>" if kind == "ul" else f"<{kind}>{inside}</{kind}>")
        article = "".join(blocks) + str(rng.choice(["", f"<aside>{text(30)}</aside>", f"<form><input><p>{text(4)}</p></form>"]))
        menu = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(8))
        page = f"<html><head><title>{text(4)}</title></head><body><header><h1>{text(2)}</h1></header><nav><ul>{menu}</ul></nav><div class='ad'>{text(25)}</div><article>{article}</article><aside>{text(40)}</aside><div id='comments'><p>{text(50)}</p></div><footer>&copy; {text(6)}</footer></body></html>"
        assert html_text.main_text(page) == plain_article(page)
    assert len(html_text.main_text("<p>" + "long text " * 300_000)) == 3_000_000 - 1


def test_html_skipped_elements_end():
    """Skipped elements without an end tag, and a form around the page, don't take the article."""
    one, two = "A long first paragraph of the article. " * 5, "A long second paragraph of it. " * 5
    want = f"{one.strip()}\n\n{two.strip()}"
    rest = f"<p>{one}</p><p>{two}</p>"
    for page in (
        f'<div><p class="ad">Buy <b>now{rest}</div>',
        f'<div><p class="ad">Buy now<div>{rest}</div></div>',
        f'<ul><li class="share">Share it<li class="share">Mail it</ul>{rest}',
        f'<div><ul><li class="share"><div>Share it</ul>{rest}</div>',
        f'<ul><li>{one}<p class="ad">Buy now<li>{two}</ul>',
        f'<ul><li class="share">Share<ul><li>a<li>b</ul><li>{one}<li>{two}</ul>',
        f'<div><div class="ad">Buy now</p></b></section></div>{rest}</div>',
        f'<div><section><div class="ad">Buy now</section>{rest}</div>',
        f"<html><head><title>T</title><body>{rest}</body></html>",
        f'<body><form id="form1" role="form"><div>{rest}</div><input></form></body>',
        f"<body><form><article>{rest}</article><div class=nav>x</div></form></body>",
        f"<body>{rest}<form><p>Your name here</p></form></body>",
    ):
        assert html_text.main_text(page) == want, page


def test_html_containers_are_judged_by_what_they_hold():
    """Shapes of saved pages: wrappers named after what else they hold, comments that call themselves content or articles."""
    one, two = "A long first paragraph of the article. " * 5, "A long second paragraph of it. " * 5
    want, body = f"{one.strip()}\n\n{two.strip()}", f"<p>{one}</p><p>{two}</p>"
    side = "<div class='sidebar'><p>Some other words of a side bar that go on for a while here.</p></div>"
    com = "<p>A reader says a lot of things about this, really a lot of things.</p>" * 3
    second = "<p>A long second"
    for page in (
        f'<div class="has-sidebar"><article>{body}</article>{side}</div>',
        f'<div class="layout sidebar left"><article>{body}</article></div>',
        f'<div class="share"><main>{body}</main></div>',
        f'<div class="widget"><div class="article">{body}</div></div>',
        f'<body class="comments-open has-nav"><div class="content with-sidebar">{body}</div>{side}</body>',
        f'<div class="has-sidebar"><div>{body}</div>{side}</div>',
        f'<article>{body}</article><div class="comment content">{com}</div>',
        f'<article>{body}</article><div class="replies">{com}</div>',
        f'<article>{body}</article><section id="comments"><article>{com}</article><article>{com}</article></section>',
        f'<div><article>{body}</article><ol class="commentlist"><li><article class="comment">{com * 4}</article></li></ol></div>',
        f'<div class="post-comments-on"><article class="post has-comments">{body}<div id="disqus_thread">{com}</div></article></div>',
        f'<div class=content>{body}</div><div class="comments">{com * 5}</div>',
        f'<body><div><a href=1>Imprint</a> <a href=2>Jobs</a></div><article>{body}</article><div class="comment content">{com}</div></body>',
        f'<article>{body.replace(second, "<div class=ad><p>Buy it now.</p></div>" + second)}<div class="share"><a href=1>Tweet</a></div></article>',
        f'<main><article>{body}</article><div class="related"><p>Other story with a text of its own here</p></div></main>',
    ):
        assert html_text.main_text(page) == want, page
    inside = f'<article><p>{one}</p><section class="related-work"><p>{two}</p></section><p class="social">Social matters.</p><p><label>Name</label> <math><mi>x</mi></math></p></article>'
    assert html_text.main_text(inside) == f"{want}\n\nSocial matters.\n\nName x"
    assert html_text.main_text(f"<div class=comments>{com}</div>").count("A reader") == 3
    long = f'<div class="has-sidebar">{side}<article>' + body * 5000 + "</article></div>"
    assert html_text.main_text(long) == "\n\n".join([want] * 5000)


def test_token_files(spark, odd, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(WORDS)
    manifest = token_files.write_files(odd, WORDS, 2, seq_len=64, folder=f"file://{tmp_path}/f")
    rows = token_files.read_files(manifest).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    at, docs = 0, sorted(((-1 if i is None else i, t or "") for i, t, _ in ODD))
    for r, (_, text) in zip(rows, docs, strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    for m in manifest.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect():
        reader = token_files.Reader(m.file)
        tail, mask = reader.sequence(-(-m.n // 64) - 1)
        assert len(tail) == 64 and mask.sum() == (m.n - 1) % 64 + 1 and len(reader.sequence(0)[0]) == 64
    assert token_files.read_files(token_files.write_files(empty(spark), WORDS, 2)).count() == 0


def test_words_equal_library():
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(WORDS)
    rng = np.random.default_rng(4)
    alphabet = [*"abXYé .,'-!09\n\t", "İ", "ß", "\u00a0", "\u0301", "好", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "'s", "'LL", "\x1c"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(2000)]
    for text, ids in zip(texts, token_files.tokenised(texts, WORDS, "<u2")):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_sharding(spark, odd):
    rng = np.random.default_rng(6)
    texts = [f"t{k} " * int(rng.integers(1, 60)) for k in range(900)] + ["hot text"] * 450 + ["warm text " * 9] * 60 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", F.lit("clash"))
    rows = sharding.assign(df).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes = np.zeros(8)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        sizes[r.shard] += r["size"]
    assert sizes.max() - sizes.min() <= 0.02 * sizes.mean()
    placed = {}
    for r in rows:
        placed.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    # A third of the rows in one group is no reason to cut it.
    assert {len(v) for v in placed.values()} == {1}
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign(odd).count() == len(ODD) and sharding.assign(empty(spark)).count() == 0


def test_pack_is_the_rule():
    """Brute force: each item in turn, largest first, to the fitting shard of the highest dot product."""
    rng = np.random.default_rng(12)
    vectors = rng.gamma(0.7, 1.0, (200, 3)) * [100, 20, 1]
    share = vectors / vectors.sum(axis=0)
    room = [[1 / 5] * 3 for _ in range(5)]
    want = [0] * 200
    for i in sorted(range(200), key=lambda i: (-max(share[i]), i)):
        fits = [s for s in range(5) if room[s][0] >= share[i][0]]
        dot = {s: sum(a * b for a, b in zip(room[s], share[i])) for s in fits}
        want[i] = max(fits, key=lambda s: (dot[s], -s)) if fits else max(range(5), key=lambda s: (room[s][0], -s))
        room[want[i]] = [a - b for a, b in zip(room[want[i]], share[i])]
    assert sharding.pack(vectors, 5).tolist() == want


def labelled_rows(n=240):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice([*"aeioustrnl"], rng.integers(2, 7))) for _ in range(rng.integers(5, 60))]
        bad, toxic = i % 3 == 0, i % 4 == 0
        if toxic:
            words[int(rng.integers(0, len(words)))] = f"vequ{''.join(rng.choice([*'abcd'], 2))}"
            words[int(rng.integers(0, len(words)))] = f"vequ{''.join(rng.choice([*'abcd'], 2))}"
        rows.append((i, ("%%% " if bad else " ").join(words), int(not bad), int(toxic)))
    return rows


def test_classifiers(spark, odd):
    rows = labelled_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    for module, k in ((quality_cnn, 2), (toxicity, 3)):
        out = {r.doc_id: r for r in module.classify(docs, labels).collect()}
        held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % module.FOLDS == module.HELD_OUT]
        assert {i for i, r in out.items() if r.held_out} == {r[0] for r in held} and all(0 <= r.score <= 1 for r in out.values())
        assert sum(out[r[0]].predicted == r[k] for r in held) >= 0.8 * len(held)
        assert module.classify(odd, labels).count() == len(ODD) and module.classify(empty(spark), labels).count() == 0
        assert module.classify(odd, labels.filter("false")).filter("score is not null").count() == len(ODD)
    drawn = labelled.sample(docs, labels.union(labels), "toxic", 4, 2)
    assert len(drawn) == sum(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows)
    assert toxicity.passages(0).tolist() == [[0, 0]] and toxicity.passages(17).tolist() == [[0, 16], [8, 17]]


def test_network_equals_loops():
    """Brute force: every filter at every second byte of every chunk, one place at a time."""
    rng = np.random.default_rng(17)
    net = quality_cnn.ByteCNN.fresh(5)
    net.bias = rng.normal(0, 0.1, quality_cnn.FILTERS).astype(np.float32)
    texts = ["", "a", "short text", "é好 " * 150, "x" * 1500, "word " * 240]
    want = []
    for text in texts:
        data = text.encode()
        data += b"\0" * (len(data) % 2)
        step, size = 2 * quality_cnn.STEP, 2 * quality_cnn.CHUNK
        starts = [0, *range(step, max(0, len(data) - size + step), step)]
        means = np.zeros(quality_cnn.FILTERS)
        for s in starts:
            chunk = data[s : s + size].ljust(size, b"\0")
            best = np.full(quality_cnn.FILTERS, -np.inf)
            for p in range(0, size - quality_cnn.WIDTH + 1, 2):
                best = np.maximum(best, sum(net.filters[j, chunk[p + j]] for j in range(quality_cnn.WIDTH)))
            means += np.maximum(best + net.bias, 0)
        want.append(1 / (1 + np.exp(-(means / len(starts) @ net.weights + net.intercept[0]))))
    assert np.allclose(net.scores(texts), want, atol=1e-5)


def test_subwords_equal_loops():
    """Brute force: the softmax of each passage's averaged embeddings, one word at a time; the worst passage counts."""
    rng = np.random.default_rng(18)
    model = toxicity.SubwordModel(rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), rng.normal(0, 1, (toxicity.DIM, 2)).astype(np.float32), np.array([0.3, -0.5]))
    scorer, words = toxicity.Scorer(model), ["bad", "good", "Uglé", "x", "(word)", "...", "lengthyword"]
    for n in (0, 1, 7, 16, 17, 60):
        text = " ".join(rng.choice(words, n))
        tokens, worst = text.lower().split(), -1.0
        for a, z in toxicity.passages(len(tokens)):
            mean = np.zeros(toxicity.DIM)
            for i in range(a, z):
                if i == 0 or tokens[i] != tokens[i - 1]:
                    grams = toxicity.subwords(tokens[i])
                    mean += sum(model.rows[g].astype(float) for g in grams) / max(len(grams), toxicity.LEAST_GRAMS)
            logits = toxicity.SCALE * (mean / toxicity.PASSAGE) @ model.out + model.bias
            worst = max(worst, 1 / (1 + np.exp(np.clip(logits[0] - logits[1], -60, 60))))
        assert scorer.score(text) == pytest.approx(worst, rel=1e-3, abs=1e-9)


def test_whole_text_counts():
    """A signal at the very end of a long text reaches the score."""
    net = quality_cnn.ByteCNN.fresh()
    base = "a" * 100_000
    pooled = [net.scores([base])[0], net.scores([base + "%%% " * 200])[0]]
    assert pooled[0] != pooled[1]
    chunks, owner = quality_cnn.chunks_of([base])
    assert len(chunks) * quality_cnn.STEP * 2 >= len(base) and set(owner) == {0}
