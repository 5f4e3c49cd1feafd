"""Each stage of the pipeline against a brute-force version, on rows with nulls, repeats, ties and clashing columns."""

import hashlib
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from verselake.llm import bpe, quality_cnn, quality_rules  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
COMMON = "the of and to in is that it was for on with as".split()


def prose(rng, n):
    words = ["".join(rng.choice([*"aeioustrnl"], int(rng.integers(2, 8)))) for _ in range(n)]
    for i in range(0, n, 4):
        words[i] = str(rng.choice(COMMON))
    return " ".join(words)


def rows_of():
    rng = np.random.default_rng(31)
    item = prose(rng, 50)
    rows = [(i, prose(rng, int(rng.integers(40, 120)))) for i in range(40)]
    rows += [(100 + i, "%%% ".join(prose(rng, 30).split())) for i in range(20)]
    base = prose(rng, 150).split()
    for k in range(6):
        words = list(base)
        words[20 * k] = f"edit{k}"
        rows.append((200 + k, " ".join(words)))
    rows += [(300, f"{prose(rng, 60)} {item} {prose(rng, 60)}"), (301, rows[0][1]), (301, rows[0][1]), (302, None), (303, ""), (None, prose(rng, 60)), (None, None), (304, "z" * 70_000 + " " + prose(rng, 3000))]
    return rows, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, item = rows_of()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 100 <= i < 200), 0) for i, _ in rows if i is not None and i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs.withColumns({c: F.lit("clash") for c in ("_row", "_kept", "_gone", "_held", "component", "folded", "rep", "score", "quality", "item_id")}), rows, item


def keys(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())


def texts(rows):
    return sorted(((-1 if i is None else i), t or "") for i, t in rows)


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    folder, docs, _, _ = tables
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.filter("false"), folder)
        assert out.count() == 0 and (name == "byte-level BPE" or out.columns == docs.columns), name


def test_quality_classifier(spark, tables):
    folder, docs, rows, _ = tables
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    net = quality_cnn.trained(docs, labels)
    want = [(i, t) for (i, t), s in zip(rows, net.scores([t or "" for _, t in rows])) if s >= quality_cnn.CUT]
    assert keys(STAGES["quality classifier"](spark, docs, folder)) == texts(want)
    mean = lambda lo, hi: np.mean(net.scores([t for i, t in rows if i is not None and lo <= i < hi]))
    assert mean(0, 40) > mean(100, 120)


def test_quality_rules(spark, tables):
    folder, docs, rows, _ = tables
    judged = {(r.doc_id, r.n_words, r.word_chars) for r in quality_rules.judge(docs).filter("kept").collect()}
    got = {(r.doc_id, len((r.text or "").split()), len("".join((r.text or "").split()))) for r in STAGES["quality rules"](spark, docs, folder).collect()}
    assert got == judged and {i for i, _, _ in got} >= set(range(40)) and not {i for i, _, _ in got} & set(range(100, 120))


def test_near_dedup(spark, tables):
    from test_llm import brute_similar

    folder, docs, rows, _ = tables
    label = brute_similar([(k, t or "") for k, (i, t) in enumerate(rows) if t])
    least = {}
    for k, (i, t) in enumerate(rows):
        if i is not None:
            group = label[k] if t else -1
            least[group] = min(least.get(group, i), i)
    want = [(i, t) for k, (i, t) in enumerate(rows) if i is None or i == least[label[k] if t else -1]]
    assert keys(STAGES["near-dedup"](spark, docs, folder)) == texts(want)
    assert len(want) < len(rows) - 5


def test_decontamination(spark, tables):
    from test_llm import brute_windows

    folder, docs, rows, item = tables
    want = [(i, t) for i, t in rows if not t or len(t.split()) > 2000 or brute_windows(t, item) < 0.8]
    assert keys(STAGES["decontamination"](spark, docs, folder)) == texts(want) and len(want) == len(rows) - 1


def test_tokens(spark, tables):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    folder, docs, rows, _ = tables
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in STAGES["byte-level BPE"](spark, docs, folder).collect()]
    assert sorted(got) == sorted(want)


def test_run_is_its_stages(spark, tables):
    """The whole pipeline, stage after stage on plain rows."""
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, folder)
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, folder).collect())) and docs.count() > 30
