"""A corpus pipeline of five stages: quality classifier, quality rules, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gets what the stage before kept; all but the last return the columns of
documents. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verselake.llm import bpe, decontaminate, quality_cnn, quality_rules, simhash
from verselake.llm.queries import tokenizer_file
from verselake.session import ship_package, table, written

#: Near-duplicates have five-word shingles, and a Jaccard similarity of ``simhash.SIMILAR`` or more.
SHINGLE = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the cut go."""
    net = quality_cnn.trained(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_cnn.score_column(net, F.col("text")) >= quality_cnn.CUT)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; rows with one id and one text share a verdict."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of near-duplicates stays."""
    return simhash.keep_one(docs, shingle=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that is left, by digest."""
    return bpe.digests(docs, tokenizer_file("byte_bpe_50k.tiktoken"))


def _shipped(f):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, docs, sf_dir)

    return stage


STAGES = [
    (name, _shipped(f))
    for name, f in (
        ("quality classifier", quality_classifier),
        ("quality rules", quality_filter),
        ("near-dedup", near_dedup),
        ("decontamination", decontamination),
        ("byte-level BPE", tokens),
    )
]
#: SQL can express neither the network nor the fingerprints nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
