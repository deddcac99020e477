"""A corpus pipeline of five stages over ``documents``; each stage calls one operator of veilspark.llm.

1. language id: rows whose language cannot be told go;
2. SimHash near-dedup: one document of each group stays;
3. suffix-array dedup: bytes of 50-byte strings that a smaller doc_id also has go, rows stay;
4. mixing: rows are put in the order of the Pfair schedule, none goes;
5. BPE: rows get their token ids.

Each stage works on all rows of the one before; all but the last return the columns of
``documents``.  Stages take null and repeated ids, null, empty and long texts and empty tables as
their operators do.  Their results may be lazy and composed: what an operator left in the shared
folder stays until ``run``, which writes each result, deletes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.llm import bpe, langid, mixing, similar, suffix_dedup
from veilspark.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language is certain enough go."""
    return langid.keep_known(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Texts whose sets of five-word shingles have a similarity of 0.8 or more are linked.  SimHashes within
    4 of 64 bits and MinHash bands only propose pairs; each link is verified by the shingle sets.
    """
    return similar.keep_one(docs, shingle=5, least=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a smaller doc_id also has go; every document stays."""
    return suffix_dedup.remove(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the schedule of their sources' target weights."""
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their tokens."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL has neither the models nor the graph steps; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        known = list(Scratch.made)
        docs = scratch.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        for s in [s for s in Scratch.made if s not in known]:
            s.clear()
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
