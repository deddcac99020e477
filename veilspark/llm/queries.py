"""The thin ``opN_*`` queries: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, embed_dedup, langid, media, mixing, sharding, simhash, substring_dedup, suffix_dedup, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_read(spark, sf_dir, "documents")).drop("n_paths")


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]  # each corpus has a map of its own
    return sharding.assign(_read(spark, sf_dir, "documents"), store=sharding.store_of(spark, name))


def op4_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages"))


def op6_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.classes(_read(spark, sf_dir, "embeddings"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_read(spark, sf_dir, "documents"))


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs)


def op10_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.run(pages, _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_dedup, op2_substring_dedup, op3_virtual_slots, op4_media_archive, op5_language_id, op6_embedding_forest, op7_suffix_array_dedup, op8_bpe_trie, op9_pfair_mixing, op10_url_gbt)
}
