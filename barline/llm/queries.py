"""Registered queries of the training-data operators: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, spelling
from .alignment import align_documents
from .decontaminate import contaminated
from .licenses import scan_documents
from .mixing import mix_documents
from .near_dup import near_duplicates
from .pii import find_personal_data
from .quality import quality_rules
from .secrets import find_secrets, secrets_sql
from .sharding import shard_documents
from .substring import substring_dedup
from .suffix import suffix_array_dedup
from .url_rules import content_labels, filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op3_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are mined from labels that the pages' visible texts give."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, content_labels(pages))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=0.85)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "score", "begin", "end")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op10_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))


def op12_group_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_mix_sources, op3_filter_urls, op4_suffix_array_dedup, op5_shard,
        op6_near_duplicates, op7_decontaminate, op8_quality_rules, op9_personal_data, op10_scan_licenses,
        op11_align_tokenizers, op12_group_spellings, op13_scan_secrets,
    )
}

SQL: dict[str, str] = oracles.SQL | {"op12_group_spellings": spelling.SQL, "op13_scan_secrets": secrets_sql()}
