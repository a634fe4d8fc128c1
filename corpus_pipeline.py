"""A training corpus from raw documents: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.decontaminate import clean_documents
from barline.llm.mixing import mix
from barline.llm.near_dup import keep_first
from barline.llm.quality import filter_documents
from barline.llm.shared import save
from barline.llm.sharding import rendezvous_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first quality rules, with their failed lines cut out (n_chars follows).

    Null and empty texts are rejected; repeated rows are each judged; an empty table stays empty.
    """
    kept = filter_documents(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest id (null ids last).

    Of repeated rows one stays, and of several texts under one id the one of smallest hash; texts
    without words are in no group and all stay (one row per id).
    """
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; repeated rows share
    their fate; of rows with one id only those whose text holds an item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a document taken twice is two rows).

    A null source is a source; texts without words are not taken; equal rows share their fate.
    """
    chosen, _ = mix(docs, F.array(F.col("source").cast("string")), times="__times", size="__size")
    return chosen.filter("__times > 0").withColumn("__copy", F.explode(F.expr("sequence(1, __times)"))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard (0 to 39) that their id belongs to. Null ids share one shard; a
    column `shard` is replaced; every row stays."""
    return rendezvous_shards(docs, ["doc_id"], [1.0] * 40)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: Near-duplicates, alignment and the mix are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
