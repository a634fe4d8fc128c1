"""Helpers shared by the operators: durable intermediate tables and a fixed-size sketch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the largest sketch, as a power of two: 16 MB, whatever the input's size.
SKETCH_BITS = 27
#: A sketch is folded while at most one bit in so many is set.
SPARSE = 64
NO_ID = (1 << 63) - 1
#: Bytes of rows that Spark hands a Python worker at a time, however long the texts of a partition are.
BATCH_BYTES = 4_000_000
#: Bytes that Spark gathers in a task after a shuffle, where many short rows meet in hash tables and sorts.
TASK_BYTES = 16_000_000


@contextmanager
def _limited(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    """A limit that the session has set itself is kept, and an unset one is unset again afterwards."""
    if spark.conf.get(name, None):
        yield
        return
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name)


def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_BYTES while a table is written or a sketch is folded."""
    return _limited(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def narrow_tasks(spark: SparkSession):
    """Tasks of about TASK_BYTES behind shuffles, for what is run meanwhile."""
    return _limited(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a temporary one does for a
    local session only; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="barline-")
    return path.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/barline/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_of_text() -> Column:
    """The `part` of a row: all 64 bits of its text's hash, since a null id can be that of very many rows."""
    return F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with `doc_key` (a null id sorts last) and `part`, a 64-bit hash that tells
    apart rows that share an id but not a text. Other columns are dropped, so clashes cannot occur."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key"),
        part_of_text().alias("part"),
        F.col("text"),
    )


def repeated_sketch(repeated: DataFrame, column: str) -> np.ndarray:
    """A Bloom bitmap (two probes) of a hash column, OR-ed by Spark word by word.

    Its size is bounded by SKETCH_BITS, not by the data (sparse bitmaps fold to smaller ones);
    false positives only let more candidates through, and every candidate is compared
    exactly later.
    """
    h = F.col(column)
    mask = (1 << SKETCH_BITS) - 1
    probes = F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, SKETCH_BITS).bitwiseAND(F.lit(mask)))
    bits = repeated.select(F.explode(probes).alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("word"))
    bits = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 AS int))")).alias("bits"))
    with small_batches(repeated.sparkSession):
        words = bits.toArrow()
    out = np.zeros(1 << (SKETCH_BITS - 5), dtype=np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    while len(out) > 32 and int(np.bitwise_count(out).sum()) * SPARSE <= len(out) * 16:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def in_sketch(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(sketch) * 32 - 1)
    hit = np.ones(len(h), dtype=bool)
    for bit in (h & mask, (h >> np.uint64(SKETCH_BITS)) & mask):
        hit &= (sketch[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & 1 == 1
    return hit


def code_points(column: Column) -> Column:
    """Sort key that orders strings by code point (UTF-8 bytes order alike)."""
    return F.encode(column, "UTF-8")
