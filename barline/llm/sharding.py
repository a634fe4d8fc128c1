"""Sharding by rendezvous hashing of stable record keys over weighted shards (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash bins inside a shard, so that slots are numbered without one task per shard.
BINS = 256


def scores(keys: list[Column], weights: list[float]) -> list[Column]:
    """Score of each shard for a record: the largest wins. -w / ln(u), u uniform in (0, 1)."""
    out = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        out.append(-F.lit(float(weight)) / F.log(u))
    return out


def rendezvous_shards(df: DataFrame, keys: list[str], weights: list[float], column: str = "shard", grown: str | None = None, added: float = 1.0) -> DataFrame:
    """Add the shard of each row: its key's highest score over the weighted shards.

    Only the key and the shards decide. `grown` names a second column with the shard after one
    more of weight `added`: a row either keeps its shard or moves to the new one. Null keys
    count as one key value. Ties go to the lower shard. Existing columns of these names are replaced.
    """
    cols = [F.col(k) for k in keys]
    each = [F.struct(s.alias("score"), F.lit(-i).alias("i")) for i, s in enumerate(scores(cols, [*weights, added]))]
    best = F.greatest(*each[:-1]) if len(weights) > 1 else each[0]
    out = df.withColumn("__best", best)
    new = {column: (-F.col("__best.i")).cast("int")}
    if grown:
        new[grown] = F.when(each[-1]["score"] > F.col("__best.score"), F.lit(len(weights))).otherwise(-F.col("__best.i")).cast("int")
    return out.withColumns(new).drop("__best")


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in an order that reruns repeat.

    Equal rows are counted first and unfolded last; the others are numbered inside hash bins,
    and each bin starts after the rows of the bins before it (BINS rows per shard).
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")).withColumn("__bin", F.pmod(F.xxhash64(*order), F.lit(BINS)).cast("int"))
    upto = Window.partitionBy(shard).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(shard, "__bin").agg(F.sum("__n").alias("__size")).withColumn("__start", F.coalesce(F.sum("__size").over(upto), F.lit(0))).drop("__size")
    before = Window.partitionBy(shard, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(starts, [shard, "__bin"]).withColumn("__first", F.col("__start") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return placed.select(*rows.columns, F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32 (null text as
    empty), law ('key'), shard, slot (gapless from 0 in each shard) and grown_shard (with one
    more shard). Null ids count as one key; repeated rows get slots of their own."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("text_hash")
    )
    placed = rendezvous_shards(rows, ["doc_id"], [1.0] * shards, "shard", "grown_shard")
    out = with_slots(placed, "shard", ["doc_id", "text_hash", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
