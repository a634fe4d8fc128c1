"""Roll-up of bars, only where every child is present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import SECONDS, close_time, duration
from ..schemas import CANDLE_COLUMNS, VOLUMES

_KEY = ["venue", "market_type", "symbol"]


def _aggregates(target: str) -> list:
    return [
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        *[F.sum(v).cast("decimal(38,18)").alias(v) for v in VOLUMES], F.sum("trade_count").alias("trade_count"), F.count("*").alias("__rows"),
        F.count_distinct("open_time").alias("__slots"),
    ]


def resample_complete(df: DataFrame, base: str, target: str, unique: bool = True) -> DataFrame:
    """Bars of `target` from bars of `base`: first open, last close, highest high, lowest low and
    summed volumes and trades of each epoch-aligned bucket that holds exactly one bar on every
    slot; other buckets give no bar. With `unique` the input has one row per key (as merged
    tables do), so counting rows is enough and aggregation stays partial; otherwise
    a bucket with a repeated slot gives no bar either.
    """
    count = SECONDS[target] // SECONDS[base]
    slots = df.filter((F.col("interval") == base) & (F.unix_micros("open_time") % (SECONDS[base] * 1_000_000) == 0))
    aggs = _aggregates(target)
    grouped = slots.groupBy(*_KEY, F.window("open_time", duration(target)).alias("__w")).agg(*(aggs[:-1] if unique else aggs))
    whole = grouped.filter(F.col("__rows") == count) if unique else grouped.filter((F.col("__rows") == count) & (F.col("__slots") == count))
    start = F.col("__w.start").cast("timestamp")
    out = whole.withColumns({"interval": F.lit(target), "open_time": start, "close_time": close_time(start, SECONDS[target]), "source": F.lit("aggregate"), "source_file": F.lit(f"canonical:{base}")})
    return out.select(*CANDLE_COLUMNS)


def resample_ladder(df: DataFrame, levels: tuple[str, ...] = ("15m", "1h", "4h", "1d"), base: str = "1m") -> dict[str, DataFrame]:
    """Every level from the one below it: a complete bar has complete children, so the result
    is that of the base bars while each step reads far fewer rows."""
    out: dict[str, DataFrame] = {}
    lower, rows = base, df
    for level in levels:
        rows = resample_complete(rows, lower, level).withColumn("source_file", F.lit(f"canonical:{base}"))
        out[level] = rows
        lower = level
    return out


