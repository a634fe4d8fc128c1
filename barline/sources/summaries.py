"""What is stored, by month: rows, ends, bad rows and inner gaps, appended with each rewritten month.

The newest summary of each key and month tells watermarks and gaps of a whole history without reading
a bar of it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.intervals import add_seconds, interval_seconds, utc_date
from ..operators.quality import rule_codes
from ..schemas import KEY
from .staging import exists
from .tables import PARTITION, PLACED, read_candles

SUMMARY = "venue string, market_type string, symbol string, interval string, year string, month string, rows long, bad_rows long, first_open timestamp, last_open timestamp, gaps array<struct<gap_start: timestamp, gap_end: timestamp>>, written_at timestamp"
#: Symbols that a scan names in its partition predicate; with more of them it names months alone.
NAMED_SYMBOLS = 500


def month_of(df: DataFrame) -> DataFrame:
    day = utc_date(F.col("open_time"))
    return df.withColumns({"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM")})


def summarize(bars: DataFrame) -> DataFrame:
    """One row for each key and UTC month. Neighbours and sums share one shuffle; a month's gaps are at most as
    many as half its bars."""
    before = F.lag("open_time").over(Window.partitionBy(*PARTITION).orderBy("open_time"))
    after = add_seconds(F.col("__prev"), interval_seconds(F.col("interval")))
    gap = F.when(F.col("open_time") > after, F.struct(after.alias("gap_start"), F.col("open_time").alias("gap_end")))
    rows = month_of(bars).withColumn("__bad", F.size(rule_codes()) > 0).select(*PARTITION, "open_time", "__bad").withColumn("__prev", before)
    return rows.groupBy(*PARTITION).agg(
        F.count("*").alias("rows"), F.count_if("__bad").alias("bad_rows"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"), F.array_sort(F.collect_list(gap)).alias("gaps")
    ).withColumn("written_at", F.current_timestamp())


def append_summary(bars: DataFrame, path: str) -> None:
    """Append the summary of whole months, as they now stand in the table."""
    summarize(bars).write.mode("append").parquet(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The newest summary of each key and month."""
    if not exists(spark, path):
        return spark.createDataFrame([], SUMMARY)
    rows = spark.read.schema(SUMMARY).parquet(path)
    rest = [c for c in rows.columns if c not in PARTITION]
    return rows.groupBy(*PARTITION).agg(F.max_by(F.struct(*rest), "written_at").alias("x")).select(*PARTITION, "x.*")


def stored_gaps(summary: DataFrame) -> DataFrame:
    """[gap_start, gap_end) of each key: inside its months, and between months that follow each other in the table."""
    inside = summary.select(*KEY, F.explode("gaps").alias("g")).select(*KEY, "g.*")
    after = add_seconds(F.lag("last_open").over(Window.partitionBy(*KEY).orderBy("year", "month")), interval_seconds(F.col("interval")))
    across = summary.select(*KEY, after.alias("gap_start"), F.col("first_open").alias("gap_end")).filter("gap_start < gap_end")
    return inside.unionByName(across)


def stored_ends(summary: DataFrame) -> DataFrame:
    """first_open and watermark (newest bar) of each key."""
    return summary.groupBy(*KEY).agg(F.min("first_open").alias("first_open"), F.max("last_open").alias("watermark"))


def stored_bars(spark: SparkSession, root: str) -> DataFrame:
    """The table at `root`, empty where nothing was written yet."""
    return read_candles(spark, root) if exists(spark, root) else spark.createDataFrame([], PLACED)


def stored_months(spark: SparkSession, root: str, months: DataFrame) -> DataFrame:
    """Stored bars (all intervals) of the given (venue, market_type, symbol, year, month), a small table.

    The months are named as literals, and the symbols too unless they are very many, so that other
    partitions are not even listed for reading; the semi join settles the exact pairs.
    """
    calendar: dict[str, list[str]] = {}
    for r in months.select("year", "month").distinct().collect():
        calendar.setdefault(r.year, []).append(r.month)
    symbols = [r.symbol for r in months.select("symbol").distinct().limit(NAMED_SYMBOLS + 1).collect()]
    wanted = reduce(or_, [(F.col("year") == y) & F.col("month").isin(ms) for y, ms in sorted(calendar.items())], F.lit(False))
    if len(symbols) <= NAMED_SYMBOLS:
        wanted = wanted & F.col("symbol").isin(symbols)
    return stored_bars(spark, root).filter(wanted).join(months, [*KEY[:3], "year", "month"], "left_semi")
