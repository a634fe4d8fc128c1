"""Archive and page plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import add_seconds, months_between, utc_date, utc_start

PLAN = ["symbol", "interval", "source_type", "period", "file_name", "url", "start", "end"]


def archive_name(symbol: Column, interval: Column, period: Column) -> Column:
    return F.format_string("%s-%s-%s.zip", symbol, interval, period)


def archive_url(root: str, source_type: Column, symbol: Column, interval: Column, file_name: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), source_type, F.lit("klines"), symbol, interval, file_name)


def _named(rows: DataFrame, root: str) -> DataFrame:
    name = archive_name(F.col("symbol"), F.col("interval"), F.col("period"))
    url = archive_url(root, F.col("source_type"), F.col("symbol"), F.col("interval"), F.col("file_name"))
    return rows.withColumn("file_name", name).withColumn("url", url).select(*[c for c in rows.columns if c not in PLAN], *PLAN)


def _days(start: Column, end: Column) -> Column:
    """The starts of the UTC days that meet [start, end)."""
    return F.transform(F.sequence(utc_date(start), utc_date(F.timestamp_micros(F.unix_micros(end) - 1)), F.expr("INTERVAL 1 DAY")), utc_start)


def archive_plan(ranges: DataFrame, now: Column, root: str) -> DataFrame:
    """Items that cover each range (symbol, interval, start, end): a monthly one for every whole
    calendar month inside the range that is over, else daily ones; the first and last may be
    partial days. Ranges must start before they end; others give no items."""
    ranges = ranges.filter("start < end")
    months = ranges.withColumn("m", F.explode(months_between(F.col("start"), F.col("end"))))
    months = months.withColumn("m_end", utc_start(F.add_months(utc_date(F.col("m")), 1)))
    whole = (F.col("m") >= F.col("start")) & (F.col("m_end") <= F.col("end")) & (F.col("m_end") <= now)
    monthly = months.filter(whole).select("symbol", "interval", F.lit("monthly").alias("source_type"), F.date_format(utc_date(F.col("m")), "yyyy-MM").alias("period"), F.col("m").alias("start"), F.col("m_end").alias("end"))
    part = months.filter(~whole).withColumns({"lo": F.greatest("start", "m"), "hi": F.least("end", "m_end")})
    days = part.withColumn("d", F.explode(_days(F.col("lo"), F.col("hi"))))
    daily = days.select("symbol", "interval", F.lit("daily").alias("source_type"), F.date_format(utc_date(F.col("d")), "yyyy-MM-dd").alias("period"), F.greatest("d", "lo").alias("start"), F.least(add_seconds(F.col("d"), 86_400), F.col("hi")).alias("end"))
    return _named(monthly.unionByName(daily), root)


def daily_fallback(plan: DataFrame, root: str) -> DataFrame:
    """The days of each monthly item, with the item's file name as `parent`. The symbol is the file
    name up to its first dash."""
    months = plan.filter("source_type = 'monthly'").select(F.split("file_name", "-")[0].alias("symbol"), "interval", F.col("file_name").alias("parent"), F.explode(_days(F.col("start"), F.col("end"))).alias("start"))
    days = months.select("parent", "symbol", "interval", F.lit("daily").alias("source_type"), F.date_format(utc_date(F.col("start")), "yyyy-MM-dd").alias("period"), "start", add_seconds(F.col("start"), 86_400).alias("end"))
    return _named(days, root)


def page_plan(gaps: DataFrame, step: Column, limit: int = 1000, most_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(requests, refused): each range (gap_start, gap_end) in requests of at most `limit` steps;
    empty ranges and those over `most_days` days are refused (31 for comparisons)."""
    from ..operators.quality import split_repairable

    ok, refused = split_repairable(gaps, most_days)
    size = step.cast("long") * limit * 1_000_000
    starts = F.sequence(F.unix_micros("gap_start"), F.unix_micros("gap_end") - 1, size)
    cut = ok.withColumn("__size", size).withColumn("__at", F.explode(starts))
    pages = cut.withColumns({"page_start": F.timestamp_micros("__at"), "page_end": F.timestamp_micros(F.least(F.col("__at") + F.col("__size"), F.unix_micros("gap_end")))})
    return pages.drop("__at", "__size"), refused
