"""Row rules, gaps, order and coverage of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import add_seconds, interval_seconds, utc_date, utc_floor, utc_start
from ..schemas import KEY, PRICES, ROW_KEY, VOLUMES
from ..functions.fields import values_of


def rule_codes(start: Column | None = None, end: Column | None = None) -> Column:
    """Array of the codes of every rule that a bar breaks."""
    length = F.unix_micros("close_time") - F.unix_micros("open_time")
    step = interval_seconds(F.col("interval")).cast("long") * 1_000_000
    rules = {
        "misaligned": F.unix_micros("open_time") % step != 0,
        "high_below": F.col("high") < F.greatest("open", "close", "low"),
        "low_above": F.col("low") > F.least("open", "close"),
        "price_not_positive": F.least(*PRICES) <= 0,
        "volume_negative": F.least(*VOLUMES) < 0,
        "trades_negative": F.col("trade_count") < 0,
        "bad_duration": ~length.between(step - 1_000_000, step - 1),
    }
    if start is not None and end is not None:
        rules["out_of_range"] = (F.col("open_time") < start) | (F.col("open_time") >= end)
    return F.array_compact(F.array(*[F.when(broken, code) for code, broken in rules.items()]))


def in_scope(df: DataFrame, key: dict[str, str], start: Column, end: Column) -> DataFrame:
    """Rows of one key in [start, end)."""
    for column, value in key.items():
        df = df.filter(F.col(column) == value)
    return clip_to_range(df, start, end)


def clip_to_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.filter((F.col("open_time") >= start) & (F.col("open_time") < end))


def quality_violations(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row (row key, code) for every rule that a row breaks."""
    return df.withColumn("code", F.explode(rule_codes(start, end))).select(*ROW_KEY, "code")


def duplicate_keys(df: DataFrame, order: str = "line_no") -> DataFrame:
    """Keys seen more than once: how often, with how many different values; equal values may
    collapse to the last input row, others are a conflict."""
    rows = df.groupBy(*ROW_KEY).agg(F.count("*").alias("copies"), F.count_distinct(values_of()).alias("variants"), F.max(order).alias("last_row"))
    return rows.filter("copies > 1")


def conflicting_duplicates(df: DataFrame, order: str = "line_no") -> DataFrame:
    return duplicate_keys(df, order).filter("variants > 1")


def collapse_duplicates(df: DataFrame, order: str = "line_no") -> DataFrame:
    """One row per key: the last in input order."""
    rest = [c for c in df.columns if c not in ROW_KEY]
    last = df.groupBy(*ROW_KEY).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return last.select(*[F.col(c) if c in ROW_KEY else F.col("last")[c].alias(c) for c in df.columns])


def split_by_file(df: DataFrame, order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows: a file with one broken rule or repeated key is refused whole."""
    broken = df.filter(F.size(rule_codes()) > 0).select("source_file")
    repeated = df.groupBy("source_file", *ROW_KEY).count().filter("count > 1").select("source_file")
    bad = broken.unionByName(repeated).distinct()
    return df.join(bad, "source_file", "left_anti"), df.join(bad, "source_file", "left_semi")


def interior_gaps(df: DataFrame) -> DataFrame:
    """[gap_start, gap_end) between neighbouring bars of a key.

    The neighbour is looked up inside (key, month), so a long history splits over tasks; the
    months are then stitched by their first and last bars.
    """
    step = interval_seconds(F.col("interval"))
    bars = df.select(*ROW_KEY).withColumn("month", utc_floor(F.col("open_time"), "month"))
    inside = Window.partitionBy(*KEY, "month").orderBy("open_time")
    near = bars.withColumn("prev", F.lag("open_time").over(inside)).filter("prev IS NOT NULL")
    edges = bars.groupBy(*KEY, "month").agg(F.min("open_time").alias("open_time"), F.max("open_time").alias("last"))
    across = edges.withColumn("prev", F.lag("last").over(Window.partitionBy(*KEY).orderBy("month"))).filter("prev IS NOT NULL")
    pairs = near.select(*ROW_KEY, "prev").unionByName(across.select(*ROW_KEY, "prev"))
    after = add_seconds(F.col("prev"), step)
    return pairs.filter(F.col("open_time") > after).select(*KEY, after.alias("gap_start"), F.col("open_time").alias("gap_end"))


def find_gaps(df: DataFrame, expected: DataFrame) -> DataFrame:
    """All gaps of the expected ranges (key columns, start, end): before the first bar, between
    bars, after the last; a key without bars is one gap."""
    ranges = expected.select(*KEY, "start", "end")
    bars = df.join(ranges, KEY).filter("open_time >= start AND open_time < end").select(*ROW_KEY)
    ends = bars.groupBy(*KEY).agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    spans = ranges.join(ends, KEY, "left")
    after = add_seconds(F.col("last"), interval_seconds(F.col("interval")))
    outer = spans.select(*KEY, F.explode(F.array(
        F.struct(F.col("start").alias("gap_start"), F.coalesce("first", "end").alias("gap_end")),
        F.struct(F.coalesce(after, F.col("end")).alias("gap_start"), F.col("end").alias("gap_end")),
    )).alias("g")).select(*KEY, "g.*").filter("gap_start < gap_end")
    return interior_gaps(bars).unionByName(outer)


def order_violations(df: DataFrame, file: str = "source_file", order: str = "line_no") -> DataFrame:
    """Rows that do not come strictly after the row before them in their file."""
    before = Window.partitionBy(file, *KEY).orderBy(order)
    rows = df.withColumn("previous", F.lag("open_time").over(before))
    return rows.filter("open_time <= previous").select(file, order, *ROW_KEY, "previous")


def validate_range(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Per key: rows, first, last, bad rows, gaps and whether the range is valid."""
    ranges = expected.select(*KEY, "start", "end")
    bars = df.join(ranges, KEY).filter("open_time >= start AND open_time < end")
    found = bars.groupBy(*KEY).agg(F.count("*").alias("rows"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"), F.count_if(F.size(rule_codes()) > 0).alias("bad_rows"))
    gaps = find_gaps(df, expected).groupBy(*KEY).agg(F.count("*").alias("gaps"))
    out = ranges.select(*KEY).join(found, KEY, "left").join(gaps, KEY, "left").fillna(0, ["rows", "bad_rows", "gaps"])
    return out.withColumn("valid", (F.col("bad_rows") == 0) & (F.col("gaps") == 0))


def watermark(df: DataFrame) -> DataFrame:
    """Newest bar of each key: the only measure of progress."""
    return df.groupBy(*KEY).agg(F.max("open_time").alias("watermark"))


def period_coverage(df: DataFrame, unit: str) -> DataFrame:
    """Per key and UTC calendar 'day' or 'month': expected and actual bars, and whether all are there and valid."""
    start = utc_floor(F.col("open_time"), unit)
    rows = df.groupBy(*KEY, start.alias("period_start")).agg(F.count("*").alias("rows"), F.count_distinct("open_time").alias("distinct_rows"), F.count_if(F.size(rule_codes()) > 0).alias("bad_rows"))
    day = utc_date(F.col("period_start"))
    end = utc_start(F.date_add(day, 1) if unit == "day" else F.add_months(day, 1))
    expected = ((F.unix_micros(end) - F.unix_micros("period_start")) / 1_000_000 / interval_seconds(F.col("interval"))).cast("long")
    return rows.withColumn("expected", expected).withColumn("valid", (F.col("bad_rows") == 0) & (F.col("distinct_rows") == F.col("expected")) & (F.col("rows") == F.col("expected")))


def file_ranges(df: DataFrame) -> DataFrame:
    """Candidate rows and first and last bar of each source file."""
    return df.groupBy("source_file").agg(F.count("*").alias("row_count"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"))


def interval_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("interval").agg(F.count("*").alias("rows"), F.count_distinct("symbol", "open_time").alias("distinct_rows"))


def split_repairable(gaps: DataFrame, most_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(repairable, refused) gaps: not empty and at most `most_days` long."""
    length = F.unix_micros("gap_end") - F.unix_micros("gap_start")
    ok = (length > 0) & (length <= most_days * 86_400_000_000)
    return gaps.filter(ok), gaps.filter(~ok)


def validate_repair(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Each gap with the number of its repair rows and whether they cover it complete and valid."""
    inside = rows.join(gaps.select(*KEY, "gap_start", "gap_end"), KEY).filter("open_time >= gap_start AND open_time < gap_end")
    got = inside.groupBy(*KEY, "gap_start", "gap_end").agg(F.count("*").alias("rows"), F.count_distinct("open_time").alias("distinct_rows"), F.count_if(F.size(rule_codes()) > 0).alias("bad_rows"))
    need = ((F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 1_000_000 / interval_seconds(F.col("interval"))).cast("long")
    out = gaps.join(got, [*KEY, "gap_start", "gap_end"], "left").fillna(0, ["rows", "distinct_rows", "bad_rows"]).withColumn("expected", need)
    return out.withColumn("complete", (F.col("rows") == F.col("expected")) & (F.col("distinct_rows") == F.col("expected")) & (F.col("bad_rows") == 0))
