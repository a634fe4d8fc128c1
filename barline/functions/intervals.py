"""Bar intervals, calendar periods and buckets."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed set of bar intervals and their lengths in seconds.
SECONDS = {"1m": 60, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
_LONG = {"1m": "1 minute", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def duration(interval: str) -> str:
    """The interval as Spark's window() takes it."""
    if interval not in _LONG:
        raise ValueError(f"unknown interval: {interval}")
    return _LONG[interval]


def interval_seconds(interval: Column) -> Column:
    """Length of an interval column; anything outside the closed set raises."""
    out = F.raise_error(F.concat(F.lit("unknown interval: "), F.coalesce(interval, F.lit("null")))).cast("int")
    for name, seconds in SECONDS.items():
        out = F.when(interval == name, F.lit(seconds)).otherwise(out)
    return out


def close_time(start: Column, seconds: Column | int) -> Column:
    """Last millisecond of the bar: start + step - 1 ms."""
    step = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(start) + step.cast("long") * 1_000_000 - 1000)


def bucket(ts: Column, interval: str) -> Column:
    """Start of the epoch-aligned bucket, in any session zone and before 1970 too."""
    return F.window(ts, duration(interval)).start


def add_seconds(ts: Column, seconds: Column | int) -> Column:
    step = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + step.cast("long") * 1_000_000)


def utc_date(ts: Column) -> Column:
    """The UTC calendar day of an instant, in any session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))


def utc_start(day: Column) -> Column:
    """The instant at which a calendar day starts in UTC."""
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400)


def utc_hour(ts: Column) -> Column:
    return F.pmod(F.floor(F.unix_micros(ts) / 3_600_000_000), F.lit(24)).cast("int")


def utc_floor(ts: Column, unit: str) -> Column:
    """Start of the UTC 'day' or 'month' of an instant."""
    return utc_start(F.trunc(utc_date(ts), "month") if unit == "month" else utc_date(ts))


def period_kind(period: Column) -> Column:
    """'day', 'month' or null by the text's form."""
    return F.when(period.rlike(r"^\d{4}-\d{2}-\d{2}\z"), "day").when(period.rlike(r"^\d{4}-\d{2}\z"), "month")


def period_bounds(period: Column) -> Column:
    """struct(start, end) in UTC of 'YYYY-MM' or 'YYYY-MM-DD'; null where it is no such date."""
    kind = period_kind(period)
    first = F.when(kind == "day", period).when(kind == "month", F.concat(period, F.lit("-01"))).try_cast("date")
    end = F.when(kind == "day", F.date_add(first, 1)).otherwise(F.add_months(first, 1))
    return F.when(first.isNotNull(), F.struct(utc_start(first).alias("start"), utc_start(end).alias("end")))


def touched_months(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row (the other columns, month) for every UTC calendar month that meets [start, end)."""
    return ranges.filter(F.col(start) < F.col(end)).withColumn("month", F.explode(months_between(F.col(start), F.col(end))))


def months_between(start: Column, end: Column) -> Column:
    """The starts of the UTC months that meet [start, end)."""
    last = F.trunc(utc_date(F.timestamp_micros(F.unix_micros(end) - 1)), "month")
    return F.transform(F.sequence(F.trunc(utc_date(start), "month"), last, F.expr("INTERVAL 1 MONTH")), utc_start)


def resolve_range(start: str, end: str, now: datetime | None = None, whole_days: bool = False) -> tuple[datetime, datetime]:
    """[start, end) with end 'latest-closed' as now floored to the minute. Both must be whole
    minutes (or days), in order, and not beyond the latest closed minute."""
    latest = (now or datetime.now(timezone.utc)).replace(second=0, microsecond=0)

    def parse(text: str) -> datetime:
        if text == "latest-closed":
            return latest
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)

    a, b = parse(start), parse(end)
    for at in (a, b):
        if at.second or at.microsecond or (whole_days and (at.hour or at.minute)):
            raise ValueError(f"{at.isoformat()} is not a whole {'day' if whole_days else 'minute'}")
    if a >= b:
        raise ValueError("the range is empty")
    if b > latest:
        raise ValueError(f"the range ends after the latest closed minute {latest.isoformat()}")
    return a, b


__all__ = ["SECONDS", "add_seconds", "bucket", "close_time", "duration", "interval_seconds", "months_between", "period_bounds", "period_kind", "resolve_range", "touched_months", "utc_date", "utc_floor", "utc_hour", "utc_start"]
