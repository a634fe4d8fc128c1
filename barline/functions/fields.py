"""Strict field parsing and comparison of bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import VALUES

_NUMBER = r"^[+-]?\d+(\.\d+)?\z"
_DAY = 86_400


def parse_decimal(text: Column) -> Column:
    """DECIMAL(38,18) of plain decimal text; null for blanks, exponents and anything that would round."""
    return F.when(text.rlike(_NUMBER) & fits_scale(text, 18), text.try_cast("decimal(38,18)"))


def parse_long(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+\z"), text.try_cast("bigint"))


def fits_scale(text: Column, scale: int) -> Column:
    """Whether the fraction, less trailing zeros, has at most `scale` digits."""
    return F.length(F.regexp_replace(F.regexp_extract(text, r"\.(\d+)$", 1), "0+$", "")) <= scale


def infer_ts_unit(value: Column, start: Column, end: Column, slack_days: int = 2) -> Column:
    """'ms', 'us' or null: the one unit in which an integer falls within the range and its slack.

    Integers are compared, so no timestamp overflows; both or neither fitting is null.
    """
    slack = slack_days * _DAY
    fits = {}
    for unit, scale in (("ms", 1000), ("us", 1_000_000)):
        per_second = F.lit(1_000_000 // scale)
        lo, hi = (F.floor(F.unix_micros(x) / per_second).cast("long") for x in (start, end))
        fits[unit] = (value >= lo - slack * scale) & (value <= hi + slack * scale)
    return F.when(fits["ms"] & ~fits["us"], "ms").when(fits["us"] & ~fits["ms"], "us")


def epoch_to_timestamp(value: Column, unit: Column) -> Column:
    return F.when(unit.isNotNull(), F.timestamp_micros(F.when(unit == "ms", value * 1000).otherwise(value)))


def values_of(alias: str = "") -> Column:
    """The ten market values of a bar as one struct."""
    prefix = f"{alias}." if alias else ""
    return F.struct(*[F.col(prefix + c).alias(c) for c in VALUES])


def same_values(left: str, right: str) -> Column:
    return values_of(left).eqNullSafe(values_of(right))

