"""Hourly bars from the events table: the input of the candle queries, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import add_seconds, bucket, close_time, utc_date, utc_floor, utc_hour
from ..operators.quality import interior_gaps
from ..schemas import CANDLE_COLUMNS, KEY, PRICES, VOLUMES

PRICE = "CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,18))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol is the event type and price the value; first and last by (ts, event_id)."""
    e = table(spark, sf_dir, "events").filter("event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    e = e.select(F.col("event_type").alias("symbol"), instant("ts").alias("ts"), "event_id", F.expr(PRICE).alias("price"))
    at = F.struct("ts", "event_id")
    odd = F.when(F.col("event_id") % 2 == 1, F.col("price")).otherwise(F.lit(0).cast("decimal(38,18)"))
    bars = e.groupBy("symbol", bucket(F.col("ts"), "1h").alias("open_time")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("price").cast("decimal(38,18)").alias("base_asset_volume"), F.sum("price").cast("decimal(38,18)").alias("quote_asset_volume"), F.count("*").alias("trade_count"),
        F.sum(odd).cast("decimal(38,18)").alias("taker_buy_base_volume"), F.sum(odd).cast("decimal(38,18)").alias("taker_buy_quote_volume"),
    )
    out = bars.withColumns({"venue": F.lit("events"), "market_type": F.lit("spot"), "interval": F.lit("1h"), "close_time": close_time(F.col("open_time"), 3600), "source": F.lit("events"), "source_file": F.concat(F.lit("events-"), F.date_format(utc_date(F.col("open_time")), "yyyy-MM-dd"))})
    return out.select(*CANDLE_COLUMNS)


def altered(bars: DataFrame) -> DataFrame:
    """The bars with every fifth hour of the day gone, the close of hour 7 raised and one hour copied to a new symbol."""
    hour = utc_hour(F.col("open_time"))
    kept = bars.filter(hour % 5 != 0).withColumn("close", F.when(hour == 7, F.col("close") + 1).otherwise(F.col("close")).cast("decimal(38,18)"))
    return kept.unionByName(bars.filter(hour == 5).withColumn("symbol", F.concat(F.col("symbol"), F.lit("-new"))))


def spoilt(bars: DataFrame) -> DataFrame:
    """The bars with broken rows by fixed rules on the hour."""
    hour = utc_hour(F.col("open_time"))
    zero = F.lit(0).cast("decimal(38,18)")
    return bars.withColumns({
        "high": F.when(hour == 3, F.col("low") - 1).otherwise(F.col("high")).cast("decimal(38,18)"),
        "base_asset_volume": F.when(hour == 4, zero - 1).otherwise(F.col("base_asset_volume")).cast("decimal(38,18)"),
        "trade_count": F.when(hour == 5, F.lit(-1)).otherwise(F.col("trade_count")),
        "close_time": F.when(hour == 6, F.col("open_time")).otherwise(F.col("close_time")),
        "open_time": F.when(hour == 8, F.col("open_time") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("open_time")),
    })


def whole_range(bars: DataFrame) -> DataFrame:
    """Each key with the range of whole days around all bars."""
    first, last = bars.agg(F.unix_micros(utc_floor(F.min("open_time"), "day")), F.unix_micros(add_seconds(utc_floor(F.max("open_time"), "day"), 86_400))).first()
    ends = [F.lit(None).cast("timestamp") if x is None else F.timestamp_micros(F.lit(x)) for x in (first, last)]
    return bars.select(*KEY).distinct().withColumns({"start": ends[0], "end": ends[1]})


def instant(column: str):
    """A zone-less time as the instant at which UTC clocks show it, in any session zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} AS timestamp_ntz))"))


def utc(text: str):
    """The instant of 'YYYY-MM-DD[ HH:MM:SS]' in UTC."""
    return F.timestamp_micros(F.lit(int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000))


def dense_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars without most gaps: each bar stands for the 30 hours from its own on, and the bars
    that meet in an hour are put together."""
    b = bars_1h(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("open_time", add_seconds(F.col("open_time"), F.col("k") * 3600))
    total = lambda c: F.sum(c).cast("decimal(38,18)").alias(c)
    out = b.groupBy(*KEY, "open_time").agg(
        F.min("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"), total("base_asset_volume"), total("quote_asset_volume"),
        F.sum("trade_count").alias("trade_count"), total("taker_buy_base_volume"), total("taker_buy_quote_volume"),
    )
    out = out.withColumns({"close_time": close_time(F.col("open_time"), 3600), "source": F.lit("events"), "source_file": F.concat(F.lit("dense-"), F.date_format(utc_date(F.col("open_time")), "yyyy-MM-dd"))})
    return out.select(*CANDLE_COLUMNS)


def solid_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense bars with every gap between them filled by idle hours at price 1."""
    dense = dense_1h(spark, sf_dir)
    one, none = (F.lit(x).cast("decimal(38,18)") for x in (1, 0))
    idle = interior_gaps(dense).select(*KEY, F.explode(F.sequence("gap_start", add_seconds(F.col("gap_end"), -3600), F.expr("INTERVAL 1 HOUR"))).alias("open_time"))
    idle = idle.withColumns({**dict.fromkeys(PRICES, one), **dict.fromkeys(VOLUMES, none), "trade_count": F.lit(0).cast("long"), "close_time": close_time(F.col("open_time"), 3600), "source": F.lit("idle"), "source_file": F.concat(F.lit("idle-"), F.date_format(utc_date(F.col("open_time")), "yyyy-MM-dd"))})
    return dense.unionByName(idle.select(*CANDLE_COLUMNS))


def ranges_of(bars: DataFrame) -> DataFrame:
    """Each key from its first bar to the end of its last."""
    return bars.groupBy(*KEY).agg(F.min("open_time").alias("start"), add_seconds(F.max("open_time"), 3600).alias("end"))


def flat(df: DataFrame) -> DataFrame:
    """Plain columns: zone-less UTC times and joined arrays."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        out.append((F.expr(f"timestampadd(MICROSECOND, unix_micros(`{f.name}`), TIMESTAMP_NTZ '1970-01-01 00:00:00')") if kind == "timestamp" else F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if kind.startswith("array<") else c).alias(f.name))
    return df.select(*out)


BARS = f"""
px AS (SELECT event_type AS symbol, ts, event_id, {PRICE} AS price, date_trunc('hour', ts) AS open_time
       FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
bars AS (SELECT 'events' AS venue, 'spot' AS market_type, symbol, '1h' AS "interval", open_time,
       first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close,
       CAST(sum(price) AS DECIMAL(38,18)) AS base_asset_volume, open_time + INTERVAL 3599999 MILLISECOND AS close_time,
       CAST(sum(price) AS DECIMAL(38,18)) AS quote_asset_volume, count(*) AS trade_count,
       CAST(sum(CASE WHEN event_id % 2 = 1 THEN price ELSE 0 END) AS DECIMAL(38,18)) AS taker_buy_base_volume,
       CAST(sum(CASE WHEN event_id % 2 = 1 THEN price ELSE 0 END) AS DECIMAL(38,18)) AS taker_buy_quote_volume,
       'events' AS source, 'events-' || strftime(open_time, '%Y-%m-%d') AS source_file
       FROM px GROUP BY symbol, open_time)"""
DENSE = """
dense AS (SELECT venue, market_type, symbol, "interval", h AS open_time, min(open) AS open, max(high) AS high, min(low) AS low, max(close) AS close, CAST(sum(base_asset_volume) AS DECIMAL(38,18)) AS base_asset_volume,
       h + INTERVAL 3599999 MILLISECOND AS close_time, CAST(sum(quote_asset_volume) AS DECIMAL(38,18)) AS quote_asset_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
       CAST(sum(taker_buy_base_volume) AS DECIMAL(38,18)) AS taker_buy_base_volume, CAST(sum(taker_buy_quote_volume) AS DECIMAL(38,18)) AS taker_buy_quote_volume, 'events' AS source, 'dense-' || strftime(h, '%Y-%m-%d') AS source_file
       FROM (SELECT *, unnest(generate_series(open_time, open_time + INTERVAL 29 HOUR, INTERVAL 1 HOUR)) AS h FROM bars) GROUP BY venue, market_type, symbol, "interval", h)"""
SOLID = """
idle AS (SELECT venue, market_type, symbol, "interval", unnest(generate_series(a, b - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS open_time FROM (SELECT *, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) + INTERVAL 1 HOUR AS a, open_time AS b FROM dense) WHERE b > a),
solid AS (SELECT * FROM dense UNION ALL SELECT venue, market_type, symbol, "interval", open_time, 1, 1, 1, 1, 0, open_time + INTERVAL 3599999 MILLISECOND, 0, 0, 0, 0, 'idle', 'idle-' || strftime(open_time, '%Y-%m-%d') FROM idle)"""
ALTERED = """
altered AS (SELECT * REPLACE (CASE WHEN hour(open_time) = 7 THEN CAST(close + 1 AS DECIMAL(38,18)) ELSE close END AS close) FROM bars WHERE hour(open_time) % 5 <> 0
       UNION ALL SELECT * REPLACE (symbol || '-new' AS symbol) FROM bars WHERE hour(open_time) = 5)"""
SPOILT = """
spoilt AS (SELECT * REPLACE (
       CASE WHEN hour(open_time) = 3 THEN CAST(low - 1 AS DECIMAL(38,18)) ELSE high END AS high,
       CASE WHEN hour(open_time) = 4 THEN CAST(-1 AS DECIMAL(38,18)) ELSE base_asset_volume END AS base_asset_volume,
       CASE WHEN hour(open_time) = 5 THEN -1 ELSE trade_count END AS trade_count,
       CASE WHEN hour(open_time) = 6 THEN open_time ELSE close_time END AS close_time,
       CASE WHEN hour(open_time) = 8 THEN open_time + INTERVAL 1 SECOND ELSE open_time END AS open_time) FROM bars)"""
RANGES = """
ranges AS (SELECT DISTINCT venue, market_type, symbol, "interval", (SELECT date_trunc('day', min(open_time)) FROM bars) AS "start",
       (SELECT date_trunc('day', max(open_time) + INTERVAL 1 DAY) FROM bars) AS "end" FROM bars)"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([BARS, *ctes]) + "\n" + body
