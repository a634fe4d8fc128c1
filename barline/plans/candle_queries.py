"""Queries of the candle operators over bars made from the events table."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import epoch_to_timestamp, infer_ts_unit, parse_decimal
from ..functions.intervals import add_seconds, bucket, close_time, period_bounds, touched_months, utc_date, utc_hour, utc_start
from ..operators import manifest, merge, quality
from ..operators.resample import resample_complete, resample_ladder
from ..schemas import CANDLE_COLUMNS, KEY, PRICES, ROW_KEY, VOLUMES
from ..sources.archives import parse_kline_csv, parse_kline_json
from ..sources.plan import archive_plan as plan_archives
from ..sources.plan import daily_fallback as expand_days
from ..sources.plan import page_plan as plan_pages
from ..sources.staging import shared_folder
from ..sources.tables import expected_partitions, page_candles, read_candles, write_candles
from ..sources.tables import latest_run as newest_run
from ..sources.tables import partition_inventory as inventory
from ..streaming.resample import STATE_STORE, resample_early, resample_stream
from ..streaming.sync import catchup_split as split_catchup
from ..streaming.sync import sync_window as window_to_sync
from . import jobs
from .bars import ALTERED, DENSE, RANGES, SPOILT, altered, bars_1h, dense_1h, flat, instant, spoilt, sql, table, utc, whole_range

QUERIES: dict = {}
SQL: dict[str, str] = {}
_COLS = ", ".join(f'"{c}"' if c == "interval" else c for c in CANDLE_COLUMNS)
_KEYS = 'venue, market_type, symbol, "interval"'
_VALUES = "open, high, low, close, base_asset_volume, close_time, quote_asset_volume, trade_count, taker_buy_base_volume, taker_buy_quote_volume"
_ROOT = "archive"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: flat(f(spark, sf_dir))
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return register


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared directory."""
    return f"{shared_folder(spark)}/barline/{name}-{uuid.uuid4().hex}"


def _resample_sql(target: str, seconds: int) -> str:
    n = seconds // 3600
    return sql(f"""SELECT venue, market_type, symbol, '{target}' AS "interval", w AS open_time, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY open_time) AS close,
        CAST(sum(base_asset_volume) AS DECIMAL(38,18)) AS base_asset_volume, w + INTERVAL {seconds * 1000 - 1} MILLISECOND AS close_time, CAST(sum(quote_asset_volume) AS DECIMAL(38,18)) AS quote_asset_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
        CAST(sum(taker_buy_base_volume) AS DECIMAL(38,18)) AS taker_buy_base_volume, CAST(sum(taker_buy_quote_volume) AS DECIMAL(38,18)) AS taker_buy_quote_volume, 'aggregate' AS source, 'canonical:1h' AS source_file
        FROM (SELECT *, time_bucket(INTERVAL {seconds} SECOND, open_time, TIMESTAMP '1970-01-01') AS w FROM dense) GROUP BY venue, market_type, symbol, w HAVING count(*) = {n}""", DENSE)


QUERIES["bars_1h"] = lambda spark, sf_dir: flat(bars_1h(spark, sf_dir))
SQL["bars_1h"] = sql(f"SELECT {_COLS} FROM bars")


@query(_resample_sql("4h", 14400))
def resample_4h_complete(spark, sf_dir):
    return resample_complete(dense_1h(spark, sf_dir), "1h", "4h")


@query(_resample_sql("1d", 86400))
def resample_1d_complete(spark, sf_dir):
    return resample_complete(dense_1h(spark, sf_dir), "1h", "1d")


@query(_resample_sql("1d", 86400))
def resample_ladder_1d(spark, sf_dir):
    return resample_ladder(dense_1h(spark, sf_dir), ("4h", "1d"), "1h")["1d"]


_GAPS = f"""
steps AS (SELECT {_KEYS}, open_time, lag(open_time) OVER (PARTITION BY {_KEYS} ORDER BY open_time) AS prev FROM bars),
gaps AS (SELECT {_KEYS}, prev + INTERVAL 1 HOUR AS gap_start, open_time AS gap_end FROM steps WHERE open_time > prev + INTERVAL 1 HOUR)"""
_ALL_GAPS = _GAPS + f""",
edges AS (SELECT r.venue, r.market_type, r.symbol, r."interval", r."start", r."end", min(open_time) AS f, max(open_time) AS l FROM ranges r JOIN bars b ON b.symbol = r.symbol GROUP BY ALL),
all_gaps AS (SELECT * FROM gaps UNION ALL SELECT {_KEYS}, "start", f FROM edges WHERE "start" < f UNION ALL SELECT {_KEYS}, l + INTERVAL 1 HOUR, "end" FROM edges WHERE l + INTERVAL 1 HOUR < "end")"""


@query(sql("SELECT * FROM gaps", _GAPS))
def bars_gaps_interior(spark, sf_dir):
    return quality.interior_gaps(bars_1h(spark, sf_dir))


@query(sql("SELECT * FROM all_gaps", RANGES, _ALL_GAPS))
def bars_gaps_with_edges(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    return quality.find_gaps(bars, whole_range(bars))


_RULES = """
broken AS (SELECT *, list_filter([
    CASE WHEN epoch_us(open_time) % 3600000000 <> 0 THEN 'misaligned' END, CASE WHEN high < greatest(open, close, low) THEN 'high_below' END, CASE WHEN low > least(open, close) THEN 'low_above' END,
    CASE WHEN least(open, high, low, close) <= 0 THEN 'price_not_positive' END, CASE WHEN least(base_asset_volume, quote_asset_volume, taker_buy_base_volume, taker_buy_quote_volume) < 0 THEN 'volume_negative' END,
    CASE WHEN trade_count < 0 THEN 'trades_negative' END, CASE WHEN epoch_us(close_time) - epoch_us(open_time) NOT BETWEEN 3599000000 AND 3599999999 THEN 'bad_duration' END], lambda x: x IS NOT NULL) AS codes FROM spoilt)"""


@query(sql(f"SELECT {_KEYS}, open_time, unnest(codes) AS code FROM broken", SPOILT, _RULES))
def quality_violations(spark, sf_dir):
    return quality.quality_violations(spoilt(bars_1h(spark, sf_dir)))


@query(sql(f"""SELECT r.venue, r.market_type, r.symbol, r."interval", coalesce(b.rows, 0) AS rows, first_open, last_open, coalesce(bad_rows, 0) AS bad_rows, coalesce(gaps, 0) AS gaps, coalesce(bad_rows, 0) = 0 AND coalesce(gaps, 0) = 0 AS valid
    FROM ranges r LEFT JOIN (SELECT symbol, count(*) AS rows, min(open_time) AS first_open, max(open_time) AS last_open, count(*) FILTER (len(codes) > 0) AS bad_rows FROM (SELECT * FROM broken2) GROUP BY symbol) b USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) AS gaps FROM all_gaps GROUP BY symbol) g USING (symbol)""", RANGES, _ALL_GAPS, _RULES.replace("broken AS", "broken2 AS").replace("FROM spoilt", "FROM bars")))
def range_validation(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    return quality.validate_range(bars, whole_range(bars))


_TICKS = """
ticks AS (SELECT 'events' AS venue, 'spot' AS market_type, event_type AS symbol, '1m' AS "interval", date_trunc('hour', ts) AS open_time, CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,18)) AS price, event_id AS line_no FROM events)"""


def _ticks(spark, sf_dir) -> DataFrame:
    """One bar per event: hours with several events are repeated keys."""
    e = table(spark, sf_dir, "events")
    price = F.expr("CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,18))")
    start = bucket(instant("ts"), "1h")
    zero = F.lit(0).cast("decimal(38,18)")
    return e.select(
        F.lit("events").alias("venue"), F.lit("spot").alias("market_type"), F.col("event_type").alias("symbol"), F.lit("1m").alias("interval"), start.alias("open_time"),
        *[price.alias(c) for c in ("open", "high", "low", "close")], zero.alias("base_asset_volume"), F.timestamp_micros(F.unix_micros(start) + 59_999_000).alias("close_time"),
        zero.alias("quote_asset_volume"), F.lit(1).cast("bigint").alias("trade_count"), zero.alias("taker_buy_base_volume"), zero.alias("taker_buy_quote_volume"),
        F.lit("events").alias("source"), F.concat(F.lit("events-"), (F.col("event_id") % 16).cast("string")).alias("source_file"), F.col("event_id").alias("line_no"),
    )


_DUPES = f"SELECT {_KEYS}, open_time, count(*) AS copies, count(DISTINCT price) AS variants, max(line_no) AS last_row FROM ticks GROUP BY ALL HAVING count(*) > 1"


@query(sql(_DUPES, _TICKS))
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(_ticks(spark, sf_dir))


@query(sql(_DUPES + " AND count(DISTINCT price) > 1", _TICKS))
def conflicting_duplicates(spark, sf_dir):
    return quality.conflicting_duplicates(_ticks(spark, sf_dir))


@query(sql(f"SELECT {_KEYS}, open_time, last(price ORDER BY line_no) AS close, max(line_no) AS line_no FROM ticks GROUP BY ALL", _TICKS))
def collapse_duplicates(spark, sf_dir):
    return quality.collapse_duplicates(_ticks(spark, sf_dir)).select(*ROW_KEY, "close", "line_no")


@query(sql(f"""SELECT source_file, line_no, {_KEYS}, open_time, previous FROM (SELECT *, lag(open_time) OVER (PARTITION BY source_file, symbol ORDER BY line_no) AS previous
    FROM (SELECT * REPLACE (CASE WHEN line_no % 5 = 0 THEN line_no + 400 ELSE line_no END AS line_no), 'events-' || CAST(line_no % 16 AS VARCHAR) AS source_file FROM ticks)) WHERE open_time <= previous""", _TICKS))
def order_violations(spark, sf_dir):
    """Events in files where every fifth line comes 400 lines late."""
    late = F.when(F.col("line_no") % 5 == 0, F.col("line_no") + 400).otherwise(F.col("line_no"))
    return quality.order_violations(_ticks(spark, sf_dir).withColumn("line_no", late))


@query(sql("""SELECT source_file, count(*) AS rows, CASE WHEN source_file IN (SELECT source_file FROM broken WHERE len(codes) > 0) THEN 'rejected' ELSE 'valid' END AS verdict FROM broken GROUP BY source_file""", SPOILT.replace("hour(open_time) =", "dayofmonth(open_time) % 3 = 0 AND hour(open_time) ="), _RULES))
def split_by_file(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    day = F.dayofmonth(utc_date(F.col("open_time"))) % 3 == 0
    mixed = spoilt(bars.filter(day)).unionByName(bars.filter(~day)).withColumn("line_no", F.lit(0))
    valid, rejected = quality.split_by_file(mixed)
    both = valid.withColumn("verdict", F.lit("valid")).unionByName(rejected.withColumn("verdict", F.lit("rejected")))
    return both.groupBy("source_file", "verdict").agg(F.count("*").alias("rows"))


@query(sql(f"SELECT {_COLS} FROM bars UNION ALL SELECT {_COLS} FROM altered a WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = a.symbol AND b.open_time = a.open_time)", ALTERED))
def merge_insert_only(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    return bars.unionByName(merge.merge(bars, altered(bars)).inserted)


@query(sql(f"SELECT {', '.join('a.' + k.strip() for k in _KEYS.split(','))}, a.open_time FROM altered a JOIN bars b ON b.symbol = a.symbol AND b.open_time = a.open_time WHERE a.close <> b.close", ALTERED))
def merge_conflicts(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    return merge.find_conflicts(altered(bars), bars)


_DIFF = """FROM bars a FULL JOIN altered b ON a.symbol = b.symbol AND a.open_time = b.open_time"""
_DIFF_KEYS = 'coalesce(a.venue, b.venue) AS venue, coalesce(a.market_type, b.market_type) AS market_type, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a."interval", b."interval") AS "interval", coalesce(a.open_time, b.open_time) AS open_time'


@query(sql(f"SELECT {_DIFF_KEYS}, CASE WHEN a.symbol IS NULL THEN 'missing_left' WHEN b.symbol IS NULL THEN 'missing_right' ELSE 'close' END AS \"column\" {_DIFF} WHERE a.symbol IS NULL OR b.symbol IS NULL OR a.close <> b.close", ALTERED))
def cell_diff(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    return merge.cell_diff(bars, altered(bars))


@query(sql(f"SELECT {_DIFF_KEYS}, CASE WHEN b.symbol IS NULL THEN 'left_only' WHEN a.symbol IS NULL THEN 'right_only' WHEN a.close = b.close THEN 'equal' ELSE 'different' END AS status {_DIFF}", ALTERED))
def reconcile_status(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    return merge.reconcile(bars, altered(bars))


@query(sql(f"SELECT {_COLS}, 'left' AS side FROM (SELECT * FROM bars EXCEPT ALL SELECT * FROM altered) UNION ALL SELECT {_COLS}, 'right' FROM (SELECT * FROM altered EXCEPT ALL SELECT * FROM bars)", ALTERED))
def symmetric_diff(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    return merge.symmetric_diff(bars, altered(bars))


@query(sql(f"SELECT {_KEYS}, max(open_time) AS watermark FROM bars GROUP BY ALL"))
def watermark(spark, sf_dir):
    return quality.watermark(bars_1h(spark, sf_dir))


_END = """(SELECT date_trunc('day', max(open_time) + INTERVAL 1 DAY) FROM bars)"""
_WINDOW = f"""
tops AS (SELECT {_KEYS}, max(open_time) AS watermark FROM bars GROUP BY ALL),
recent AS (SELECT symbol, min(gap_start) AS first_gap FROM gaps WHERE gap_start >= {_END} - INTERVAL 7 DAY GROUP BY symbol),
todo AS (SELECT {_KEYS}, least(first_gap, watermark + INTERVAL 1 HOUR) AS "start", {_END} AS "end" FROM tops LEFT JOIN recent USING (symbol))"""


def _windows(spark, sf_dir) -> DataFrame:
    bars = bars_1h(spark, sf_dir)
    end = whole_range(bars).agg(F.unix_micros(F.max("end"))).first()[0]
    return window_to_sync(quality.watermark(bars), quality.interior_gaps(bars), F.timestamp_micros(F.lit(end)))


@query(sql('SELECT * FROM todo WHERE "start" < "end"', _GAPS, _WINDOW))
def sync_window(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(sql(f"""SELECT {_KEYS}, "start", "end" - INTERVAL 2 DAY AS "end", 'archive' AS part FROM todo WHERE "start" < "end" - INTERVAL 2 DAY
    UNION ALL SELECT {_KEYS}, greatest("start", "end" - INTERVAL 2 DAY), "end", 'pages' FROM todo WHERE "start" < "end" """, _GAPS, _WINDOW))
def catchup_split(spark, sf_dir):
    old, new = split_catchup(_windows(spark, sf_dir), days=2)
    return old.withColumn("part", F.lit("archive")).unionByName(new.withColumn("part", F.lit("pages")))


def _coverage_sql(unit: str) -> str:
    hours = "24" if unit == "day" else "24 * date_diff('day', period_start, period_start + INTERVAL 1 MONTH)"
    return sql(f"""SELECT *, rows = expected AND bad_rows = 0 AS valid FROM (SELECT {_KEYS}, date_trunc('{unit}', open_time) AS period_start, count(*) AS rows, count(DISTINCT open_time) AS distinct_rows, count(*) FILTER (len(codes) > 0) AS bad_rows, CAST({hours} AS BIGINT) AS expected FROM broken2 GROUP BY ALL)""",
               _RULES.replace("broken AS", "broken2 AS").replace("FROM spoilt", "FROM bars"))


@query(_coverage_sql("day"))
def day_coverage(spark, sf_dir):
    return quality.period_coverage(bars_1h(spark, sf_dir), "day")


@query(_coverage_sql("month"))
def month_coverage(spark, sf_dir):
    return quality.period_coverage(bars_1h(spark, sf_dir), "month")


@query(sql("SELECT source_file, count(*) AS row_count, min(open_time) AS first_open, max(open_time) AS last_open FROM bars GROUP BY source_file"))
def file_ranges(spark, sf_dir):
    return quality.file_ranges(bars_1h(spark, sf_dir))


@query(sql("""SELECT "interval", count(*) AS rows, count(DISTINCT (symbol, open_time)) AS distinct_rows FROM bars GROUP BY ALL"""))
def interval_summary(spark, sf_dir):
    return quality.interval_summary(bars_1h(spark, sf_dir))


@query(sql("""SELECT * EXCLUDE (n), n AS rows, n AS distinct_rows, CAST(0 AS BIGINT) AS bad_rows, CAST(date_diff('hour', gap_start, gap_end) AS BIGINT) AS expected, n = date_diff('hour', gap_start, gap_end) AS complete
    FROM (SELECT *, CAST(len(list_filter(generate_series(gap_start, gap_end - INTERVAL 1 HOUR, INTERVAL 1 HOUR), lambda h: hour(h) % 3 <> 0)) AS BIGINT) AS n FROM gaps)""", _GAPS))
def validate_repair(spark, sf_dir):
    """Gaps against repair rows for every hour of theirs but each third."""
    bars = bars_1h(spark, sf_dir)
    gaps = quality.interior_gaps(bars)
    hours = gaps.withColumn("open_time", F.explode(F.sequence("gap_start", F.col("gap_end") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR")))).filter(utc_hour(F.col("open_time")) % 3 != 0)
    one = F.lit(1).cast("decimal(38,18)")
    rows = hours.withColumns({**{c: one for c in (*PRICES, *VOLUMES)}, "close_time": close_time(F.col("open_time"), 3600), "trade_count": F.lit(1).cast("bigint"), "source": F.lit("rest"), "source_file": F.lit("page")})
    return quality.validate_repair(rows.select(*CANDLE_COLUMNS), gaps)


_PLAN_RANGES = """
pr AS (SELECT c_mktsegment AS symbol, '1m' AS "interval", TIMESTAMP '2023-01-01' + to_days(CAST(min(c_custkey) % 40 AS INTEGER)) AS "start", TIMESTAMP '2024-03-10 06:00:00' AS "end" FROM customer GROUP BY c_mktsegment)"""
_PLAN = _PLAN_RANGES + """,
months AS (SELECT symbol, "interval", "start", "end", unnest(generate_series(date_trunc('month', "start"), date_trunc('month', "end"), INTERVAL 1 MONTH)) AS m FROM pr),
items AS (SELECT symbol, "interval", 'monthly' AS source_type, strftime(m, '%Y-%m') AS period, m AS "start", m + INTERVAL 1 MONTH AS "end" FROM months WHERE m >= "start" AND m + INTERVAL 1 MONTH <= "end" AND m + INTERVAL 1 MONTH <= TIMESTAMP '2024-02-15'
    UNION ALL SELECT symbol, "interval", 'daily', strftime(d, '%Y-%m-%d'), greatest(d, "start"), least(d + INTERVAL 1 DAY, "end") FROM (SELECT *, unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM months WHERE NOT (m >= "start" AND m + INTERVAL 1 MONTH <= "end" AND m + INTERVAL 1 MONTH <= TIMESTAMP '2024-02-15')) WHERE d < "end" AND d + INTERVAL 1 DAY > "start"),
plan AS (SELECT symbol, "interval", source_type, period, symbol || '-' || "interval" || '-' || period || '.zip' AS file_name, 'archive/' || source_type || '/klines/' || symbol || '/' || "interval" || '/' || symbol || '-' || "interval" || '-' || period || '.zip' AS url, "start", "end" FROM items)"""
_DAYS = _PLAN + """,
days AS (SELECT file_name AS parent, symbol, "interval", 'daily' AS source_type, strftime(d, '%Y-%m-%d') AS period, symbol || '-' || "interval" || '-' || strftime(d, '%Y-%m-%d') || '.zip' AS file_name, 'archive/daily/klines/' || symbol || '/' || "interval" || '/' || symbol || '-' || "interval" || '-' || strftime(d, '%Y-%m-%d') || '.zip' AS url, d AS "start", d + INTERVAL 1 DAY AS "end"
    FROM (SELECT *, unnest(generate_series("start", "end" - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM plan WHERE source_type = 'monthly'))"""


def _plan(spark, sf_dir) -> DataFrame:
    ranges = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("symbol")).agg(utc_start(F.expr("date_add(DATE '2023-01-01', cast(min(c_custkey) % 40 AS int))")).alias("start"))
    ranges = ranges.withColumns({"interval": F.lit("1m"), "end": utc("2024-03-10 06:00:00")})
    return plan_archives(ranges, utc("2024-02-15"), _ROOT)


@query("WITH " + _PLAN + " SELECT * FROM plan")
def archive_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("WITH " + _DAYS + " SELECT * FROM days")
def daily_fallback(spark, sf_dir):
    return expand_days(_plan(spark, sf_dir), _ROOT)


@query("WITH " + _DAYS + """, have AS (SELECT file_name FROM (SELECT file_name, period FROM plan UNION SELECT file_name, period FROM days) WHERE period NOT LIKE '2023-0_' AND period NOT LIKE '2023-_1')
    SELECT symbol, "interval", source_type, period, file_name, url, "start", "end" FROM plan WHERE file_name IN (SELECT file_name FROM have)
    UNION ALL SELECT symbol, "interval", source_type, period, file_name, url, "start", "end" FROM days
    WHERE parent IN (SELECT file_name FROM plan WHERE source_type = 'monthly' AND file_name NOT IN (SELECT file_name FROM have)) AND file_name IN (SELECT file_name FROM have)""")
def missing_archives(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    days = expand_days(plan, _ROOT)
    cached = plan.select("file_name", "period").unionByName(days.select("file_name", "period")).filter("period NOT LIKE '2023-0_' AND period NOT LIKE '2023-_1'").select("file_name")
    return manifest.missing_archives(plan, cached, days)


@query("WITH " + _DAYS + """ SELECT d.url AS child, p.url AS parent, CAST(1 AS BIGINT) AS parents, FALSE AS conflict FROM days d JOIN plan p ON p.file_name = d.parent""")
def fallback_parents(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    items = plan.unionByName(expand_days(plan, _ROOT).drop("parent")).withColumnRenamed("url", "source_url")
    return manifest.link_fallback_parents(items.dropDuplicates(["source_url"])).filter("parent LIKE '%/monthly/%'")


@query(sql(f"""SELECT {_KEYS}, gap_start, gap_end, p AS page_start, least(p + INTERVAL 4 HOUR, gap_end) AS page_end FROM (SELECT *, unnest(generate_series(gap_start, gap_end - INTERVAL 1 MICROSECOND, INTERVAL 4 HOUR)) AS p FROM gaps WHERE gap_end - gap_start <= INTERVAL 7 DAY)""", _GAPS))
def page_plan(spark, sf_dir):
    pages, _ = plan_pages(quality.interior_gaps(bars_1h(spark, sf_dir)), F.lit(3600), limit=4)
    return pages


@query("""WITH raw AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN 42 WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) END AS raw FROM events),
    b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events)
    SELECT event_id, raw, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'ms' ELSE 'us' END AS unit, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN make_timestamp(raw * 1000) ELSE make_timestamp(raw) END AS at FROM raw""")
def ts_unit_inference(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", instant("ts"))
    ends = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    raw = F.when(F.col("event_id") % 11 == 0, F.lit(42).cast("bigint")).when(F.col("event_id") % 2 == 0, F.unix_millis("t")).otherwise(F.unix_micros("t"))
    unit = infer_ts_unit(F.col("raw"), F.col("lo"), F.col("hi"))
    lo, hi = (F.timestamp_micros(F.lit(x)) for x in ends.agg(F.unix_micros(F.min("lo")), F.unix_micros(F.max("hi"))).first())
    rows = e.select("event_id", raw.alias("raw")).withColumns({"lo": lo, "hi": hi})
    return rows.select("event_id", "raw", unit.alias("unit"), epoch_to_timestamp(F.col("raw"), unit).alias("at"))


@query("""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS DECIMAL(38,18)) AS value FROM events""")
def strict_decimals(spark, sf_dir):
    """Plain decimals parse; blanks, exponents and over-long fractions do not."""
    e = table(spark, sf_dir, "events")
    text = F.col("value").cast("decimal(18,2)").cast("string")
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.concat(F.lit(" "), text)).when(kind == 1, F.lit("1e2")).when(kind == 2, F.lit("1.1234567890123456785")).otherwise(text)
    return e.select("event_id", parse_decimal(raw).alias("value"))


@query(sql("""SELECT symbol, open_time, time_bucket(INTERVAL 4 HOUR, open_time, TIMESTAMP '1970-01-01') AS bucket FROM bars"""))
def tumbling_bucket(spark, sf_dir):
    return bars_1h(spark, sf_dir).withColumn("bucket", bucket(F.col("open_time"), "4h")).select("symbol", "open_time", F.col("bucket").cast("timestamp").alias("bucket"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS period, date_trunc('day', o_orderdate) AS "start", date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS "end" FROM orders
    UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m'), date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 1 MONTH FROM orders
    UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y/%m'), NULL, NULL FROM orders""")
def period_bounds_of_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.select("o_orderkey", F.explode(F.array(*[F.date_format("o_orderdate", x) for x in ("yyyy-MM-dd", "yyyy-MM", "yyyy/MM")])).alias("period"))
    b = period_bounds(F.col("period"))
    return p.select("o_orderkey", "period", b["start"].alias("start"), b["end"].alias("end"))


@query(sql("""SELECT symbol, m AS month FROM (SELECT symbol, unnest(generate_series(date_trunc('month', min(open_time)), date_trunc('month', max(open_time)), INTERVAL 1 MONTH)) AS m FROM bars GROUP BY symbol)"""))
def touched_months_of_bars(spark, sf_dir):
    ends = bars_1h(spark, sf_dir).groupBy("symbol").agg(F.min("open_time").alias("start"), F.timestamp_micros(F.unix_micros(F.max("open_time")) + 1).alias("end"))
    return touched_months(ends).select("symbol", "month")


_MANIFEST = """
mf AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period, CASE WHEN month(o_orderdate) % 3 = 0 THEN 'failed' WHEN month(o_orderdate) % 3 = 1 THEN 'fallback_pending' ELSE 'validated' END AS status FROM orders)"""


def _manifest(spark, sf_dir) -> DataFrame:
    m = F.month("o_orderdate") % 3
    status = F.when(m == 0, "failed").when(m == 1, "fallback_pending").otherwise("validated")
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), status.alias("status")).distinct()


_T0, _T1 = "1995-02-10", "1996-07-01"


@query("WITH " + _MANIFEST + f" SELECT period, status FROM mf WHERE CAST(period || '-01' AS TIMESTAMP) < TIMESTAMP '{_T1}' AND CAST(period || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH > TIMESTAMP '{_T0}'")
def overlapping_periods(spark, sf_dir):
    return manifest.overlapping_periods(_manifest(spark, sf_dir), utc(_T0), utc(_T1))


@query(sql(f"""SELECT (SELECT count(*) FROM bars) AS rows, (SELECT min(open_time) FROM bars) AS first_open, (SELECT max(open_time) FROM bars) AS last_open, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'fallback_pending') AS pending FROM mf WHERE CAST(period || '-01' AS TIMESTAMP) < TIMESTAMP '2100-01-01'""", _MANIFEST))
def status_summary(spark, sf_dir):
    minutes = bars_1h(spark, sf_dir).withColumn("interval", F.lit("1m"))
    return manifest.status_summary(minutes, _manifest(spark, sf_dir), utc("1900-01-01"), utc("2100-01-01"))


_STATES = """
st AS (SELECT user_id AS id, ts, event_id, ['planned', 'downloading', 'downloaded', 'checksum_verified', 'imported', 'failed'][1 + CAST(event_id % 6 AS INTEGER)] AS status, CASE WHEN event_id % 6 = 5 THEN 'e' || CAST(event_id AS VARCHAR) END AS error_message FROM events)"""


def _states(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("planned", "downloading", "downloaded", "checksum_verified", "imported", "failed")])
    status = F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))
    error = F.when(F.col("event_id") % 6 == 5, F.concat(F.lit("e"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", status.alias("status"), error.alias("error_message"))


_MOVES = ", ".join(f"('{a}', '{b}')" for a, b in manifest.ARCHIVE_MOVES)


@query("WITH " + _STATES + f" SELECT previous, status, id, ts, event_id, error_message FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY ts, event_id) AS previous FROM st) WHERE previous IS NOT NULL AND (previous, status) NOT IN ({_MOVES})")
def illegal_transitions(spark, sf_dir):
    return manifest.illegal_transitions(_states(spark, sf_dir), manifest.ARCHIVE_MOVES, "id", ["ts", "event_id"])


@query("WITH " + _STATES + """, again AS (SELECT id, max((ts, event_id)) FILTER (status = 'downloading') AS a FROM st GROUP BY id)
    SELECT st.id, last(status ORDER BY ts, event_id) AS status, count(*) AS events, count(*) FILTER (status = 'downloading') AS attempts, count(*) FILTER (status = 'failed') AS failures,
    last(error_message ORDER BY ts, event_id) FILTER (error_message IS NOT NULL AND (a IS NULL OR (ts, event_id) >= a)) AS error_message FROM st JOIN again USING (id) GROUP BY st.id""")
def state_fold(spark, sf_dir):
    return manifest.fold_states(_states(spark, sf_dir), "id", ["ts", "event_id"])


@query("""SELECT o_orderkey AS id, 'v' AS venue, 's' AS market_type, o_orderpriority AS symbol, '1m' AS "interval", o_orderdate AS started_at, next_started, 'interrupted' AS status FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS next_started FROM orders) WHERE o_orderstatus = 'O' AND next_started IS NOT NULL""")
def interrupted_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("v").alias("venue"), F.lit("s").alias("market_type"), F.col("o_orderpriority").alias("symbol"), F.lit("1m").alias("interval"), instant("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "O", instant("o_orderdate")).alias("finished_at"))
    return manifest.interrupted_runs(runs).drop("finished_at")


_KLINE = "SELECT symbol, open_time, open, close, trade_count, close_time FROM bars"


def _constants() -> dict:
    return {"venue": F.lit("events"), "market_type": F.lit("spot"), "symbol": F.element_at(F.split("source_file", "/"), 1), "interval": F.lit("1h")}


def _kline_fields(bars: DataFrame) -> list:
    return [F.unix_millis("open_time").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "base_asset_volume")], F.unix_millis("close_time").cast("string"), F.col("quote_asset_volume").cast("string"), F.col("trade_count").cast("string"), F.col("taker_buy_base_volume").cast("string"), F.col("taker_buy_quote_volume").cast("string"), F.lit("0")]


@query(sql(_KLINE))
def kline_csv_roundtrip(spark, sf_dir):
    """Bars written as kline text and parsed again."""
    bars = bars_1h(spark, sf_dir)
    lines = bars.select(F.concat("symbol", F.lit("/x")).alias("source_file"), F.lit(1).cast("bigint").alias("line_no"), F.concat_ws(",", *_kline_fields(bars)).alias("line"))
    ends = [F.timestamp_micros(F.lit(x)) for x in bars.agg(F.unix_micros(F.min("open_time")), F.unix_micros(F.max("open_time"))).first()]
    return parse_kline_csv(lines, ends[0], ends[1], _constants()).filter("size(errors) = 0").select("symbol", "open_time", "open", "close", "trade_count", "close_time")


@query(sql(_KLINE))
def kline_json_roundtrip(spark, sf_dir):
    """Bars packed into one JSON page per day and parsed again."""
    bars = bars_1h(spark, sf_dir)
    rows = bars.select(F.concat("symbol", F.lit("/"), F.date_format(utc_date(F.col("open_time")), "yyyy-MM-dd")).alias("source_file"), F.array(*_kline_fields(bars)).alias("k"))
    pages = rows.groupBy("source_file").agg(F.to_json(F.collect_list("k")).alias("body"))  # at most 24 bars a page
    ends = [F.timestamp_micros(F.lit(x)) for x in bars.agg(F.unix_micros(F.min("open_time")), F.unix_micros(F.max("open_time"))).first()]
    return parse_kline_json(pages, ends[0], ends[1], _constants()).filter("size(errors) = 0").select("symbol", "open_time", "open", "close", "trade_count", "close_time")


@query(sql(f"SELECT {_COLS} FROM bars"))
def stored_roundtrip(spark, sf_dir):
    """Bars written as month partitions and read back."""
    root = shared(spark, "bars")
    write_candles(bars_1h(spark, sf_dir), root)
    return read_candles(spark, root).select(*CANDLE_COLUMNS)


@query(sql("""SELECT 'venue=events/market_type=spot/symbol=' || symbol || '/interval=1h/year=' || strftime(m, '%Y') || '/month=' || strftime(m, '%m') AS "partition", CASE WHEN EXISTS (SELECT 1 FROM bars b WHERE b.symbol = r.symbol AND date_trunc('month', b.open_time) = m) THEN 'ok' ELSE 'missing' END AS status,
    CAST(EXISTS (SELECT 1 FROM bars b WHERE b.symbol = r.symbol AND date_trunc('month', b.open_time) = m) AS BIGINT) AS files FROM (SELECT symbol, unnest(generate_series(date_trunc('month', "start"), date_trunc('month', "end" + INTERVAL 1 MONTH), INTERVAL 1 MONTH)) AS m FROM ranges) r""", RANGES))
def partition_inventory(spark, sf_dir):
    """Partitions of the stored bars against the months around them and one more."""
    root = shared(spark, "bars")
    bars = bars_1h(spark, sf_dir)
    write_candles(bars, root)
    ranges = whole_range(bars).withColumn("end", utc_start(F.date_add(F.trunc(F.add_months(utc_date(F.col("end")), 1), "month"), 1)))
    months = touched_months(ranges).select(*KEY, "month")
    return inventory(spark, root, expected_partitions(ranges.select(*KEY).distinct(), months))


@query(_resample_sql("4h", 14400))
def stream_resample(spark, sf_dir):
    """The 4-hour bars again, from a stream over the stored hourly bars; a last far-off bar closes
    the windows and stays out of the result."""
    root = shared(spark, "stream")
    bars = dense_1h(spark, sf_dir)
    end = bars.filter(F.col("symbol") == bars.agg(F.min("symbol")).first()[0]).limit(1).withColumn("open_time", utc("2200-01-01"))
    bars.write.parquet(f"{root}/in")
    end.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1000).parquet(f"{root}/in")
    query = resample_stream(stream, "1h", "4h").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{root}/out").filter(F.col("open_time") < utc("2199-01-01"))


@query(_resample_sql("4h", 14400))
def stream_resample_early(spark, sf_dir):
    """The 4-hour bars once more, from a stream that no later bar closes: each comes with its last child,
    long before the watermark (seven days behind) passes it."""
    root = shared(spark, "early")
    bars = dense_1h(spark, sf_dir)
    bars.write.parquet(f"{root}/in")
    session = spark.newSession()
    session.conf.set(*STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = session.readStream.schema(bars.schema).parquet(f"{root}/in")
    query = resample_early(stream, "1h", "4h").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{root}/out")


_MIDDLE = "(SELECT min(open_time) + (max(open_time) - min(open_time)) / 2 FROM bars)"


def _middle(bars: DataFrame):
    ends = bars.agg((F.unix_micros(F.min("open_time")) + F.unix_micros(F.max("open_time"))) / 2).first()[0]
    return F.timestamp_micros(F.lit(int(ends)))


@query(sql(f"SELECT {_COLS} FROM bars WHERE symbol = 'click' AND open_time >= {_MIDDLE} AND open_time < {_MIDDLE} + INTERVAL 3 DAY"))
def scope_of_one_symbol(spark, sf_dir):
    """Bars of one key in three days from the middle of the range."""
    bars = bars_1h(spark, sf_dir)
    start = _middle(bars)
    return quality.in_scope(bars, {"symbol": "click"}, start, start + F.expr("INTERVAL 3 DAY"))


@query(sql(f"SELECT {_COLS} FROM bars WHERE symbol = 'click' AND open_time > {_MIDDLE} ORDER BY open_time LIMIT 100"))
def page_of_one_symbol(spark, sf_dir):
    """The first 100 bars of one key after the middle of the range."""
    bars = bars_1h(spark, sf_dir)
    return page_candles(bars.filter("symbol = 'click'"), _middle(bars), 100)


@query(sql(f"SELECT {_KEYS}, gap_start, gap_end, gap_end - gap_start <= INTERVAL 1 DAY AS repairable FROM (SELECT {_KEYS}, gap_start, CASE WHEN hour(gap_start) % 2 = 0 THEN gap_end + INTERVAL 1 DAY ELSE gap_end END AS gap_end FROM gaps)", _GAPS))
def repairable_gaps(spark, sf_dir):
    """Gaps against a one-day limit, those that start in even hours made a day longer."""
    gaps = quality.interior_gaps(bars_1h(spark, sf_dir))
    gaps = gaps.withColumn("gap_end", F.when(utc_hour(F.col("gap_start")) % 2 == 0, F.col("gap_end") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("gap_end")))
    ok, refused = quality.split_repairable(gaps, most_days=1)
    return ok.withColumn("repairable", F.lit(True)).unionByName(refused.withColumn("repairable", F.lit(False)))


@query("""SELECT event_type, last(event_id ORDER BY ts, event_id) AS event_id, last(user_id ORDER BY ts, event_id) AS user_id FROM events GROUP BY event_type""")
def latest_run(spark, sf_dir):
    """The newest record of each event type, as of a run log."""
    e = table(spark, sf_dir, "events").select("event_type", F.struct("ts", "event_id").alias("observed_at"), "event_id", "user_id")
    return newest_run(e, ["event_type"]).select("event_type", "event_id", "user_id")


@query(sql("""SELECT "interval", status, count(*) AS bars FROM (SELECT '1h' AS "interval", CASE WHEN b.symbol IS NULL THEN 'left_only' WHEN a.symbol IS NULL THEN 'right_only' WHEN a.close = b.close THEN 'equal' ELSE 'different' END AS status FROM bars a FULL JOIN altered b ON a.symbol = b.symbol AND a.open_time = b.open_time) GROUP BY ALL""", ALTERED))
def compare_published(spark, sf_dir):
    bars = bars_1h(spark, sf_dir)
    return jobs.compare_published(bars, altered(bars))
