"""Queries of the end-to-end jobs over bars made from the events table."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import add_seconds, utc_date, utc_hour
from ..operators import manifest, merge
from ..schemas import CANDLE, CANDLE_COLUMNS, KEY, PRICES
from ..sources.archives import archive_lines, parse_kline_csv, verify_checksums
from ..sources.tables import read_candles, write_candles
from ..sources.summaries import read_summary, stored_bars, stored_gaps
from ..streaming.runs import read_runs, run_events
from ..streaming.sync import GapsRemain, sync
from . import jobs
from .bars import ALTERED, DENSE, SOLID, altered, bars_1h, dense_1h, flat, ranges_of, solid_1h, sql
from .candle_queries import _COLS, _KEYS, _kline_fields, shared

QUERIES: dict = {}
SQL: dict[str, str] = {}
_YEARS = (datetime(2000, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc))


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: flat(f(spark, sf_dir))
        SQL[f.__name__] = oracle
        return f

    return register


def landed(bars: DataFrame, comment: str = "") -> tuple[DataFrame, DataFrame]:
    """The bars as landed zip archives (path, content), one for each symbol and UTC month, with a header and a
    comment, and their checksum files (path, value)."""
    name = F.concat_ws("-", "symbol", "interval", F.date_format(utc_date(F.col("open_time")), "yyyy-MM"))
    lines = bars.select(name.alias("name"), "open_time", F.concat_ws(",", *_kline_fields(bars)).alias("line"))
    texts = lines.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("open_time", "line"))).alias("x"))  # at most a month of hours
    header = F.lit("open_time,open,high,low,close,volume,close_time,quote,count,buy_base,buy_quote,ignore")
    texts = texts.select("name", F.concat_ws("\n", header, F.array_join(F.col("x.line"), "\n")).alias("text"))

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr(zipfile.ZipInfo(name + ".csv"), text)
                    z.comment = comment.encode()
                content.append(raw.getvalue())
            paths = [f"landed/{x}.zip" for x in batch.column(0).to_pylist()]
            sums = [hashlib.sha256(x).hexdigest() for x in content]
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(content, pa.binary()), pa.array(sums, pa.string())], names=["path", "content", "sum"])

    files = texts.mapInArrow(zipped, "path string, content binary, sum string")
    return files.select("path", "content"), files.select(F.concat("path", F.lit(".sha256")).alias("path"), F.concat_ws("  ", "sum", F.lit("file")).alias("value"))


def constants() -> dict:
    return {"venue": F.lit("events"), "market_type": F.lit("spot"), "symbol": F.split("source_file", "-")[0], "interval": F.lit("1h")}


#: What breaks a rule in bars made from events: their prices are values, their volumes sums of values.
_BROKEN = "(least(open, high, low, close) <= 0 OR least(base_asset_volume, quote_asset_volume, taker_buy_base_volume, taker_buy_quote_volume) < 0)"
_FILE = "symbol || '-1h-' || strftime(open_time, '%Y-%m') || '.zip'"
_PLAIN = "symbol, open_time, open, high, low, close, trade_count, close_time"


@query(sql(f"SELECT {_PLAIN}, {_FILE} AS source_file FROM bars"))
def archive_roundtrip(spark, sf_dir):
    """Bars as landed archives: checksums verified, unpacked, parsed."""
    files, sums = landed(bars_1h(spark, sf_dir))
    passed = verify_checksums(files, sums).filter("outcome = 'pass'").select("file_name")
    lines = archive_lines(files.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).join(passed, "file_name", "left_semi"))
    bars = parse_kline_csv(lines, F.lit(_YEARS[0]), F.lit(_YEARS[1]), constants()).filter("size(errors) = 0")
    return bars.select(*_PLAIN.split(", "), "source_file")


def _import(spark, sf_dir):
    """An import in which errors' files have a wrong checksum, views' a bad price and clicks' a broken rule.
    Files of the others are refused where a bar of the events itself breaks a rule."""
    bars = bars_1h(spark, sf_dir)
    low = F.when((F.col("symbol") == "click") & (utc_hour(F.col("open_time")) == 7), F.col("high") + 1).otherwise(F.col("low")).cast("decimal(38,18)")
    files, sums = landed(bars.withColumn("low", low))
    bad = F.when(F.col("path").contains("/error-"), F.lit("0" * 64)).otherwise(F.col("value"))
    spoilt = bars.filter("symbol = 'view'").withColumn("source_file", F.concat_ws("-", "symbol", "interval", F.date_format(utc_date(F.col("open_time")), "yyyy-MM")))
    first = spoilt.groupBy("source_file").agg(F.min("open_time").alias("open_time")).select(F.concat("source_file", F.lit(".zip")).alias("file_name"))

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for raw in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    entry = z.namelist()[0]
                    text = z.read(entry).decode()
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(zipfile.ZipInfo(entry), text + "\n1704067200000,1e2,1,1,1,1,1704070799999,1,1,1,1,0")
                content.append(out.getvalue())
            sums = [hashlib.sha256(x).hexdigest() for x in content]
            yield pa.record_batch([batch.column("path"), pa.array(content, pa.binary()), pa.array(sums, pa.string())], names=["path", "content", "sum"])

    views = files.filter(F.col("path").contains("/view-")).mapInArrow(broken, "path string, content binary, sum string")
    files = files.filter(~F.col("path").contains("/view-")).unionByName(views.select("path", "content"))
    sums = sums.filter(~F.col("path").contains("/view-")).withColumn("value", bad).unionByName(views.select(F.concat("path", F.lit(".sha256")).alias("path"), F.col("sum").alias("value")))
    return jobs.import_files(files, sums, spark.createDataFrame([], CANDLE), *_YEARS, constants(), shared(spark, "import"))


_GOOD = f"""
files AS (SELECT *, {_FILE} AS file FROM bars),
wrong AS (SELECT DISTINCT file, CASE WHEN symbol = 'error' THEN 'checksum mismatch' WHEN symbol = 'view' THEN 'bad fields: open' ELSE 'broken rule or repeated key' END AS reason FROM files
    WHERE symbol IN ('error', 'view') OR (symbol = 'click' AND hour(open_time) = 7) OR {_BROKEN})"""


@query(sql(f"SELECT {_PLAIN}, file AS source_file FROM files WHERE file NOT IN (SELECT file FROM wrong)", _GOOD))
def import_job(spark, sf_dir):
    return _import(spark, sf_dir)[0].select(*_PLAIN.split(", "), "source_file")


@query(sql("SELECT file AS source_file, reason FROM wrong", _GOOD))
def import_refusals(spark, sf_dir):
    return _import(spark, sf_dir)[1]


@query(sql("""SELECT file AS file_name, CASE WHEN reason LIKE 'checksum%' THEN 'failed' ELSE 'checksum_verified' END AS status, CASE WHEN reason LIKE 'checksum%' THEN reason END AS error_message, 1 AS step FROM (SELECT DISTINCT file FROM files) LEFT JOIN wrong USING (file)
    UNION ALL SELECT file, CASE WHEN reason IS NULL THEN 'imported' ELSE 'failed' END, reason, 2 FROM (SELECT DISTINCT file FROM files) LEFT JOIN wrong USING (file) WHERE reason IS NULL OR reason NOT LIKE 'checksum%'""", _GOOD))
def import_events(spark, sf_dir):
    return _import(spark, sf_dir)[3].drop("observed_at")


@query(sql("""SELECT source_file, count(*) AS row_count, min(open_time) AS first_open, max(open_time) AS last_open FROM (SELECT file AS source_file, open_time FROM files WHERE file NOT IN (SELECT file FROM wrong)) GROUP BY source_file""", _GOOD))
def import_ranges(spark, sf_dir):
    return _import(spark, sf_dir)[2]


def land(files: DataFrame, sums: DataFrame, folder: str) -> None:
    """Write archives and their checksum files to a folder, each in the task that holds it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("/") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with store.open_output_stream(f"{base}/{path.rsplit('/', 1)[-1]}") as out:
                    out.write(content)
            yield pa.record_batch([pa.array([len(batch)])], names=["files"])

    both = files.unionByName(sums.select("path", F.encode("value", "UTF-8").alias("content")))
    both.mapInArrow(write, "files long").agg(F.sum("files")).collect()


@query(sql("""SELECT run, CASE run WHEN 1 THEN count(*) WHEN 2 THEN count(*) FILTER (refused) ELSE count(*) FILTER (refused OR symbol = 'click') END AS files_read, CAST(coalesce(sum(n) FILTER (NOT refused), 0) AS BIGINT) AS bars FROM files, (VALUES (1), (2), (3)) AS t(run) GROUP BY run""", f"""
files AS (SELECT symbol, {_FILE} AS file, count(*) AS n, bool_or({_BROKEN}) AS refused FROM bars GROUP BY ALL)"""))
def import_again(spark, sf_dir):
    """The bars as archives in a folder, imported three times by the manifest: at first all files are read, then
    none, then those whose archive and checksum file have changed (the same bars, packed anew). Files that were
    refused for a broken bar are read every time."""
    folder, log, work = shared(spark, "landed"), shared(spark, "manifest"), shared(spark, "import")
    bars = jobs.stage(bars_1h(spark, sf_dir), work)
    land(*landed(bars), folder)
    merged, rows = spark.createDataFrame([], CANDLE), []
    for run in (1, 2, 3):
        if run == 3:
            land(*landed(bars.filter("symbol = 'click'"), comment="packed anew"), folder)
        merged, _, paths = jobs.import_by_manifest(spark, folder, merged, *_YEARS, constants(), work, log)
        merged = jobs.stage(merged, work)
        rows.append((run, len(paths), merged.count()))
    return spark.createDataFrame(rows, "run int, files_read long, bars long")


_HOLED = f"""
holed AS (SELECT * FROM dense WHERE hour(open_time) % 5 <> 0),
steps AS (SELECT {_KEYS}, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS prev FROM holed),
gaps AS (SELECT {_KEYS}, prev + INTERVAL 1 HOUR AS gap_start, open_time AS gap_end FROM steps WHERE open_time > prev + INTERVAL 1 HOUR AND open_time - prev <= INTERVAL 7 DAY),
pages AS (SELECT * FROM dense WHERE hour(open_time) % 5 = 0 AND hour(open_time) % 10 <> 0),
filled AS (SELECT g.symbol, g.gap_start, g.gap_end FROM gaps g JOIN pages p ON p.symbol = g.symbol AND p.open_time >= g.gap_start AND p.open_time < g.gap_end GROUP BY ALL HAVING count(*) = date_diff('hour', g.gap_start, g.gap_end) AND NOT bool_or({_BROKEN}))"""


@query(sql(f"SELECT {_COLS} FROM holed UNION ALL SELECT {', '.join('p.' + c.strip() for c in _COLS.split(','))} FROM pages p JOIN filled f ON p.symbol = f.symbol AND p.open_time >= f.gap_start AND p.open_time < f.gap_end", DENSE, _HOLED))
def repair_job(spark, sf_dir):
    """Dense bars without every fifth hour, filled from pages that have every other one of those; a page with a broken bar fills nothing."""
    dense = dense_1h(spark, sf_dir)
    hour = utc_hour(F.col("open_time"))
    held = dense.filter(hour % 5 != 0)
    ranges = held.groupBy(*KEY).agg(F.min("open_time").alias("start"), add_seconds(F.max("open_time"), 3600).alias("end"))
    return jobs.repair_from_pages(held, dense.filter((hour % 5 == 0) & (hour % 10 != 0)), ranges)[0]


def _rolled(source: str) -> str:
    parts = [f"""SELECT symbol, '{name}' AS "interval", w AS open_time, min(low) AS low, max(high) AS high, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM (SELECT *, time_bucket(INTERVAL {n} HOUR, open_time, TIMESTAMP '1970-01-01') AS w FROM {source}) GROUP BY symbol, w HAVING count(*) = {n}""" for name, n in (("4h", 4), ("1d", 24))]
    return " UNION ALL ".join([f"""SELECT symbol, "interval", open_time, low, high, trade_count FROM {source}""", *parts])


@query(sql(_rolled("dense"), DENSE))
def aggregate_job(spark, sf_dir):
    dense = dense_1h(spark, sf_dir)
    return jobs.resample_months(dense, dense, shared(spark, "rolled"), ("4h", "1d"), "1h").select("symbol", "interval", "open_time", "low", "high", "trade_count")


def raised(bars: DataFrame, by: int) -> DataFrame:
    """The bars with all prices higher by `by`: an event may have the value 0, a bar no price of 0."""
    return bars.withColumns({c: (F.col(c) + by).cast("decimal(38,18)") for c in PRICES})


@query(sql(f"SELECT {_COLS} FROM solid", DENSE, SOLID))
def export_job(spark, sf_dir):
    """Gap-free bars, validated, exported and read back. They are stored with prices one above the events'
    values, since an export refuses prices that are not positive."""
    root = shared(spark, "export")
    bars = jobs.stage(raised(solid_1h(spark, sf_dir), 1), shared(spark, "solid"))
    jobs.export(spark, bars, ranges_of(bars), root)
    return raised(read_candles(spark, root), -1).select(*CANDLE_COLUMNS)


@query(sql(_rolled("solid"), DENSE, SOLID))
def full_build(spark, sf_dir):
    """Archives without every seventh hour, pages with those: import, repair, roll up, export. Prices stand one
    above the events' values in all of them, as in export_job."""
    root = shared(spark, "build")
    bars = jobs.stage(raised(solid_1h(spark, sf_dir), 1), shared(spark, "solid"))
    gone = utc_hour(F.col("open_time")) % 7 == 0
    files, sums = landed(bars.filter(~gone))
    jobs.full_build(files, sums, bars.filter(gone), ranges_of(bars), *_YEARS, constants(), root, shared(spark, "work"), ("4h", "1d"), "1h")
    return raised(read_candles(spark, root), -1).select("symbol", "interval", "open_time", "low", "high", "trade_count")


class Killed(BaseException):
    """Stands for a process that dies: no handler of errors sees it."""


#: The six syncs are looked at by several queries; a session runs them once for each input.
_DONE: dict[tuple[str, str], tuple[str, str]] = {}


def _syncs(spark, sf_dir) -> tuple[str, str]:
    """(table, run log) after six syncs of the dense bars: the first twelve hours; the same again; all the rest in a
    batch that contradicts itself, in one with broken rows, in one whose process dies before the
    months are written; and then whole. The last one finds gaps that nothing fills. A sync is refused where bars of
    the events themselves break a rule in its work range."""
    made = (spark.sparkContext.applicationId, sf_dir)
    if made in _DONE:
        return _DONE[made]
    root, log = shared(spark, "sync"), shared(spark, "sync-log")
    bars = jobs.stage(dense_1h(spark, sf_dir), log)
    keys = bars.groupBy(*KEY).agg(F.min("open_time").alias("start"))
    first, last = bars.agg(F.unix_micros(F.min("open_time")), F.unix_micros(F.max("open_time"))).first()
    noon, end = (datetime.fromtimestamp(at / 1_000_000 + h * 3600, timezone.utc) for at, h in ((first, 12), (last, 1)))
    twice = bars.unionByName(bars.withColumn("trade_count", F.col("trade_count") + 1))
    broken = bars.withColumn("low", F.col("high") + 1).withColumn("low", F.col("low").cast("decimal(38,18)"))

    def dies(stage: str) -> None:
        if stage == "export":
            raise Killed

    for batch, until, on_stage in ((bars, noon, None), (bars, noon, None), (twice, end, None), (broken, end, None), (bars, end, dies), (bars, end, None)):
        try:
            sync(spark, batch, keys, root, log, until, levels=("4h", "1d"), base="1h", on_stage=on_stage)
        except (ValueError, GapsRemain, Killed):
            pass  # the records tell
    _DONE[made] = root, log
    return root, log


_SYNCS = f"""
ends AS (SELECT min(open_time) + INTERVAL 12 HOUR AS noon, max(open_time) + INTERVAL 1 HOUR AS stop FROM dense),
late AS (SELECT dense.* FROM dense, ends WHERE open_time >= noon),
steps AS (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS prev FROM dense),
left_open AS (SELECT (SELECT count(*) FROM steps WHERE open_time > prev + INTERVAL 1 HOUR) + (SELECT count(*) FROM (SELECT max(open_time) AS m FROM dense GROUP BY symbol), ends WHERE m + INTERVAL 1 HOUR < stop) AS gaps),
early AS (SELECT dense.* FROM dense, ends WHERE open_time < noon),
faults AS (SELECT first_bad, first_bad OR rest_bad AS bad FROM (SELECT coalesce(bool_or({_BROKEN}), FALSE) AS first_bad FROM early), (SELECT coalesce(bool_or({_BROKEN}), FALSE) AS rest_bad FROM late)),
rest AS (SELECT CASE WHEN first_bad THEN (SELECT count(*) FROM dense) ELSE (SELECT count(*) FROM late) END AS n FROM faults),
kept AS (SELECT dense.* FROM dense, ends, faults WHERE NOT first_bad AND (NOT bad OR open_time < noon)),
rolled AS ({_rolled("kept")}),
starts AS (SELECT symbol, greatest(min(open_time), noon) AS s FROM dense, ends GROUP BY symbol, noon),
held AS (SELECT count(DISTINCT ("interval", symbol, date_trunc('month', open_time))) AS parts FROM rolled JOIN starts USING (symbol) WHERE date_trunc('month', open_time) >= date_trunc('month', s))"""


@query(sql("""SELECT 1 AS run, CASE WHEN first_bad THEN 'failed' ELSE 'succeeded' END AS status, n AS rows_fetched, CASE WHEN first_bad THEN 0 ELSE n END AS rows_inserted, CAST(0 AS BIGINT) AS rows_repaired, CAST(0 AS BIGINT) AS gaps_remaining, CASE WHEN first_bad THEN 0 ELSE verified END AS partitions_verified, CASE WHEN first_bad THEN 'BadRowsError' END AS error
    FROM faults, (SELECT count(*) AS n, count(DISTINCT symbol || strftime(open_time, '%Y-%m')) + count(DISTINCT CASE WHEN whole4 THEN symbol || strftime(open_time, '%Y-%m') END) AS verified FROM (SELECT *, count(*) OVER (PARTITION BY symbol, time_bucket(INTERVAL 4 HOUR, open_time, TIMESTAMP '1970-01-01')) = 4 AS whole4 FROM early))
    UNION ALL SELECT 2, CASE WHEN first_bad THEN 'failed' ELSE 'noop' END, CASE WHEN first_bad THEN (SELECT count(*) FROM early) ELSE 0 END, 0, 0, 0, 0, CASE WHEN first_bad THEN 'BadRowsError' END FROM faults
    UNION ALL SELECT 3, 'failed', 2 * n, 0, 0, 0, 0, CASE WHEN bad THEN 'BadRowsError' ELSE 'ConflictError' END FROM faults, rest
    UNION ALL SELECT 4, 'failed', n, 0, 0, 0, 0, 'BadRowsError' FROM rest
    UNION ALL SELECT 5, CASE WHEN bad THEN 'failed' ELSE 'interrupted' END, n, CASE WHEN bad THEN 0 ELSE n END, 0, CASE WHEN bad THEN 0 ELSE gaps END, 0, CASE WHEN bad THEN 'BadRowsError' END FROM faults, rest, left_open
    UNION ALL SELECT 6, CASE WHEN bad OR gaps > 0 THEN 'failed' ELSE 'succeeded' END, n, CASE WHEN bad THEN 0 ELSE n END, 0, CASE WHEN bad THEN 0 ELSE gaps END, CASE WHEN bad THEN 0 ELSE parts END, CASE WHEN bad THEN 'BadRowsError' WHEN gaps > 0 THEN 'GapsRemain' END FROM faults, rest, left_open, held""", DENSE, _SYNCS))
def sync_runs(spark, sf_dir):
    """The folded record of each of the six syncs."""
    runs = read_runs(spark, _syncs(spark, sf_dir)[1]).orderBy("started_at").collect()
    rows = [(i + 1, r.status, r.rows_fetched, r.rows_inserted, r.rows_repaired, r.gaps_remaining, r.partitions_verified, r.error_message and r.error_message.split(":")[0]) for i, r in enumerate(runs)]
    return spark.createDataFrame(rows, "run int, status string, rows_fetched long, rows_inserted long, rows_repaired long, gaps_remaining long, partitions_verified long, error string")


_STAGES = [("starting", "merge", "validate", "aggregate", "export", "verify", "complete"), ("starting", "complete"), ("starting", "merge", "merge"), ("starting", "starting"), ("starting", "merge", "validate", "aggregate", "export", "export"), ("starting", "merge", "validate", "aggregate", "export", "verify", "")]
_ENDS = ["'succeeded'", "'noop'", "'failed'", "'failed'", "'interrupted'", "CASE WHEN gaps > 0 THEN 'failed' ELSE 'succeeded' END"]
#: The stages of a sync that finds broken rows, and which of the six find some of the events' own.
_REFUSED = ("starting", "starting")
_BAD_IN = ["first_bad", "first_bad", "bad", "FALSE", "bad", "bad"]
_FETCHED = ["(SELECT count(*) FROM early)", "CASE WHEN first_bad THEN (SELECT count(*) FROM early) ELSE 0 END", "2 * n", "n", "n", "n"]
_EVENTS = " UNION ALL ".join(
    f"""SELECT {i + 1} AS run, {k} AS step, {"CASE WHEN gaps > 0 THEN 'verify' ELSE 'complete' END" if not stage else f"'{stage}'"} AS stage, {end if k == len(stages) - 1 else "'running'"} AS status, CAST({_FETCHED[i] if k else 0} AS BIGINT) AS rows_fetched FROM left_open, faults, rest WHERE {where}"""
    for i in range(6) for stages, end, where in ((_STAGES[i], _ENDS[i], f"NOT {_BAD_IN[i]}"), (_REFUSED, "'failed'", _BAD_IN[i])) for k, stage in enumerate(stages)
)


@query(sql(_EVENTS, DENSE, _SYNCS))
def sync_stages(spark, sf_dir):
    """Every record that the six syncs left: one before the work, one a stage, one at the end; the one that
    died has its end from the next one."""
    events = run_events(spark, _syncs(spark, sf_dir)[1])
    number = F.dense_rank().over(Window.orderBy("started_at"))  # six runs
    return events.select(number.alias("run"), "step", "stage", "status", "rows_fetched")


@query(sql("SELECT * FROM rolled", DENSE, _SYNCS))
def sync_table(spark, sf_dir):
    """The table after the six syncs."""
    return stored_bars(spark, _syncs(spark, sf_dir)[0]).select("symbol", "interval", "open_time", "low", "high", "trade_count")


@query(sql("""SELECT symbol, "interval", count(*) AS rows, min(open_time) AS first_open, max(open_time) AS last_open, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gaps FROM (
    SELECT *, CASE WHEN open_time > lag(open_time) OVER (PARTITION BY symbol, "interval" ORDER BY open_time) + CASE "interval" WHEN '1h' THEN INTERVAL 1 HOUR WHEN '4h' THEN INTERVAL 4 HOUR ELSE INTERVAL 24 HOUR END THEN 1 ELSE 0 END AS gap FROM rolled) GROUP BY ALL""", DENSE, _SYNCS))
def sync_summaries(spark, sf_dir):
    """What the summaries of the months tell of the table after the six syncs, without reading it."""
    summary = read_summary(spark, _syncs(spark, sf_dir)[1] + "/months")
    ends = summary.groupBy(*KEY).agg(F.sum("rows").alias("rows"), F.min("first_open").alias("first_open"), F.max("last_open").alias("last_open"))
    gaps = stored_gaps(summary).groupBy(*KEY).agg(F.count("*").alias("gaps"))
    return ends.join(gaps, KEY, "left").select("symbol", "interval", "rows", "first_open", "last_open", F.coalesce("gaps", F.lit(0)).alias("gaps"))


@query(sql(f"SELECT {_KEYS}, open_time FROM bars WHERE hour(open_time) = 7"))
def merge_batch_conflicts(spark, sf_dir):
    """A batch that gives the bars of one hour of the day twice, with different values."""
    bars = bars_1h(spark, sf_dir)
    other = bars.filter(utc_hour(F.col("open_time")) == 7).withColumn("trade_count", F.col("trade_count") + 1)
    return merge.merge(bars.limit(0), bars.unionByName(bars).unionByName(other)).conflicts


@query(sql(f"SELECT {_COLS} FROM bars"))
def merge_repeated_rows(spark, sf_dir):
    """A batch of which every row comes twice, under two sources: each is inserted once."""
    bars = bars_1h(spark, sf_dir)
    return merge.insert_only_merge(bars.limit(0), bars.unionByName(bars.withColumn("source", F.lit("later"))))


@query(sql(f"""SELECT source_url, period, complete, finished_children FROM (
    SELECT 'd-' || symbol || strftime(d, '%Y-%m-%d') AS source_url, strftime(d, '%Y-%m-%d') AS period, n = 24 AND NOT broken AS complete, CAST(0 AS BIGINT) AS finished_children FROM (SELECT symbol, date_trunc('day', open_time) AS d, count(*) AS n, bool_or({_BROKEN}) AS broken FROM dense GROUP BY ALL)
    UNION ALL SELECT 'm-' || symbol || strftime(m, '%Y-%m'), strftime(m, '%Y-%m'), (n = 24 * day(last_day(m)) AND NOT broken) OR kids >= day(last_day(m)), kids FROM (SELECT symbol, date_trunc('month', open_time) AS m, count(*) AS n, bool_or({_BROKEN}) AS broken, count(DISTINCT CASE WHEN symbol <> 'view' THEN day(open_time) END) AS kids FROM dense GROUP BY ALL))""", DENSE))
def complete_fallbacks(spark, sf_dir):
    """Every day and month of the dense bars as a pending item. The days of all symbols but views also
    exist as finished children of their month; bars of another venue, and a period with a broken bar, complete nothing."""
    dense = dense_1h(spark, sf_dir)
    day = utc_date(F.col("open_time"))
    days, months = (dense.select("venue", "market_type", "symbol", F.date_format(day, f).alias("period")).distinct() for f in ("yyyy-MM-dd", "yyyy-MM"))
    name = F.concat_ws("-", "symbol", F.lit("1m"), F.concat("period", F.lit(".zip")))
    url = lambda kind: F.concat(F.lit(kind), "symbol", "period")
    pending = days.select(url("d-").alias("source_url"), "*", F.lit("fallback_pending").alias("status"), F.lit(None).cast("string").alias("fallback_parent_url"))
    pending = pending.unionByName(months.select(url("m-").alias("source_url"), "*", F.lit("fallback_pending").alias("status"), F.lit(None).cast("string").alias("fallback_parent_url")))
    kids = days.filter("symbol <> 'view'").select(url("k-").alias("source_url"), "*", F.lit("validated").alias("status"), F.concat(F.lit("m-"), "symbol", F.left("period", F.lit(7))).alias("fallback_parent_url"))
    items = pending.unionByName(kids).withColumn("file_name", name)
    # the operator looks at one-minute bars: each hour stands for its sixty minutes
    minutes = dense.withColumn("open_time", F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: add_seconds(F.col("open_time"), k * 60))))
    minutes = minutes.withColumns({"interval": F.lit("1m"), "close_time": F.timestamp_micros(F.unix_micros("open_time") + 59_999_000)})
    return manifest.complete_fallbacks(items, minutes.unionByName(minutes.withColumn("venue", F.lit("elsewhere"))))


@query(sql("""SELECT source_url, status, step FROM (
    SELECT 'd-' || symbol || d AS source_url, 'fallback_complete' AS status, 1 AS step FROM days WHERE n = 24 AND NOT broken AND NOT held
    UNION ALL SELECT 'm-' || symbol || left(d, 7), 'fallback_complete', 2 FROM days GROUP BY symbol, left(d, 7) HAVING count(*) FILTER (n = 24 AND NOT broken OR held) >= day(last_day(CAST(left(any_value(d), 7) || '-01' AS DATE))))""", DENSE, SOLID, f"""
days AS (SELECT symbol, strftime(open_time, '%Y-%m-%d') AS d, CAST(count(*) FILTER (day(open_time) % 5 <> 0) AS INTEGER) AS n, bool_or({_BROKEN}) AS broken, any_value(day(open_time) % 5 = 0) AS held FROM solid GROUP BY ALL)"""))
def reconciled_fallbacks(spark, sf_dir):
    """Days and months of gap-free bars as pending items without parents. Every fifth day has no bars but is validated
    already; so months are whole by their days alone, in the run that completes the others. A broken bar leaves its day pending."""
    bars = jobs.stage(solid_1h(spark, sf_dir), shared(spark, "solid"))
    fifth = F.dayofmonth(utc_date(F.col("open_time"))) % 5 == 0
    items = []
    for kind, form in (("d-", "yyyy-MM-dd"), ("m-", "yyyy-MM")):
        status = F.when(fifth, "validated").otherwise("fallback_pending") if kind == "d-" else F.lit("fallback_pending")
        rows = bars.select("symbol", F.date_format(utc_date(F.col("open_time")), form).alias("period"), status.alias("status")).distinct()
        items.append(rows.select(F.concat(F.lit(kind), "symbol", "period").alias("source_url"), F.concat_ws("-", "symbol", F.lit("1m"), F.concat("period", F.lit(".zip"))).alias("file_name"), "period", "status"))
    # the operator looks at one-minute bars: each hour stands for its sixty minutes
    minutes = bars.filter(~fifth).withColumn("open_time", F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: add_seconds(F.col("open_time"), k * 60))))
    minutes = minutes.withColumns({"interval": F.lit("1m"), "close_time": F.timestamp_micros(F.unix_micros("open_time") + 59_999_000)})
    return manifest.reconcile_pending(items[0].unionByName(items[1]), minutes)


@query(sql("""SELECT r.symbol AS range_symbol, m.symbol || '-' || m.period AS item FROM (SELECT DISTINCT symbol, strftime(open_time, '%Y-%m-%d') AS period, date_trunc('day', open_time) AS s FROM bars) m
    JOIN (SELECT symbol, min(open_time) + INTERVAL 36 HOUR AS a, min(open_time) + INTERVAL 240 HOUR AS b FROM bars GROUP BY symbol) r ON r.symbol = m.symbol AND m.s < r.b AND m.s + INTERVAL 1 DAY > r.a"""))
def overlapping_ranges(spark, sf_dir):
    """The days of each symbol that meet a range from 36 to 240 hours after its first bar."""
    bars = bars_1h(spark, sf_dir)
    items = bars.select("symbol", F.date_format(utc_date(F.col("open_time")), "yyyy-MM-dd").alias("period")).distinct()
    first = bars.groupBy("symbol").agg(F.min("open_time").alias("f"))
    ranges = first.select("symbol", add_seconds(F.col("f"), 36 * 3600).alias("start"), add_seconds(F.col("f"), 240 * 3600).alias("end"))
    return manifest.overlapping_ranges(items, ranges).select(F.col("symbol").alias("range_symbol"), F.concat_ws("-", "symbol", "period").alias("item"))


def _bar_ranges(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEY).agg(F.min("open_time").alias("start"), add_seconds(F.max("open_time"), 3600).alias("end"))


_PARTS = "(SELECT count(DISTINCT (symbol, date_trunc('month', open_time))) FROM bars)"


@query(sql(f"""SELECT {_PARTS} AS partitions_expected, {_PARTS} AS partitions_ok, (SELECT count(*) FROM bars WHERE hour(open_time) = 7) AS issues_found,
    (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT 'cell close ' || symbol || ' 1h ' || CAST(epoch_us(open_time) AS VARCHAR) AS i FROM bars WHERE hour(open_time) = 7 ORDER BY i LIMIT 20)) AS issues, (SELECT count(*) = 0 FROM bars WHERE hour(open_time) = 7) AS passed"""))
def verification_report(spark, sf_dir):
    """Stored bars verified against bars whose close differs in one hour of the day."""
    root = shared(spark, "bars")
    bars = bars_1h(spark, sf_dir)
    write_candles(bars, root)
    other = bars.withColumn("close", F.when(utc_hour(F.col("open_time")) == 7, F.col("close") + 1).otherwise(F.col("close")).cast("decimal(38,18)"))
    out = jobs.verify(spark, other, root, _bar_ranges(bars), work=shared(spark, "issues"))
    return out.withColumn("issues", F.when(F.size("issues") > 0, F.array_join("issues", ",")))


_SEVEN = "(SELECT count(*) FROM bars WHERE hour(open_time) = 7)"
_OF = {
    "clean": "0", "bar_only": _SEVEN, "stored_only": _SEVEN, "changed_cell": _SEVEN, "repeated": f"2 * {_SEVEN}", "reordered": f"(SELECT count(*) FROM bars) - {_PARTS}", "other_version": "(SELECT count(*) FROM bars)", "wrong_schema": _PARTS, "null_cells": "(SELECT count(DISTINCT (symbol, date_trunc('month', open_time))) FROM bars WHERE hour(open_time) = 7)",
    "missing_file": "(SELECT count(*) + count(DISTINCT date_trunc('month', open_time)) FROM bars WHERE symbol = 'click')",
    "extra_file": "(SELECT count(*) + count(DISTINCT (symbol, date_trunc('month', open_time + INTERVAL 400 DAY))) FROM bars WHERE hour(open_time) = 7)",
}


@query(sql(" UNION ALL ".join(f"SELECT '{fault}' AS fault, {n} AS issues_found, {n} = 0 AS passed" for fault, n in _OF.items())))
def verification_faults(spark, sf_dir):
    """One stored table for each fault, verified: only the clean one passes."""
    bars = jobs.stage(bars_1h(spark, sf_dir), shared(spark, "bars"))
    seven = bars.filter(utc_hour(F.col("open_time")) == 7)
    later = seven.withColumns({c: add_seconds(F.col(c), 400 * 86_400) for c in ("open_time", "close_time")})
    rest = bars.filter(utc_hour(F.col("open_time")) != 7)
    changed = bars.withColumn("close", F.when(utc_hour(F.col("open_time")) == 7, F.col("close") + 1).otherwise(F.col("close")).cast("decimal(38,18)"))
    stored = {
        "clean": (bars, bars, {}), "bar_only": (bars, rest, {}), "stored_only": (rest, bars, {}), "changed_cell": (bars, changed, {}), "repeated": (bars, bars.unionByName(seven), {}), "reordered": (bars, bars, {"order": F.desc("open_time")}),
        "other_version": (bars, bars, {"version": "9"}), "wrong_schema": (bars, bars.withColumn("close", F.col("close").cast("double")), {}), "null_cells": (bars, bars.withColumn("close", F.when(utc_hour(F.col("open_time")) != 7, F.col("close"))), {}), "missing_file": (bars, bars.filter("symbol <> 'click'"), {}), "extra_file": (bars, bars.unionByName(later), {}),
    }
    ranges, rows = _bar_ranges(bars), []
    for fault, (given, kept, options) in stored.items():
        root = shared(spark, fault)
        write_candles(kept, root, **options)
        r = jobs.verify(spark, given, root, ranges, work=shared(spark, "issues")).first()
        rows.append((fault, r.issues_found, r.passed))
    return spark.createDataFrame(rows, "fault string, issues_found long, passed boolean")


_COUNTERS = """
fresh AS (SELECT a.* FROM altered a WHERE NOT EXISTS (SELECT 1 FROM rest b WHERE b.symbol = a.symbol AND b.open_time = a.open_time))"""


@query(sql("""SELECT (SELECT count(*) FROM altered) AS rows_fetched, (SELECT count(*) FROM fresh) AS rows_inserted, (SELECT count(DISTINCT (symbol, date_trunc('month', open_time))) FROM fresh) AS partitions""", ALTERED.replace("hour(open_time) = 7 THEN CAST(close + 1 AS DECIMAL(38,18)) ELSE close END", "FALSE THEN close ELSE close END"), "\nrest AS (SELECT * FROM bars WHERE hour(open_time) % 3 <> 0)", _COUNTERS))
def run_counters(spark, sf_dir):
    """Counters of one merge: fetched, inserted, and month partitions that the new rows touch."""
    bars = bars_1h(spark, sf_dir)
    fetched = altered(bars).join(bars.select(*KEY, "open_time", F.col("close").alias("__close")), [*KEY, "open_time"], "left").withColumn("close", F.coalesce("__close", "close")).drop("__close")
    fresh = merge.merge(bars.filter(utc_hour(F.col("open_time")) % 3 != 0), fetched.select(*CANDLE_COLUMNS)).inserted
    counts = fresh.agg(F.count("*").alias("rows_inserted"), F.count_distinct("symbol", F.trunc(utc_date(F.col("open_time")), "month")).alias("partitions"))
    return counts.withColumn("rows_fetched", F.lit(fetched.count()))
