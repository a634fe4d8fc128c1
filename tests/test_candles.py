import datetime as dt
import re
import decimal
import hashlib
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from barline.functions import fields, intervals
from barline.functions.intervals import resolve_range
from barline.operators import manifest, merge, quality
from barline.operators.resample import resample_complete, resample_ladder
from barline.plans import jobs
from barline.plans.catalog import QUERIES, SQL
from barline.schemas import CANDLE, CANDLE_COLUMNS, KEY
from barline.sources import archives, plan
from barline.sources.tables import append_run_record, check_schema, page_candles, scan_candles, write_candles
from barline.sources.summaries import append_summary, read_summary, stored_bars, stored_months
from barline.streaming.runs import close_interrupted, read_runs, run_events
from barline.streaming.sync import append_items, read_items
from barline.streaming.sync import BadRowsError, BootstrapRequired, GapsRemain, apply_batch, catchup_split, incremental_sync, sync, sync_window

from .oracle import rows_of, sql_rows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
D = decimal.Decimal
DATA = "/root/testdata/sf0.001"


def minute(n, symbol="AAA", **over):
    at = T0 + dt.timedelta(minutes=n)
    row = dict(
        venue="v", market_type="spot", symbol=symbol, interval="1m", open_time=at, open=D(1), high=D(2), low=D(1), close=D(1), base_asset_volume=D(0), close_time=at + dt.timedelta(milliseconds=59_999),
        quote_asset_volume=D(0), trade_count=0, taker_buy_base_volume=D(0), taker_buy_quote_volume=D(0), source="test", source_file="test",
    )
    return row | over


def bars(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in CANDLE_COLUMNS) for r in rows], CANDLE)


def ranges(spark, minutes, symbol="AAA"):
    return spark.createDataFrame([("v", "spot", symbol, "1m", T0, T0 + dt.timedelta(minutes=minutes))], "venue string, market_type string, symbol string, interval string, start timestamp, end timestamp")


@pytest.mark.parametrize("target,n", [("15m", 15), ("1h", 60), ("4h", 240), ("1d", 1440)])
def test_bucket_needs_every_child(spark, target, n):
    rows = [minute(i) for i in range(n)]
    assert resample_complete(bars(spark, rows), "1m", target).count() == 1
    assert resample_complete(bars(spark, rows[:-1]), "1m", target).count() == 0
    assert resample_complete(bars(spark, rows[:-1] + [rows[0]]), "1m", target, unique=False).count() == 0


def test_golden_grid(spark):
    n = 1_578_477
    start = dt.datetime(2023, 8, 3, tzinfo=dt.timezone.utc)
    one = F.lit(1).cast("decimal(38,18)")
    grid = spark.range(n).withColumn("open_time", F.timestamp_micros(F.lit(int(start.timestamp()) * 1_000_000) + F.col("id") * 60_000_000))
    grid = grid.select(*[(F.lit(v).alias(k)) for k, v in dict(venue="v", market_type="spot", symbol="A", interval="1m").items()], "open_time", *[one.alias(c) for c in ("open", "high", "low", "close", "base_asset_volume", "quote_asset_volume", "taker_buy_base_volume", "taker_buy_quote_volume")], F.lit(1).cast("bigint").alias("trade_count"), F.col("open_time").alias("close_time"))
    counts = {k: v.count() for k, v in resample_ladder(grid).items()}
    assert counts == {"15m": 105_231, "1h": 26_307, "4h": 6_576, "1d": 1_096}


def test_gap_and_duplicate(spark):
    df = bars(spark, [minute(0), minute(0), minute(2)]).withColumn("line_no", F.monotonically_increasing_id())
    assert quality.find_gaps(df, ranges(spark, 3)).count() == 1
    assert quality.duplicate_keys(df).count() == 1
    assert quality.conflicting_duplicates(df).count() == 0
    assert quality.find_gaps(bars(spark, []), ranges(spark, 3)).collect()[0].gap_end == (T0 + dt.timedelta(minutes=3)).replace(tzinfo=None)


def test_gap_over_month_end(spark):
    edge = 31 * 1440
    df = bars(spark, [minute(edge - 2), minute(edge + 1)])
    gap = quality.interior_gaps(df).collect()
    assert len(gap) == 1 and (gap[0].gap_end - gap[0].gap_start) == dt.timedelta(minutes=2)


def test_broken_rules(spark):
    codes = {r.code for r in quality.quality_violations(bars(spark, [minute(0, high=D(0), trade_count=-1, base_asset_volume=D(-1))])).collect()}
    assert codes == {"high_below", "price_not_positive", "volume_negative", "trades_negative"}


def test_merge(spark):
    old, new = bars(spark, [minute(0), minute(1)]), bars(spark, [minute(1, source="other"), minute(2)])
    once = merge.insert_only_merge(old, new)
    assert once.count() == 3 and once.filter("source = 'other'").count() == 0
    assert merge.merge(once, new).inserted.count() == 0
    with pytest.raises(merge.ConflictError):
        merge.insert_only_merge(once, bars(spark, [minute(1, open=D("1.5"))]))
    assert merge.cell_diff(old, bars(spark, [minute(0), minute(1, close=D("1.1"))])).collect()[0].column == "close"


def test_repair_needs_whole_gap(spark):
    held = bars(spark, [minute(0), minute(3)])
    part, whole = bars(spark, [minute(1)]), bars(spark, [minute(1), minute(2)])
    assert jobs.repair_from_pages(held, part, ranges(spark, 4))[0].count() == 2
    assert jobs.repair_from_pages(held, whole, ranges(spark, 4))[0].count() == 4


def test_sync_windows(spark):
    def marks(n):
        return quality.watermark(bars(spark, [minute(n)]))

    end = F.lit(T0 + dt.timedelta(minutes=20_000))
    none = spark.createDataFrame([], "venue string, market_type string, symbol string, interval string, gap_start timestamp, gap_end timestamp")
    tail = sync_window(marks(19_990), none, end).collect()[0]
    assert tail.start == (T0 + dt.timedelta(minutes=19_991)).replace(tzinfo=None)
    assert sync_window(marks(19_999), none, end).count() == 0
    gap = spark.createDataFrame([("v", "spot", "AAA", "1m", T0 + dt.timedelta(minutes=19_880), T0 + dt.timedelta(minutes=19_881))], none.schema)
    assert sync_window(marks(19_999), gap, end).collect()[0].start == (T0 + dt.timedelta(minutes=19_880)).replace(tzinfo=None)
    old, rest = catchup_split(sync_window(marks(1000), none, end))
    assert old.count() == 1 and rest.collect()[0].start == old.collect()[0].end
    assert catchup_split(sync_window(marks(19_990), none, end))[0].count() == 0


def test_archive_plan(spark):
    def items(a, b, now):
        r = spark.createDataFrame([("AAA", "1m", a, b)], "symbol string, interval string, start timestamp, end timestamp")
        return plan.archive_plan(r, F.lit(now), "root")

    utc = lambda *x: dt.datetime(*x, tzinfo=dt.timezone.utc)
    month = items(utc(2024, 1, 1), utc(2024, 2, 1), utc(2024, 3, 1))
    assert [r.period for r in month.collect()] == ["2024-01"]
    assert plan.daily_fallback(month, "root").count() == 31
    assert sorted(r.period for r in items(utc(2024, 1, 2), utc(2024, 1, 4), utc(2024, 3, 1)).collect()) == ["2024-01-02", "2024-01-03"]
    assert items(utc(2024, 1, 31, 12), utc(2024, 3, 31), utc(2024, 4, 1)).filter("source_type = 'monthly'").count() == 1


def test_range_rules():
    now = dt.datetime(2024, 5, 1, 10, 30, 20, tzinfo=dt.timezone.utc)
    assert resolve_range("2024-01-01T00:00Z", "latest-closed", now)[1] == now.replace(second=0)
    for a, b in (("2024-01-01T00:00:30Z", "latest-closed"), ("2024-05-02T00:00Z", "2024-05-03T00:00Z"), ("2024-01-02T00:00Z", "2024-01-02T00:00Z")):
        with pytest.raises(ValueError):
            resolve_range(a, b, now)


def kline(n, **over):
    at = int(T0.timestamp() * 1000) + n * 60_000
    f = dict(o=at, c=at + 59_999, open="1") | over
    return f"{f['o']},{f['open']},2,0.5,1.5,0,{f['c']},0,0,0,0,0"


def land(path, name, lines, entry="a.csv", sidecar=None):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(entry, "\n".join(lines))
    with open(f"{path}/{name}", "wb") as f:
        f.write(raw.getvalue())
    with open(f"{path}/{name}.sha256", "w") as f:
        f.write(sidecar or hashlib.sha256(raw.getvalue()).hexdigest() + "  " + name)



def test_import_archives(spark, tmp_path):
    head = "open_time,open,high,low,close,v,close_time,q,n,tb,tq,i"
    land(tmp_path, "AAA-1m-2024-01-01.zip", [head, *(kline(i) for i in range(3))])
    land(tmp_path, "AAA-1m-2024-01-02.zip", [kline(1440), "x,1"])
    land(tmp_path, "AAA-1m-2024-01-03.zip", [kline(2880)], sidecar="0" * 64)
    land(tmp_path, "AAA-1m-2024-01-04.zip", [kline(4320)], entry="a.txt")
    constants = {"venue": F.lit("v"), "market_type": F.lit("spot"), "symbol": F.split("source_file", "-")[0], "interval": F.lit("1m")}
    merged, refused, files, events = jobs.import_archives(spark, str(tmp_path), bars(spark, []), T0, T0 + dt.timedelta(days=5), constants, str(tmp_path / "work"))
    assert merged.count() == 3
    assert {r.source_file[-6:-4]: r.reason for r in refused.collect()} == {"02": "bad fields: field_count", "03": "checksum mismatch", "04": "entry is not .csv"}
    assert sorted((r.file_name[-6:-4], r.status) for r in events.collect()) == [("01", "checksum_verified"), ("01", "imported"), ("02", "checksum_verified"), ("02", "failed"), ("03", "failed"), ("04", "checksum_verified"), ("04", "failed")]
    assert files.collect()[0].row_count == 3
    outcomes = archives.verify_checksums(archives.read_files(spark, str(tmp_path)), archives.read_sidecars(spark, str(tmp_path)))
    assert {r.file_name[-6:-4]: r.outcome for r in outcomes.collect()} == {"01": "pass", "02": "pass", "03": "mismatch", "04": "pass"}


def test_units(spark):
    rows = [(1704067200000, "2024-01-01"), (1735689600000000, "2025-01-01"), (42, "2024-01-01")]
    df = spark.createDataFrame(rows, "v long, s string").withColumn("s", F.col("s").cast("timestamp"))
    from barline.functions.fields import infer_ts_unit

    assert [r[0] for r in df.select(infer_ts_unit(F.col("v"), F.col("s"), F.col("s") + F.expr("INTERVAL 31 DAY"))).collect()] == ["ms", "us", None]



def test_export_and_verify_faults(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = bars(spark, [minute(i) for i in range(1440)])
    report = jobs.export(spark, rows, ranges(spark, 1440), root)
    assert report.collect()[0].valid
    part = f"{root}/venue=v/market_type=spot/symbol=AAA/interval=1m/year=2024/month=01"
    file = next(f"{part}/{f}" for f in os.listdir(part) if f.endswith(".parquet"))
    schema = jobs.STORED_ARROW
    passed = lambda df=rows: jobs.verify(spark, df, root, ranges(spark, 1440)).collect()[0].passed
    assert passed()
    assert not passed(bars(spark, [minute(i) for i in range(1439)]))
    assert not passed(bars(spark, [minute(i) for i in range(1441)]))
    assert not passed(bars(spark, [minute(i, close=D("1.5")) if i == 7 else minute(i) for i in range(1440)]))
    assert check_schema(spark, root, schema | {"close": "double"}).count() == 1
    assert page_candles(rows, F.lit(T0), 2).count() == 2
    with pytest.raises(ValueError):
        page_candles(rows, F.lit(T0), 0)
    assert scan_candles(spark, root, {"symbol": "AAA"}, T0, T0 + dt.timedelta(minutes=5)).count() == 5
    write_candles(bars(spark, [minute(44_640)]), root)  # another month; the first stays
    assert scan_candles(spark, root, {"symbol": "AAA"}, T0, T0 + dt.timedelta(days=40)).count() == 1441
    os.rename(file, f"{root}/stray.parquet")
    assert not passed()


def test_export_refuses_gaps(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.export(spark, bars(spark, [minute(0), minute(2)]), ranges(spark, 3), str(tmp_path / "x"))


def test_incremental_sync(spark, tmp_path):
    landing, root, log, check = (str(tmp_path / x) for x in ("in", "table", "log", "check"))
    bars(spark, [minute(i) for i in range(60)]).write.parquet(landing)
    incremental_sync(spark, landing, root, log, check).awaitTermination()
    assert {r.interval: r["count"] for r in stored_bars(spark, root).groupBy("interval").count().collect()} == {"1m": 60, "15m": 4, "1h": 1}
    bars(spark, [minute(i) for i in range(50, 75)]).write.mode("append").parquet(landing)
    incremental_sync(spark, landing, root, log, check).awaitTermination()
    assert {r.interval: r["count"] for r in stored_bars(spark, root).groupBy("interval").count().collect()} == {"1m": 75, "15m": 5, "1h": 1}
    assert [r.rows_inserted for r in read_runs(spark, log).orderBy("started_at").collect()] == [60, 15]


def test_sync_refuses_bad_batches(spark, tmp_path):
    root, log = str(tmp_path / "table"), str(tmp_path / "log")
    apply_batch(bars(spark, [minute(0)]), root, log)
    for rows, error in (([minute(1), minute(1, close=D("1.5"))], merge.ConflictError), ([minute(0, close=D("1.5"))], merge.ConflictError), ([minute(1), minute(2, high=D("0.1"))], BadRowsError)):
        with pytest.raises(error):
            apply_batch(bars(spark, rows), root, log)
    assert apply_batch(bars(spark, [minute(1), minute(1)]), root, log).first().rows_inserted == 1
    assert stored_bars(spark, root).filter("interval = '1m'").count() == 2
    assert [r.status for r in read_runs(spark, log).orderBy("started_at").collect()] == ["succeeded", "failed", "failed", "failed", "succeeded"]


def test_interrupted_runs_are_closed(spark, tmp_path):
    log = str(tmp_path / "log")
    append_run_record(spark.createDataFrame([("a", "running", T0)], "id string, status string, observed_at timestamp"), log + "/runs")
    close_interrupted(spark, log)
    assert [(r.id, r.status) for r in read_runs(spark, log).collect()] == [("a", "interrupted")]


class Killed(BaseException):
    """Stands for a process that dies."""


def days(spark, first, count, **over):
    return bars(spark, [minute((first + d) * 1440 + h * 60, **over) for d in range(count) for h in range(24)]).withColumn("interval", F.lit("1h")).withColumn("close_time", F.timestamp_micros(F.unix_micros("open_time") + 3_599_999_000))


def hourly_sync(spark, rows, root, log, until, keys=None, **options):
    none = spark.createDataFrame([], "venue string, market_type string, symbol string, interval string, start timestamp")
    return sync(spark, rows, none if keys is None else keys, root, log, T0 + dt.timedelta(days=until), levels=("4h",), base="1h", **options)


def test_sync_reads_touched_months_only(spark, tmp_path):
    root, log = str(tmp_path / "table"), str(tmp_path / "log")
    keys = days(spark, 0, 1).groupBy(*KEY).agg(F.min("open_time").alias("start"))
    hourly_sync(spark, days(spark, 0, 75), root, log, 75, keys)  # January to mid-March
    files = sorted(p for p in (tmp_path / "table").rglob("*.parquet") if "month=03" not in str(p))
    assert len(files) == 4
    for p in files:
        p.write_bytes(b"no Parquet: whoever opens this fails")
    for p in (tmp_path / "table").rglob(".*.crc"):
        p.unlink()
    got = hourly_sync(spark, days(spark, 74, 6), root, log, 80).first()
    assert (got.status, got.rows_fetched, got.rows_inserted, got.partitions_verified, got.gaps_remaining) == ("succeeded", 120, 120, 2, 0)


def test_touched_months_are_partition_filters(spark, tmp_path):
    write_candles(days(spark, 0, 40), str(tmp_path))
    months = spark.createDataFrame([("v", "spot", "AAA", "2024", "02")], "venue string, market_type string, symbol string, year string, month string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        got = stored_months(spark, str(tmp_path), months)
        filters = re.search(r"PartitionFilters: \[(.*)", got._jdf.queryExecution().executedPlan().toString())[1].split("PushedFilters")[0]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(x in filters for x in ("year#", "2024", "month#", "02", "symbol#", "AAA")) and got.count() == 9 * 24


def test_a_run_that_dies_is_closed_and_its_months_are_summarized(spark, tmp_path, monkeypatch):
    from barline.streaming import sync as module

    root, log = str(tmp_path / "table"), str(tmp_path / "log")
    keys = days(spark, 0, 1).groupBy(*KEY).agg(F.min("open_time").alias("start"))
    hourly_sync(spark, days(spark, 0, 2), root, log, 2, keys)

    def dies(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(module, "append_summary", dies)  # the months are written, their summaries are not
        with pytest.raises(Killed):
            hourly_sync(spark, days(spark, 2, 2), root, log, 4)
    assert [r.status for r in read_runs(spark, log).orderBy("started_at").collect()] == ["succeeded", "running"]
    assert hourly_sync(spark, days(spark, 2, 2), root, log, 4).first().status == "noop"  # what died had written all
    assert [(r.status, r.stage) for r in read_runs(spark, log).orderBy("started_at").collect()] == [("succeeded", "complete"), ("interrupted", "export"), ("noop", "complete")]
    assert {r.interval: r.rows for r in read_summary(spark, log + "/months").collect()} == {"1h": 96, "4h": 24}
    # What ended a run stays: the lost process cannot come back and call itself a success.
    old = read_runs(spark, log).filter("status = 'interrupted'")
    append_run_record(old.withColumns({"status": F.lit("succeeded"), "observed_at": F.current_timestamp()}), log + "/runs")
    assert read_runs(spark, log).filter("status = 'succeeded'").count() == 1


def test_sync_fails_on_gaps_bad_rows_and_missing_history(spark, tmp_path):
    root, log = str(tmp_path / "table"), str(tmp_path / "log")
    keys = days(spark, 0, 1).groupBy(*KEY).agg(F.min("open_time").alias("start"))
    with pytest.raises(BootstrapRequired):
        hourly_sync(spark, days(spark, 0, 1), root, log, 1, keys.withColumn("start", F.lit(None).cast("timestamp")))
    with pytest.raises(GapsRemain):
        hourly_sync(spark, days(spark, 0, 2).filter("hour(open_time) <> 5"), root, log, 2, keys)
    last = read_runs(spark, log).orderBy(F.desc("started_at")).first()
    assert (last.status, last.gaps_remaining, last.rows_inserted) == ("failed", 2, 46) and stored_bars(spark, root).filter("interval = '1h'").count() == 46
    mended = hourly_sync(spark, days(spark, 0, 3), root, log, 3).first()  # begins again at the first gap
    assert (mended.status, mended.rows_repaired, mended.rows_inserted) == ("succeeded", 2, 26)
    write_candles(days(spark, 0, 3).withColumn("high", F.lit(0).cast("decimal(38,18)")), root)
    append_summary(days(spark, 0, 3).withColumn("high", F.lit(0).cast("decimal(38,18)")), log + "/months")
    with pytest.raises(BadRowsError):
        hourly_sync(spark, days(spark, 3, 1), root, log, 4)
    assert [r.stage for r in read_runs(spark, log).orderBy("started_at").collect()] == ["bootstrap_required", "verify", "complete", "starting"]


def test_merge_and_comparison_shuffle_each_side_once(spark):
    a, b = bars(spark, [minute(0)]), bars(spark, [minute(1)])
    conf = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(venue")
        assert exchanges(merge.merge(a, b).inserted) == 2
        assert exchanges(merge.cell_diff(a, b)) == 2
    finally:
        for k, v in conf.items():
            spark.conf.set(k, v)


def test_nulls_are_found_in_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"a": [1, None, 3], "b": ["x", "y", None]})
    for name, statistics in (("with", True), ("without", False)):
        pq.write_table(table, tmp_path / f"{name}.parquet", write_statistics=statistics, row_group_size=2)
    pq.write_table(table.slice(0, 1), tmp_path / "clean.parquet")
    types = {"a": "int64", "b": "string"}
    got = {r.path.rsplit("/", 1)[-1]: r.problem for r in check_schema(spark, str(tmp_path), types, ("a", "b")).collect()}
    assert got == {"with.parquet": "a: 1 nulls; b: 1 nulls", "without.parquet": "a: 1 nulls; b: 1 nulls"}
    assert check_schema(spark, str(tmp_path), types, ()).count() == 0


def test_two_exports_have_the_same_bytes(spark, tmp_path):
    """Rows in another order and other partitions give the same files, but for their names."""
    rows = days(spark, 0, 40)
    digests = []
    for name, df in (("one", rows), ("two", rows.orderBy(F.desc("open_time")).repartition(5))):
        write_candles(df, str(tmp_path / name))
        files = sorted((tmp_path / name).rglob("*.parquet"), key=lambda p: str(p.parent))
        digests.append([(str(p.parent.relative_to(tmp_path / name)), hashlib.sha256(p.read_bytes()).hexdigest()) for p in files])
    assert digests[0] == digests[1] and len(digests[0]) == 2


def test_sync_completes_a_month_with_its_last_day(spark, tmp_path):
    root, log, held = (str(tmp_path / x) for x in ("table", "log", "items"))
    day = lambda d: (f"d{d}", f"AAA-1m-2024-01-{d:02}.zip", f"2024-01-{d:02}", "fallback_pending" if d in (1, 2) else "validated")
    items = spark.createDataFrame([day(d) for d in range(1, 32)] + [("m", "AAA-1m-2024-01.zip", "2024-01", "fallback_pending")], "source_url string, file_name string, period string, status string")
    append_items(items.withColumns({"step": F.lit(0), "observed_at": F.lit(T0)}), held)
    keys = bars(spark, [minute(0)]).groupBy(*KEY).agg(F.min("open_time").alias("start"))
    states = lambda: {r.source_url: r.status for r in read_items(spark, held).filter("source_url IN ('d1', 'd2', 'm')").collect()}
    for days_, want in ((1, ("fallback_complete", "fallback_pending", "fallback_pending")), (2, ("fallback_complete",) * 3)):
        rows = bars(spark, [minute(i) for i in range(days_ * 1440)])
        sync(spark, rows, keys, root, log, T0 + dt.timedelta(days=days_), levels=("1d",), manifest=held)
        assert states() == dict(zip(("d1", "d2", "m"), want))
    assert "reconcile" in [r.stage for r in run_events(spark, log).collect()]


def test_imported_archives_are_not_read_again(spark, tmp_path):
    folder, log, work = (str(tmp_path / x) for x in ("landed", "manifest", "work"))
    os.mkdir(folder)

    def put(name, lines, sidecar=True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr(zipfile.ZipInfo(name.replace(".zip", ".csv")), "\n".join(lines))
        (tmp_path / "landed" / name).write_bytes(raw.getvalue())
        if sidecar:
            (tmp_path / "landed" / (name + ".sha256")).write_text(hashlib.sha256(raw.getvalue()).hexdigest() + "  " + name)

    made = dict(venue=F.lit("v"), market_type=F.lit("spot"), symbol=F.lit("AAA"), interval=F.lit("1m"))
    span = (T0, T0 + dt.timedelta(days=40))
    run = lambda have, **options: jobs.import_by_manifest(spark, folder, have, *span, made, work, log, **options)
    put("AAA-1m-2024-01-01.zip", [kline(0), kline(1)])
    put("AAA-1m-2024-01-02.zip", [kline(1440, open="x")])
    bars_, refused, paths = run(spark.createDataFrame([], CANDLE))
    assert (bars_.count(), refused.count(), len(paths)) == (2, 1, 2)
    stored = jobs.stage(bars_, work)
    (tmp_path / "landed" / "AAA-1m-2024-01-01.zip").write_bytes(b"whoever reads this refuses it")
    put("AAA-1m-2024-01-02.zip", [kline(1440)])  # mended: another checksum
    bars_, refused, paths = run(stored)
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["AAA-1m-2024-01-02.zip"] and (bars_.count(), refused.count()) == (3, 0)
    assert run(stored)[2] == []
    assert {r.file_name: r.status for r in jobs.read_manifest(spark, log).collect()} == {"AAA-1m-2024-01-01.zip": "imported", "AAA-1m-2024-01-02.zip": "imported"}
    # A plan takes an absent month's days, and nothing that it does not name.
    put("AAA-1m-2024-01-03.zip", [kline(2880)])
    put("AAA-1m-2024-02-01.zip", [kline(31 * 1440)])
    items = spark.createDataFrame([("monthly", "AAA-1m-2024-01.zip")], "source_type string, file_name string")
    each = spark.createDataFrame([("daily", f"AAA-1m-2024-01-{d:02}.zip", "AAA-1m-2024-01.zip") for d in range(1, 32)], "source_type string, file_name string, parent string")
    assert [p.rsplit("/", 1)[-1] for p in run(stored, plan=items, days=each)[2]] == ["AAA-1m-2024-01-03.zip"]


def test_trailing_newlines_are_refused(spark):
    from barline.functions.text import is_canonical_uuid, is_utc_z

    row = spark.createDataFrame([("1\n", "2024-01-01T00:00:00Z\n", "6ba7b811-9dad-11d1-80b4-00c04fd430c8\n", "2024-01\n")], "n string, t string, u string, p string")
    got = row.select(fields.parse_decimal(F.col("n")), fields.parse_long(F.col("n")), is_utc_z(F.col("t")), is_canonical_uuid(F.col("u")), intervals.period_kind(F.col("p"))).first()
    assert tuple(got) == (None, None, False, False, None)


def test_results_do_not_follow_the_session_zone(spark, tmp_path):
    df = bars(spark, [minute(i) for i in range(1440)])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert resample_complete(df, "1m", "1d").count() == 1
        cover = quality.period_coverage(df, "day").collect()
        assert len(cover) == 1 and cover[0].valid
        write_candles(bars(spark, [minute(-1), minute(0)]), str(tmp_path / "t"))
        assert sorted((r.year, r.month) for r in stored_bars(spark, str(tmp_path / "t")).select("year", "month").collect()) == [("2023", "12"), ("2024", "01")]
        assert scan_candles(spark, str(tmp_path / "t"), {"symbol": "AAA"}, T0, T0 + dt.timedelta(minutes=1)).count() == 1
        assert [r.period for r in plan.archive_plan(spark.createDataFrame([("AAA", "1m", T0, T0 + dt.timedelta(days=31))], "symbol string, interval string, start timestamp, end timestamp"), F.lit(T0 + dt.timedelta(days=60)), "r").collect()] == ["2024-01"]
        b = spark.range(1).select(intervals.period_bounds(F.lit("2024-02")).alias("b")).select(F.unix_seconds("b.start"), F.unix_seconds("b.end")).first()
        assert tuple(b) == (1706745600, 1709251200)
        for name in ("bars_1h", "day_coverage", "month_coverage", "archive_plan", "sync_window", "stored_roundtrip"):
            assert rows_of(QUERIES[name](spark, DATA)) == sql_rows(DATA, SQL[name]), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_illegal_moves(spark):
    df = spark.createDataFrame([("a", 1, "planned"), ("a", 2, "downloading"), ("a", 3, "imported")], "id string, n int, status string")
    bad = manifest.illegal_transitions(df, manifest.ARCHIVE_MOVES, "id", ["n"]).collect()
    assert [(r.previous, r.status) for r in bad] == [("downloading", "imported")]


def test_fallbacks(spark):
    schema = "source_url string, file_name string, period string, status string, fallback_parent_url string"
    m = spark.createDataFrame([("d", "AAA-1m-2024-01-01.zip", "2024-01-01", "fallback_pending", None), ("m", "AAA-1m-2024-01.zip", "2024-01", "fallback_pending", None)], schema)
    whole, part = (bars(spark, [minute(i) for i in range(n)]) for n in (1440, 1439))
    got = lambda c: {r.source_url: r.complete for r in manifest.complete_fallbacks(m, c).collect()}
    assert got(whole) == {"d": True, "m": False} and got(part) == {"d": False, "m": False}
    links = manifest.link_fallback_parents(m).collect()
    assert [(r.child, r.parent, r.conflict) for r in links] == [("d", "m", False)]


