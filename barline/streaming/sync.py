"""Incremental sync: work windows, and a landing-folder stream that merges and rewrites touched months.

Only months that the work touches are read. What the rest of the table holds is known from the
summaries that are written with each month (`<run log>/months`); a run that died may have left months
newer than their summaries, so the next run first summarizes the months that run named.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.intervals import add_seconds, interval_seconds, touched_months, utc_date
from ..operators.manifest import reconcile_pending
from ..operators.merge import ConflictError, cell_diff, merge
from ..operators.quality import find_gaps, interior_gaps, rule_codes
from ..operators.resample import resample_ladder
from ..schemas import CANDLE, CANDLE_COLUMNS, KEY, ROW_KEY
from ..sources.staging import exists, stage
from ..sources.summaries import append_summary, month_of, read_summary, stored_bars, stored_ends, stored_gaps, stored_months
from ..sources.tables import write_candles
from .runs import Run, close_interrupted, read_runs


def sync_window(watermarks: DataFrame, gaps: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """Per key the range to fetch: from the first gap of the last `days` days, or else the bar after
    the watermark, to `end`; keys that are up to date give no row."""
    floor = add_seconds(end, -days * 86_400)
    first_gap = gaps.filter((F.col("gap_start") >= floor) & (F.col("gap_start") < end)).groupBy(*KEY).agg(F.min("gap_start").alias("first_gap"))
    tail = add_seconds(F.col("watermark"), interval_seconds(F.col("interval")))
    out = watermarks.join(first_gap, KEY, "left").withColumns({"start": F.least("first_gap", tail), "end": end})
    return out.filter("start < end").select(*KEY, "start", "end")


def catchup_split(windows: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(from archives, from pages): what is older than `days` before the end, and the rest."""
    edge = add_seconds(F.col("end"), -days * 86_400)
    archive = windows.withColumn("__e", edge).filter("start < __e").select(*KEY, "start", F.col("__e").alias("end"))
    pages = windows.select(*KEY, F.greatest("start", edge).alias("start"), "end")
    return archive, pages


class BadRowsError(ValueError):
    """Incoming or recently stored bars break a rule; nothing was merged."""


class BootstrapRequired(ValueError):
    """A key has no stored bar and no start to begin at."""


class GapsRemain(RuntimeError):
    """What could be merged was, but the work range still has gaps."""


MONTH = [*KEY[:3], "year", "month"]


def apply_batch(batch: DataFrame, root: str, run_log: str, levels: tuple[str, ...] = ("15m", "1h", "4h", "1d"), base: str = "1m", on_stage: Callable[[str], None] | None = None) -> DataFrame:
    """Merge bars of `base` into the table, roll the touched months up again, rewrite them, check what
    was written against what was meant, and return the run's record.

    The run is logged before the work, at every stage and on every way out; `on_stage` is told each
    stage after it is logged. Replays change nothing. A batch with a row that breaks a rule, or that
    contradicts stored bars or itself, is refused whole: the record says failed, and the error is raised.
    """
    recover(batch.sparkSession, root, run_log)
    run = Run(batch.sparkSession, run_log, on_stage, interval=base)
    return _logged(run, lambda: _merge_batch(batch, root, run_log, levels, base, run, None))


def _logged(run: Run, work: Callable[[], None]) -> DataFrame:
    """Do the work and end the run by what comes of it; a killed process ends nothing."""
    try:
        work()
    except Exception as error:
        run.finish("failed", error)
        raise
    return run.finish("succeeded" if run.row["rows_fetched"] else "noop")


def recover(spark: SparkSession, root: str, run_log: str) -> None:
    """Close the runs that died, and summarize the months that they may have rewritten. A table that was
    written without summaries is summarized whole, once."""
    left = close_interrupted(spark, run_log)
    path = f"{run_log}/months"
    if not exists(spark, path):
        if exists(spark, root):
            append_summary(stored_bars(spark, root), path)
        return
    for work in left:
        append_summary(stored_months(spark, root, spark.read.parquet(work)), path)


def _merge_batch(batch: DataFrame, root: str, run_log: str, levels: tuple[str, ...], base: str, run: Run, windows: DataFrame | None, manifest: str | None = None) -> None:
    spark = batch.sparkSession
    seen = Observation()
    ends = [F.struct(F.min(c), F.max(c)).alias(c) for c in KEY[:3]]
    facts = [F.count(F.lit(1)).alias("rows"), F.count_if((F.size(rule_codes()) > 0) | (F.col("interval") != base)).alias("bad"), F.min(F.unix_micros("open_time")).alias("first"), F.max(F.unix_micros("open_time")).alias("last")]
    incoming = stage(batch.select(*CANDLE_COLUMNS).observe(seen, *facts, *ends), run_log)
    got = seen.get
    run.note(rows_fetched=got["rows"], **{c: low for c in KEY[:3] for low, high in [got[c]] if low == high})  # null over several keys
    if got["rows"] and windows is None:
        run.note(**{f"range_{x}": datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=got[y]) for x, y in (("start", "first"), ("end", "last"))})
    if got["bad"]:
        raise BadRowsError(f"{got['bad']} incoming bars break a rule")
    months = month_of(incoming).select(*MONTH)
    if windows is not None:
        day = utc_date(F.col("month"))
        months = months.unionByName(touched_months(windows).select(*KEY[:3], F.date_format(day, "yyyy").alias("year"), F.date_format(day, "MM").alias("month")))
    elif not got["rows"]:
        return
    months = months.distinct()
    work = f"{run_log}/touched/{run.row['id']}"
    months.write.parquet(work)
    months = spark.read.schema(months.schema).parquet(work)
    run.advance("merge", work=work)
    stored = stage(stored_months(spark, root, months).filter(F.col("interval") == base).select(*CANDLE_COLUMNS), run_log)
    result = merge(stored, incoming)
    clash = result.conflicts.limit(1).collect()
    if clash:
        raise ConflictError(f"an incoming bar contradicts another: {clash[0].asDict()}")
    known = stored_ends(read_summary(spark, f"{run_log}/months").filter(F.col("interval") == base)).drop("interval")
    added = Observation()
    between = result.inserted.join(known, KEY[:3], "left").withColumn("__fills", F.coalesce((F.col("open_time") > F.col("first_open")) & (F.col("open_time") < F.col("watermark")), F.lit(False)))
    fresh = stage(between.observe(added, F.count(F.lit(1)).alias("rows"), F.count_if("__fills").alias("fills")).select(*CANDLE_COLUMNS), run_log)
    run.note(rows_inserted=added.get["rows"], rows_repaired=added.get["fills"])
    whole = stored.unionByName(fresh)
    run.advance("validate")
    run.note(gaps_remaining=(interior_gaps(whole) if windows is None else find_gaps(whole, windows)).count())
    if manifest:
        run.advance("reconcile")
        events = reconcile_pending(read_items(spark, manifest), whole).withColumn("observed_at", F.current_timestamp())
        append_items(events, manifest)
    if added.get["rows"]:
        run.advance("aggregate")
        everything = stage(_with_levels(whole, levels, base), run_log)
        run.advance("export")
        write_candles(everything, root)
        append_summary(everything, f"{run_log}/months")
        run.advance("verify")
        written = stored_months(spark, root, months)
        if cell_diff(everything, written.select(*CANDLE_COLUMNS)).limit(1).count():
            raise RuntimeError("written bars differ from the merged ones")
        run.note(partitions_verified=written.select(*KEY, "year", "month").distinct().count())
    if windows is not None and run.row["gaps_remaining"]:
        raise GapsRemain(f"{run.row['gaps_remaining']} gaps remain in the work range")


#: Events of manifest items; an item is described by its first event, later ones only change its status.
ITEMS = "source_url string, file_name string, period string, status string, fallback_parent_url string, step int, observed_at timestamp"


def append_items(events: DataFrame, manifest: str) -> None:
    names = [x.split()[0] for x in ITEMS.split(", ")]
    events.select(*[F.col(n) if n in events.columns else F.lit(None).cast("string").alias(n) for n in names]).write.mode("append").parquet(manifest)


def read_items(spark: SparkSession, manifest: str) -> DataFrame:
    """One row an item: its newest status, and what its events tell of it."""
    events = spark.read.schema(ITEMS).parquet(manifest)
    told = [F.max(c).alias(c) for c in ("file_name", "period", "fallback_parent_url")]
    return events.groupBy("source_url").agg(F.max_by("status", F.struct("observed_at", "step")).alias("status"), *told)


def _with_levels(bars: DataFrame, levels: tuple[str, ...], base: str) -> DataFrame:
    out = bars
    for rolled in resample_ladder(bars, levels, base).values():
        out = out.unionByName(rolled)
    return out


def sync(
    spark: SparkSession, available: DataFrame, keys: DataFrame, root: str, run_log: str, end: datetime, days: int = 7, levels: tuple[str, ...] = ("15m", "1h", "4h", "1d"), base: str = "1m", on_stage: Callable[[str], None] | None = None, manifest: str | None = None
) -> DataFrame:
    """One sync up to `end`: the work window of each key (from the first recent gap, else after the
    newest bar), the landed bars inside it, one merge. Returns the run's record.

    Keys (venue, market_type, symbol, interval, start) without stored bars begin at `start`; where it is
    null they need a bootstrap first, and the run fails. Runs that died are closed as interrupted. A
    run is refused while stored bars of the last `days` days break a rule or repeat a key, and it fails
    when its work range still has gaps at the end, with what could be merged in place. With a `manifest`
    (events of archive items) pending days and months that the touched months now hold whole are
    completed in it.
    """
    recover(spark, root, run_log)
    limit_at = end.astimezone(timezone.utc) if end.tzinfo else end.replace(tzinfo=timezone.utc)
    limit = F.lit(limit_at)
    summary = stage(read_summary(spark, f"{run_log}/months").filter(F.col("interval") == base), run_log)
    stored = stored_ends(summary)
    known = sync_window(stored.drop("first_open"), stored_gaps(summary), limit, days)
    unknown = keys.join(stored, KEY, "left_anti")
    fresh = unknown.select(*KEY, "start", limit.alias("end")).filter("start < end")
    windows = stage(known.unionByName(fresh), run_log)
    first = windows.agg(F.unix_micros(F.min("start"))).first()[0]
    begin = None if first is None else datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=first)
    run = Run(spark, run_log, on_stage, interval=base, range_start=begin, range_end=limit_at)

    def work() -> None:
        empty = [tuple(r) for r in unknown.filter("start IS NULL").select(*KEY).limit(1).collect()]
        if empty:
            run.note(stage="bootstrap_required")
            raise BootstrapRequired(f"{empty[0]} has no stored bars; give a start or run the historical import first")
        if begin is None:
            return
        recent = touched_months(windows.select(*KEY[:3], F.greatest("start", F.lit(limit_at - timedelta(days=days))).alias("start"), "end"))
        day = utc_date(F.col("month"))
        months = stage(recent.select(*KEY[:3], F.date_format(day, "yyyy").alias("year"), F.date_format(day, "MM").alias("month")).distinct(), run_log)
        if summary.join(months, MONTH, "left_semi").filter("bad_rows > 0").limit(1).count():
            raise BadRowsError("recently stored bars break a rule")
        if stored_months(spark, root, months).filter(F.col("interval") == base).groupBy(*ROW_KEY).count().filter("count > 1").limit(1).count():
            raise BadRowsError("recently stored bars repeat a key")
        # older than `days` days from archives, the rest from pages; both have landed in `available`
        old, new = catchup_split(windows, days)
        rows = available.filter(F.col("interval") == base).join(old.unionByName(new), KEY).filter("open_time >= start AND open_time < end").select(*CANDLE_COLUMNS)
        _merge_batch(rows, root, run_log, levels, base, run, windows, manifest)

    return _logged(run, work)


def incremental_sync(spark: SparkSession, landing: str, root: str, run_log: str, checkpoint: str) -> StreamingQuery:
    """Process every landed Parquet file of bars once, then stop; the checkpoint remembers which."""
    stream = spark.readStream.schema(CANDLE).parquet(landing)
    return stream.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, root, run_log) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
