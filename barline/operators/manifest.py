"""Archive manifests: fallbacks, coverage, states and runs, folded from append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import months_between, period_bounds, period_kind, utc_date, utc_floor
from .quality import period_coverage

#: Legal moves of an archive's status.
ARCHIVE_MOVES = [
    ("planned", "downloading"), ("downloading", "downloading"), ("downloading", "downloaded"), ("downloading", "failed"), ("downloading", "fallback_pending"),
    ("downloaded", "downloading"), ("downloaded", "checksum_verified"), ("downloaded", "failed"),
    ("checksum_verified", "imported"), ("checksum_verified", "downloading"), ("checksum_verified", "failed"),
    ("imported", "validated"), ("imported", "downloading"), ("imported", "failed"), ("validated", "downloading"),
    ("failed", "downloading"), ("failed", "fallback_pending"),
    ("fallback_pending", "downloading"), ("fallback_pending", "fallback_complete"), ("fallback_pending", "failed"), ("fallback_complete", "downloading"),
]
#: Legal moves of a message's status, claims and lease ends included.
MESSAGE_MOVES = [
    ("queued", "processing"), ("queued", "failed"), ("queued", "received"), ("received", "failed"), ("received", "processing"),
    ("processing", "completed"), ("processing", "failed"), ("processing", "received"), ("failed", "received"),
]


def missing_archives(plan: DataFrame, cached: DataFrame, days: DataFrame) -> DataFrame:
    """Plan items to import: cached ones, and for each absent month its cached days (`days` is
    the daily expansion of the plan's months, with `parent`); absent days are skipped."""
    have = cached.select("file_name").distinct()
    whole = plan.join(have, "file_name", "left_semi")
    gone = plan.filter("source_type = 'monthly'").join(have, "file_name", "left_anti").select(F.col("file_name").alias("parent"))
    rest = days.join(gone, "parent", "left_semi").join(have, "file_name", "left_semi").select(*plan.columns)
    return whole.unionByName(rest)


def link_fallback_parents(manifest: DataFrame) -> DataFrame:
    """(child, parent, parents): daily items and the monthly item of their symbol and month, by an
    equi join; more than one parent is a conflict."""
    symbol = F.split("file_name", "-")[0]
    kind = period_kind(F.col("period"))
    month = manifest.filter(kind == "month").select(symbol.alias("symbol"), F.col("period").alias("month"), F.col("source_url").alias("parent"), F.col("file_name").alias("parent_file"))
    day = manifest.filter(kind == "day").select(symbol.alias("symbol"), F.left("period", F.lit(7)).alias("month"), "period", F.col("source_url").alias("child"), "file_name")
    pairs = day.join(month, ["symbol", "month"]).filter(F.replace("file_name", F.col("period"), F.col("month")) == F.col("parent_file"))
    links = pairs.groupBy("child").agg(F.min("parent").alias("parent"), F.count_distinct("parent").alias("parents"))
    return links.withColumn("conflict", F.col("parents") > 1)


def complete_fallbacks(manifest: DataFrame, candles: DataFrame, units: tuple[str, ...] = ("day", "month")) -> DataFrame:
    """Pending items (source_url, period, status, parent) with `complete`: the whole UTC period is
    present and valid in the 1-minute bars of the item's symbol (and venue and market_type, where
    the manifest has them), or all days of a month are finished children. Bars are counted for the
    named units only."""
    own = [c for c in ("venue", "market_type") if c in manifest.columns]
    pending = manifest.filter("status = 'fallback_pending'").withColumn("symbol", F.split("file_name", "-")[0]).withColumn("period_start", period_bounds(F.col("period"))["start"])
    minutes = candles.filter("interval = '1m'")
    whole = None
    for unit in units:
        c = period_coverage(minutes, unit).filter("valid").select(*own, "symbol", "period_start", F.lit(unit).alias("kind")).distinct()
        whole = c if whole is None else whole.unionByName(c)
    children = manifest.filter("fallback_parent_url IS NOT NULL AND status IN ('validated', 'fallback_complete')").groupBy(F.col("fallback_parent_url").alias("source_url")).agg(F.count_distinct("period").alias("finished_children"))
    out = pending.withColumn("kind", period_kind(F.col("period"))).join(whole.withColumn("complete", F.lit(True)), [*own, "symbol", "period_start", "kind"], "left").join(children, "source_url", "left")
    days = F.dayofmonth(F.last_day(utc_date(F.col("period_start"))))
    done = (F.col("kind") == "month") & (F.col("finished_children") >= days)
    return out.select("source_url", "period", (F.coalesce("complete", F.lit(False)) | F.coalesce(done, F.lit(False))).alias("complete"), F.coalesce("finished_children", F.lit(0)).alias("finished_children"))


def reconcile_pending(manifest: DataFrame, candles: DataFrame) -> DataFrame:
    """Events (source_url, status, step) that complete pending items: first days whose bars are all there and
    valid, then months that are whole themselves or by their days, those of the first step
    included, so that a month is complete in the run that completes its last day.

    `manifest` holds one row an item (source_url, file_name, period, status and, where known,
    fallback_parent_url); days without a parent are linked to the month of their file name.
    """
    links = link_fallback_parents(manifest).filter("NOT conflict").select(F.col("child").alias("source_url"), F.col("parent").alias("__parent"))
    given = F.col("fallback_parent_url") if "fallback_parent_url" in manifest.columns else F.lit(None).cast("string")
    linked = manifest.join(links, "source_url", "left").withColumn("fallback_parent_url", F.coalesce(given, "__parent")).drop("__parent")
    kind = period_kind(F.col("period"))
    days = complete_fallbacks(linked.filter(kind == "day"), candles, ("day",)).filter("complete").select("source_url", F.lit(True).alias("__done"))
    after = linked.join(days, "source_url", "left").withColumn("status", F.when(F.col("__done"), "fallback_complete").otherwise(F.col("status"))).drop("__done")
    months = complete_fallbacks(after, candles, ("month",)).filter(F.col("complete") & (kind == "month")).select("source_url")
    event = lambda df, step: df.select("source_url", F.lit("fallback_complete").alias("status"), F.lit(step).alias("step"))
    return event(days, 1).unionByName(event(months, 2))


def archive_events(checked: DataFrame, imported: DataFrame, observed_at: Column) -> DataFrame:
    """Manifest events (file_name, status, error_message, observed_at) of an import: checksum_verified
    or failed for every landed file, then imported for those of which rows came in."""
    verified = F.when(F.col("outcome") == "pass", "checksum_verified").otherwise("failed")
    seen = checked.select("file_name", verified.alias("status"), F.when(F.col("outcome") != "pass", F.concat(F.lit("checksum "), F.col("outcome"))).alias("error_message"), F.lit(1).alias("step"))
    done = imported.select(F.col("source_file").alias("file_name"), "status", "error_message", F.lit(2).alias("step"))
    return seen.unionByName(done).withColumn("observed_at", observed_at)


def overlapping_periods(manifest: DataFrame, start: Column, end: Column) -> DataFrame:
    """Items whose calendar period meets [start, end); malformed periods do not."""
    b = period_bounds(F.col("period"))
    return manifest.filter((b["start"] < end) & (b["end"] > start))


def overlapping_ranges(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items beside each (symbol, start, end) range that their period meets. Both sides are cut into
    calendar months first, so the join is on (symbol, month), and reported once per pair."""
    b = period_bounds(F.col("period"))
    items = manifest.withColumn("p", b).filter("p IS NOT NULL").withColumn("month", utc_floor(F.col("p.start"), "month"))
    months = months_between(F.col("start"), F.col("end"))
    cut = ranges.filter("start < end").select("symbol", "start", "end", F.explode(months).alias("month"))
    return items.join(cut, ["symbol", "month"]).filter("p.start < end AND p.end > start").drop("p", "month").distinct()


def status_summary(candles: DataFrame, manifest: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row: 1-minute rows, first and last in range, and failed and pending periods that meet it."""
    bars = candles.filter((F.col("interval") == "1m") & (F.col("open_time") >= start) & (F.col("open_time") < end)).agg(F.count("*").alias("rows"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"))
    periods = overlapping_periods(manifest, start, end).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("fallback_pending")).alias("pending"))
    failed, waiting = periods.first()  # one row
    return bars.withColumns({"failed": F.lit(failed).cast("long"), "pending": F.lit(waiting).cast("long")})


def with_previous(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    return events.withColumn("previous", F.lag("status").over(Window.partitionBy(key).orderBy(*order)))


def illegal_transitions(events: DataFrame, moves: list[tuple[str, str]], key: str, order: list[str]) -> DataFrame:
    """Events whose move from the key's previous status is not among `moves` (a fixed, short list)."""
    allowed = events.sparkSession.createDataFrame(moves, "previous string, status string")
    return with_previous(events, key, order).filter("previous IS NOT NULL").join(F.broadcast(allowed), ["previous", "status"], "left_anti")


def fold_states(events: DataFrame, key: str, order: list[str], restart: str = "downloading", clears: tuple[str, ...] = ("error_message", "completed_at")) -> DataFrame:
    """Current state of each key with how often it restarted and failed. The columns of `clears`
    hold their last value since the latest restart."""
    at = F.struct(*order)
    again = F.max(F.when(F.col("status") == restart, at))
    base = events.groupBy(key).agg(F.max_by("status", at).alias("status"), F.count("*").alias("events"), F.count_if(F.col("status") == restart).alias("attempts"), F.count_if(F.col("status") == "failed").alias("failures"), again.alias("__again"))
    kept = [c for c in clears if c in events.columns]
    if not kept:
        return base.drop("__again")
    since = events.join(base.select(key, "__again"), key).filter(F.col("__again").isNull() | (at >= F.col("__again")))
    last = since.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in kept])
    return base.join(last, key, "left").drop("__again")


def interrupted_runs(runs: DataFrame) -> DataFrame:
    """Unfinished runs that a later run of the same key has overtaken. The next run is looked for
    inside the UTC month, and in the next month that has one where there is none."""
    key = ["venue", "market_type", "symbol", "interval"]
    placed = runs.withColumn("__month", utc_floor(F.col("started_at"), "month"))
    inside = F.lead("started_at").over(Window.partitionBy(*key, "__month").orderBy("started_at", "id"))
    firsts = placed.groupBy(*key, "__month").agg(F.min("started_at").alias("__first"))
    ahead = firsts.withColumn("__ahead", F.lead("__first").over(Window.partitionBy(*key).orderBy("__month"))).drop("__first")  # one row to a month
    later = placed.withColumn("__near", inside).join(ahead, [*key, "__month"])
    runs = later.withColumn("next_started", F.coalesce("__near", "__ahead")).drop("__month", "__near", "__ahead")
    return runs.filter("finished_at IS NULL AND next_started IS NOT NULL").withColumn("status", F.lit("interrupted"))
