"""End-to-end jobs built from the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import touched_months
from ..operators.merge import cell_diff, insert_only_merge, reconcile
from ..operators.manifest import archive_events, missing_archives, reconcile_pending
from ..operators.quality import clip_to_range, file_ranges, find_gaps, order_violations, split_by_file, split_repairable, validate_range, validate_repair
from ..operators.resample import resample_complete
from ..schemas import CANDLE, CANDLE_COLUMNS, KEY, PRICES, SCHEMA_VERSION, VOLUMES
from ..sources.archives import archive_lines, expected_checksums, parse_kline_csv, read_files, read_sidecars, verify_checksums
from ..sources.staging import exists, stage
from ..sources.tables import check_schema, expected_partitions, partition_inventory, read_candles, write_candles

#: Arrow types of a stored file: the contract less the partition columns.
STORED_ARROW = {
    "schema_version": "string", "open_time": "timestamp[us, tz=UTC]", **{c: "decimal128(38, 18)" for c in (*PRICES, *VOLUMES)}, "close_time": "timestamp[us, tz=UTC]",
    "trade_count": "int64", "source": "string", "source_file": "string",
}


def import_files(files: DataFrame, sidecars: DataFrame, existing: DataFrame, start: datetime, end: datetime, constants: dict[str, Column], work: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(merged bars, refused files with their reason, file ranges, manifest events) of landed archives
    (path, content) and their checksum files (path, value).

    A file is refused whole for a bad checksum, an unreadable archive, a field that does not parse, a
    broken rule or a repeated key; conflicts with stored bars, or between files, raise.
    """
    files = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    checked = stage(verify_checksums(files, sidecars), work)
    passed = checked.filter("outcome = 'pass'").select("file_name")
    lines = stage(archive_lines(files.join(passed, "file_name", "left_semi")), work)
    bars = stage(parse_kline_csv(lines, F.lit(start), F.lit(end), constants), work)
    unread = lines.filter("error IS NOT NULL").select("source_file", F.col("error").alias("reason"))
    broken = bars.filter(F.size("errors") > 0).groupBy("source_file").agg(F.concat(F.lit("bad fields: "), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))), ",")).alias("reason"))
    readable = bars.join(broken.select("source_file"), "source_file", "left_anti").drop("errors")
    valid, rejected = split_by_file(readable)
    ruled = rejected.select("source_file", F.lit("broken rule or repeated key").alias("reason")).distinct()
    unverified = checked.filter("outcome <> 'pass'").select(F.col("file_name").alias("source_file"), F.concat(F.lit("checksum "), F.col("outcome")).alias("reason"))
    refused = stage(unverified.unionByName(unread).unionByName(broken).unionByName(ruled), work)
    wanted = stage(clip_to_range(valid, F.lit(start), F.lit(end)).select(*CANDLE_COLUMNS), work)
    ranges = file_ranges(wanted)
    imported = ranges.select("source_file", F.lit("imported").alias("status"), F.lit(None).cast("string").alias("error_message"))
    failed = refused.join(passed.withColumnRenamed("file_name", "source_file"), "source_file", "left_semi").select("source_file", F.lit("failed").alias("status"), F.col("reason").alias("error_message"))
    return insert_only_merge(existing, wanted), refused, ranges, archive_events(checked, imported.unionByName(failed), F.current_timestamp())


def import_archives(spark: SparkSession, path: str, existing: DataFrame, start: datetime, end: datetime, constants: dict[str, Column], work: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """import_files of the archives and checksum files that landed under `path`."""
    return import_files(read_files(spark, path), read_sidecars(spark, path), existing, start, end, constants, work)


MANIFEST = "file_name string, status string, error_message string, step int, observed_at timestamp, checksum string"
#: States in which a file's bars are in the table.
IMPORTED = ("imported", "validated", "fallback_complete")


def read_manifest(spark: SparkSession, log: str) -> DataFrame:
    """The newest state of each archive file, folded from the events that imports have appended."""
    events = spark.read.schema(MANIFEST).parquet(log) if exists(spark, log) else spark.createDataFrame([], MANIFEST)
    newest = F.max_by(F.struct("status", "error_message", "checksum"), F.struct("observed_at", "step"))
    return events.groupBy("file_name").agg(newest.alias("x")).select("file_name", "x.*")


def import_by_manifest(
    spark: SparkSession, path: str, existing: DataFrame, start: datetime, end: datetime, constants: dict[str, Column], work: str, log: str, plan: DataFrame | None = None, days: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(merged bars, refused files, paths read) of the archives under `path` that the manifest at `log` does not
    hold as imported under the checksum of their checksum file; the events are appended to it.

    Only names and checksum files are read of the others. With a `plan` (and the `days` of its
    months) only planned files are taken, and for an absent month its days. A file whose checksum
    file changed, that failed before or that has none is read again.
    """
    landed = read_files(spark, path).select("path").withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    sidecars = read_sidecars(spark, path)
    sums = expected_checksums(sidecars)
    if plan is not None:
        wanted = missing_archives(plan, landed, days if days is not None else plan.limit(0).withColumn("parent", F.lit("")))
        landed = landed.join(wanted.select("file_name"), "file_name", "left_semi")
    held = read_manifest(spark, log).filter(F.col("status").isin(*IMPORTED)).select("file_name", F.col("checksum").alias("expected"))
    fresh = landed.join(sums, "file_name", "left").join(held, ["file_name", "expected"], "left_anti")
    paths = [r.path for r in fresh.select("path").orderBy("path").collect()]  # names alone, which a file index holds anyway
    if not paths:
        return existing, spark.createDataFrame([], "source_file string, reason string"), []
    merged, refused, _, events = import_files(read_files(spark, paths), sidecars, existing, start, end, constants, work)
    named = events.join(sums.withColumnRenamed("expected", "checksum"), "file_name", "left")
    named.select("file_name", "status", "error_message", "step", "observed_at", "checksum").write.mode("append").parquet(log)
    return merged, refused, paths


def repair_from_pages(existing: DataFrame, pages: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged bars, gaps with their repair status): gaps of the expected ranges filled from page
    rows; a gap merges only if its rows cover it complete and valid. Over-long gaps raise."""
    gaps, refused = split_repairable(find_gaps(existing, expected))
    if refused.limit(1).count():
        raise ValueError("a gap is too long to repair")
    state = validate_repair(pages, gaps)
    good = pages.join(state.filter("complete").select(*KEY, "gap_start", "gap_end"), KEY).filter("open_time >= gap_start AND open_time < gap_end").select(*CANDLE_COLUMNS)
    return insert_only_merge(existing, good), state


def repair_and_reconcile(existing: DataFrame, pages: DataFrame, expected: DataFrame, manifest: DataFrame, work: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """repair_from_pages, and the manifest events of the pending days and months that the repaired bars complete."""
    merged, state = repair_from_pages(existing, pages, expected)
    merged = stage(merged, work)
    return merged, state, reconcile_pending(manifest, merged)


def resample_months(minutes: DataFrame, stored: DataFrame, work: str, levels: tuple[str, ...] = ("15m", "1h", "4h", "1d"), base: str = "1m") -> DataFrame:
    """Complete coarser bars of the bars of `base`, each level staged and built from the one below,
    merged into the stored ones."""
    rolled, lower, rows = None, base, minutes
    for level in levels:
        rows = stage(resample_complete(rows, lower, level).withColumn("source_file", F.lit(f"canonical:{base}")), work)
        rolled = rows if rolled is None else rolled.unionByName(rows)
        lower = level
    return stored if rolled is None else insert_only_merge(stored, rolled)


def export(spark: SparkSession, bars: DataFrame, expected: DataFrame, root: str) -> DataFrame:
    """Write the bars if every expected range is valid; returns the range report, raises otherwise."""
    report = validate_range(bars, expected)
    if report.filter("NOT valid").limit(1).count():
        raise ValueError("a range has gaps or bad rows; nothing was exported")
    write_candles(bars, root)
    return report


def verification_issues(spark: SparkSession, bars: DataFrame, root: str, expected: DataFrame, arrow_schema: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(partition inventory, one row (issue) for everything that tells the stored table from the bars):
    missing, extra or doubled files, other schemas or versions, rows out of order or repeated in
    their file, and every cell that differs or stands on one side only. A table whose footers are
    wrong is not read further."""
    keys = expected.select(*KEY).distinct()
    months = touched_months(expected.select(*KEY, "start", "end")).select(*KEY, "month")
    inventory = partition_inventory(spark, root, expected_partitions(keys, months))
    schema = check_schema(spark, root, arrow_schema, tuple(arrow_schema))
    issue = lambda df, *parts: df.select(F.concat_ws(" ", *parts).alias("issue"))
    at = F.concat_ws(" ", "symbol", "interval", F.unix_micros("open_time").cast("string"))
    found = issue(inventory.filter("status <> 'ok'"), F.lit("partition"), F.col("status"), F.col("partition")).unionByName(issue(schema, F.lit("schema"), F.col("path"), F.col("problem")))
    if schema.limit(1).count():
        return inventory, found
    stored = read_candles(spark, root).select("schema_version", *CANDLE_COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_no"))
    version = stored.filter(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)))
    order = order_violations(stored.filter("open_time IS NOT NULL"), "file", "row_no")
    cells = cell_diff(bars.select(*CANDLE_COLUMNS), stored.select(*CANDLE_COLUMNS))
    found = found.unionByName(issue(version, F.lit("version"), F.col("schema_version"), at)).unionByName(issue(order, F.lit("order"), at))
    return inventory, found.unionByName(issue(cells, F.lit("cell"), F.col("column"), at))


def verify(spark: SparkSession, bars: DataFrame, root: str, expected: DataFrame, arrow_schema: dict[str, str] = STORED_ARROW, work: str | None = None) -> DataFrame:
    """One row: partitions expected and ok, how many issues there are, the first 20, and passed."""
    inventory, issues = verification_issues(spark, bars, root, expected, arrow_schema)
    issues = stage(issues, work) if work else issues
    expected_n, ok_n = inventory.agg(F.count_if(F.col("status") != "extra"), F.count_if(F.col("status") == "ok")).first()
    total = issues.count()
    first = [r.issue for r in issues.orderBy("issue").limit(20).collect()]
    return spark.createDataFrame([(expected_n, ok_n, total, first, total == 0)], "partitions_expected long, partitions_ok long, issues_found long, issues array<string>, passed boolean")


def compare_published(ours: DataFrame, published: DataFrame) -> DataFrame:
    """Counts of equal, different and one-sided bars."""
    return reconcile(ours, published).groupBy("interval", "status").agg(F.count("*").alias("bars"))


def full_build(
    files: DataFrame, sidecars: DataFrame, pages: DataFrame, expected: DataFrame, start: datetime, end: datetime, constants: dict[str, Column], root: str, work: str, levels: tuple[str, ...] = ("15m", "1h", "4h", "1d"), base: str = "1m"
) -> DataFrame:
    """Import, repair, roll up, validate and export; returns the range report."""
    spark = files.sparkSession
    minutes, _, _, _ = import_files(files, sidecars, spark.createDataFrame([], CANDLE), start, end, constants, work)
    minutes = stage(minutes, work)
    minutes = stage(repair_from_pages(minutes, pages, expected)[0], work)
    return export(spark, stage(resample_months(minutes, minutes, work, levels, base), work), expected, root)
