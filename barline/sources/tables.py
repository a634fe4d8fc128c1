"""Month-partitioned bar tables, their inventory and schema checks, and run logs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intervals import utc_date
from ..schemas import CANDLE_COLUMNS, KEY, SCHEMA_VERSION, STORED
from .staging import exists

PARTITION = [*KEY, "year", "month"]
PLACED = T.StructType([*STORED.fields, T.StructField("year", T.StringType()), T.StructField("month", T.StringType())])


def write_candles(df: DataFrame, root: str, version: str = SCHEMA_VERSION, order: str | Column = "open_time") -> None:
    """Rewrite whole UTC months: one ZSTD file per key and month, sorted by `order`, under
    venue=/market_type=/symbol=/interval=/year=/month=. Months not in `df` stay as they are. Times
    are stored in microseconds whatever the session writes otherwise."""
    day = utc_date(F.col("open_time"))
    rows = df.withColumns({"schema_version": F.lit(version), "year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM")})
    # A key that is a literal in the plan would drop out of the sort, and the writer would then sort anew, without `order`.
    nothing = F.substring(F.coalesce("year", F.lit("")), 1, 0)
    rows = rows.withColumns({k: F.concat(k, nothing) for k in KEY})
    placed = rows.select("schema_version", *CANDLE_COLUMNS, "year", "month").repartition(*PARTITION).sortWithinPartitions(*PARTITION, order)
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    conf, name = df.sparkSession.conf, "spark.sql.parquet.outputTimestampType"  # no writer option, only a setting
    before = conf.get(name)
    conf.set(name, "TIMESTAMP_MICROS")
    try:
        writer.partitionBy(*PARTITION).parquet(root)
    finally:
        conf.set(name, before)


def read_candles(spark: SparkSession, root: str) -> DataFrame:
    """All stored bars in contract column order, with year and month for pruning."""
    return spark.read.schema(PLACED).parquet(root).select("schema_version", *CANDLE_COLUMNS, "year", "month")


def scan_candles(spark: SparkSession, root: str, key: dict[str, str], start: datetime, end: datetime) -> DataFrame:
    """Bars of a key in [start, end), naive times being UTC. The month predicates prune partitions
    before any file is opened."""
    start, end = (at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc) for at in (start, end))
    df = read_candles(spark, root)
    for column, value in key.items():
        df = df.filter(F.col(column) == value)
    month = F.concat("year", "month")
    df = df.filter((month >= f"{start:%Y%m}") & (month <= f"{end:%Y%m}"))
    return df.filter((F.col("open_time") >= F.lit(start)) & (F.col("open_time") < F.lit(end))).select(*CANDLE_COLUMNS)


def page_candles(df: DataFrame, after: Column, limit: int) -> DataFrame:
    """The next bars of one key after a time, at most `limit` (1 to 4096)."""
    if not 1 <= limit <= 4096:
        raise ValueError("limit must be 1 to 4096")
    return df.filter(F.col("open_time") > after).orderBy("open_time").limit(limit)


def expected_partitions(keys: DataFrame, months: DataFrame) -> DataFrame:
    """Every month of each key's range as the path of its partition. `months` has the key columns
    and a month timestamp."""
    parts = [F.concat(F.lit(f"{k}="), F.col(k)) for k in KEY]
    return keys.join(months, KEY).select(F.concat_ws("/", *parts, F.date_format(utc_date(F.col("month")), "'year='yyyy"), F.date_format(utc_date(F.col("month")), "'month='MM")).alias("partition")).distinct()


def partition_inventory(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """(partition, status, files): expected month partitions against the files found. Statuses:
    ok, missing, extra, empty_file, stray_part and several_files. Only paths and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    inside = F.regexp_extract("path", r"(venue=[^/]*/market_type=[^/]*/symbol=[^/]*/interval=[^/]*/year=\d{4}/month=\d{2})/[^/]+$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(F.when(inside != "", inside).otherwise(F.col("path")).alias("partition"), "length", name.endswith(".part").alias("stray"), name.endswith(".parquet").alias("data"))
    by = found.filter("stray OR data").groupBy("partition").agg(F.count_if("data").alias("files"), F.count_if(F.col("length") == 0).alias("empty"), F.count_if("stray").alias("strays"))
    both = expected.withColumn("wanted", F.lit(True)).join(by, "partition", "full_outer")
    status = (
        F.when(F.col("wanted").isNull(), "extra").when(F.col("files").isNull(), "missing").when(F.col("strays") > 0, "stray_part")
        .when(F.col("empty") > 0, "empty_file").when(F.col("files") > 1, "several_files").otherwise("ok")
    )
    return both.select("partition", status.alias("status"), F.coalesce("files", F.lit(0)).alias("files"))


def _nulls(file: pq.ParquetFile, column: str) -> int:
    """Nulls of a column by the statistics of its row groups; one without statistics is read, that column alone."""
    at = file.schema_arrow.get_field_index(column)
    total = 0
    for i in range(file.metadata.num_row_groups):
        found = file.metadata.row_group(i).column(at).statistics
        total += found.null_count if found is not None and found.has_null_count else file.read_row_group(i, columns=[column]).column(0).null_count
    return total


def _schema_fault(source, expected: dict[str, str], required: tuple[str, ...]) -> str | None:
    """What tells a file from the expected column names and Arrow types, or which required columns hold nulls."""
    try:
        file = pq.ParquetFile(source)
    except pa.ArrowInvalid as error:
        return str(error)
    have = {f.name: str(f.type) for f in file.schema_arrow}
    wrong = sorted(k for k in have.keys() | expected.keys() if have.get(k) != expected.get(k))
    faults = [f"{k}: {have.get(k)} for {expected.get(k)}" for k in wrong]
    faults += [f"{k}: {n} nulls" for k in sorted(required) if k in have and (n := _nulls(file, k))]
    return "; ".join(faults) or None


def check_schema(spark: SparkSession, root: str, expected: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """(path, problem) for each Parquet file whose column names and Arrow types differ from
    `expected` (name: type), whose `required` columns hold nulls, or that is no Parquet. Only footers are
    read (nulls are counted in their statistics), unless a file lies in a store that Arrow cannot open:
    such files are read through Spark."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    store, inside = pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                    with store.open_input_file(inside) as source:
                        rows.append((path, True, _schema_fault(source, expected, required)))
                except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    rows.append((path, False, None))
            path, opened, problem = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(path, pa.string()), pa.array(opened, pa.bool_()), pa.array(problem, pa.string())], names=["path", "opened", "problem"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problem = [_schema_fault(pa.BufferReader(x.as_buffer()), expected, required) for x in batch.column("content")]
            yield pa.record_batch([batch.column("path"), pa.array(problem, pa.string())], names=["path", "problem"])

    seen = listed.select("path").mapInArrow(footers, "path string, opened boolean, problem string")
    found = seen.filter("opened").select("path", "problem")
    if seen.filter("NOT opened").limit(1).count():
        closed = seen.filter("NOT opened").select("path")
        found = found.unionByName(listed.join(closed, "path", "left_semi").select("path", "content").mapInArrow(bodies, "path string, problem string"))
    return found.filter("problem IS NOT NULL")


def append_run_record(record: DataFrame, path: str) -> None:
    """Append run records as JSON lines; absent values are left out."""
    record.write.mode("append").json(path)


def latest_run(runs: DataFrame, key: list[str], order: str = "observed_at") -> DataFrame:
    rest = [c for c in runs.columns if c not in key]
    return runs.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


QUARANTINE = "event_id string, occurred_at timestamp, kind string, source_uri string, message_id string, raw_sha256 string, error_text string, batch string"


def write_quarantine(rejected: DataFrame, path: str, batch: str) -> None:
    """Append (occurred_at, kind, source_uri, message_id, raw_sha256, error_text) events of a batch, each once.

    An event's key holds the batch and all of the event but its time. What the batch has logged before
    is looked up in its own partition and not logged again.
    """
    spark = rejected.sparkSession
    facts = ["kind", "source_uri", "message_id", "raw_sha256", "error_text"]
    key = F.sha2(F.to_json(F.struct(F.lit(batch).alias("batch"), *facts)), 256).alias("event_id")
    events = rejected.select(key, "occurred_at", *facts, F.lit(batch).alias("batch")).dropDuplicates(["event_id"])
    if exists(spark, path):
        logged = spark.read.schema(QUARANTINE).parquet(path).filter(F.col("batch") == batch).select("event_id")
        events = events.join(logged, "event_id", "left_anti")
    events.write.mode("append").partitionBy("batch").parquet(path)


def write_artifacts(artifacts: DataFrame, path: str, batch: str) -> None:
    """The artifacts of a batch's messages, as one partition that is written anew each time."""
    rows = artifacts.withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


DECISIONS = "id string, version int, title string, status string, body string, source_message_id string"
#: States of a decision.
DECISION_STATES = ("proposed", "accepted", "superseded", "rejected")


def put_decisions(rows: DataFrame, path: str, order: str) -> None:
    """Append decisions (id, version, title, status, body, source_message_id): a null version is the one after
    the newest, in `order` within the batch. Rows of an unknown status, and versions that are not above all stored and
    earlier ones, are refused, and with them the batch."""
    spark = rows.sparkSession
    stored = spark.read.schema(DECISIONS).parquet(path) if exists(spark, path) else spark.createDataFrame([], DECISIONS)
    newest = stored.groupBy("id").agg(F.max("version").alias("latest"))
    given = rows.join(newest, "id", "left").withColumn("latest", F.coalesce("latest", F.lit(0)))
    here = Window.partitionBy("id").orderBy(order)
    # Numbered rows rise by one from the newest version or the last explicit one before them.
    reset = F.max(F.when(F.col("version").isNotNull(), F.struct(F.col("at").alias("at"), F.col("version").alias("v")))).over(here)
    placed = given.withColumn("at", F.row_number().over(here)).withColumn("reset", reset)
    number = F.when(F.col("reset").isNull(), F.col("latest") + F.col("at")).otherwise(F.col("reset.v") + F.col("at") - F.col("reset.at"))
    placed = placed.withColumn("number", number.cast("int"))
    before = F.coalesce(F.max("number").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("latest"))
    checked = placed.withColumn("fault", F.when(~F.coalesce(F.col("status").isin(*DECISION_STATES), F.lit(False)), "status").when((F.col("number") <= before) | (F.col("number") < 1), "version"))
    bad = checked.filter("fault IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"decision {bad[0].id} version {bad[0].number}: bad {bad[0].fault}")
    checked.select("id", F.col("number").alias("version"), "title", "status", "body", "source_message_id").write.mode("append").parquet(path)


def get_decision(spark: SparkSession, path: str, id: str, version: int | None = None) -> DataFrame:
    """One version of a decision, by default the newest; no row if there is none. The id is pushed to the scan."""
    rows = spark.read.schema(DECISIONS).parquet(path).filter(F.col("id") == id)
    return rows.filter(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version")).limit(1)
