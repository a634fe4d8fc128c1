"""Landed kline archives and pages: checksums, lines and strict parsing."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import epoch_to_timestamp, infer_ts_unit, parse_decimal, parse_long
from ..schemas import CANDLE_COLUMNS

MOST_BYTES = 2 * 1024**3
MOST_RATIO = 250
FIELDS = ["open_time", "open", "high", "low", "close", "base_asset_volume", "close_time", "quote_asset_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume", "ignored"]
_DECIMALS = [f for f in FIELDS if f not in ("open_time", "close_time", "trade_count", "ignored")]


def read_files(spark: SparkSession, path: str | list[str], pattern: str = "*.zip") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def archive_lines(files: DataFrame) -> DataFrame:
    """(source_file, line_no, line, error) of landed zips that hold exactly one .csv entry.

    A bad archive is one row with an error, not a failed job: more or other entries, unsafe
    names, over 2 GiB unpacked, or a compression ratio over 250.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_file", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = path.rsplit("/", 1)[-1]
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        fault, entry = _entry_fault(z.infolist())
                        if fault:
                            raise ValueError(fault)
                        with z.open(entry) as raw:
                            held: list[str] = []
                            start = 0
                            for line in io.TextIOWrapper(raw, encoding="utf-8", newline="\n"):
                                held.append(line.rstrip("\r\n"))
                                if len(held) == 10_000:
                                    yield _lines(schema, name, start, held)
                                    start, held = start + len(held), []
                            if held:
                                yield _lines(schema, name, start, held)
                except (ValueError, zipfile.BadZipFile, UnicodeDecodeError, RuntimeError) as error:
                    yield pa.record_batch([[name], [None], [None], [str(error) or type(error).__name__]], schema=schema)

    return files.select("path", "content").mapInArrow(run, "source_file string, line_no long, line string, error string")


def _entry_fault(entries: list[zipfile.ZipInfo]) -> tuple[str | None, zipfile.ZipInfo | None]:
    if len(entries) != 1:
        return f"expected one entry, found {len(entries)}", None
    e = entries[0]
    if e.filename.startswith(("/", "\\")) or ".." in e.filename.replace("\\", "/").split("/"):
        return "unsafe entry name", None
    if not e.filename.lower().endswith(".csv"):
        return "entry is not .csv", None
    if e.file_size > MOST_BYTES:
        return "entry too large", None
    if e.compress_size and e.file_size / e.compress_size > MOST_RATIO:
        return "compression ratio too high", None
    return None, e


def _lines(schema: pa.Schema, name: str, start: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.record_batch([pa.array([name] * n), pa.array(range(start, start + n), pa.int64()), pa.array(lines), pa.nulls(n, pa.string())], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return archive_lines(read_files(spark, path))


def verify_checksums(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(file_name, expected, actual, outcome) of files (path, content) against sidecar texts
    (path, value): the first token is the SHA-256. Outcomes: pass, mismatch, missing, malformed."""
    name = F.element_at(F.split("path", "/"), -1)
    actual = files.select(name.alias("file_name"), F.sha2("content", 256).alias("actual"))
    expected = expected_checksums(sidecars)
    outcome = F.when(F.col("expected").isNull(), "missing").when(~F.col("expected").rlike("^[0-9a-f]{64}$"), "malformed").when(F.col("expected") == F.col("actual"), "pass").otherwise("mismatch")
    return actual.join(expected, "file_name", "left").select("file_name", "expected", "actual", outcome.alias("outcome"))


def expected_checksums(sidecars: DataFrame) -> DataFrame:
    """(file_name, expected) of checksum files (path, value): their first token, for the file that their name speaks of."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(sha256|CHECKSUM)$", "")
    return sidecars.select(name.alias("file_name"), F.lower(F.split(F.trim("value"), r"\s+")[0]).alias("expected"))


def read_sidecars(spark: SparkSession, path: str, pattern: str = "*.sha256") -> DataFrame:
    return read_files(spark, path, pattern).select("path", F.decode("content", "UTF-8").alias("value"))


def _candle(rows: DataFrame, fields: Column, start: Column, end: Column, constants: dict[str, Column], source: str) -> DataFrame:
    """Bars from arrays of 12 texts; `errors` names every field that does not parse."""
    f = {name: F.try_element_at(fields, F.lit(i + 1)) for i, name in enumerate(FIELDS)}
    typed = rows.withColumns({**{d: parse_decimal(f[d]) for d in _DECIMALS}, "trade_count": parse_long(f["trade_count"]), "__o": parse_long(f["open_time"]), "__c": parse_long(f["close_time"])})
    typed = typed.withColumns({"open_time": epoch_to_timestamp(F.col("__o"), infer_ts_unit(F.col("__o"), start, end)), "close_time": epoch_to_timestamp(F.col("__c"), infer_ts_unit(F.col("__c"), start, end))})
    bad = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in FIELDS[:-1]]))
    errors = F.when(F.size(fields) != len(FIELDS), F.array(F.lit("field_count"))).otherwise(bad)
    out = typed.withColumns({"errors": errors, "source": F.lit(source), **constants})
    return out.select(*[F.col(c) for c in CANDLE_COLUMNS], "line_no", "errors")


def parse_kline_csv(lines: DataFrame, start: Column, end: Column, constants: dict[str, Column]) -> DataFrame:
    """Bars (with line_no and errors) from (source_file, line_no, line) rows of 12 comma-separated
    fields. A header counts only on line 0, by its first cell. `constants` gives venue,
    market_type, symbol and interval; start and end fix the unit of the times."""
    header = (F.col("line_no") == 0) & (F.lower(F.trim(F.split("line", ",")[0])) == "open_time")
    rows = lines.filter("line IS NOT NULL").filter(~header)
    return _candle(rows, F.split("line", ","), start, end, constants, "archive")


def parse_kline_json(pages: DataFrame, start: Column, end: Column, constants: dict[str, Column]) -> DataFrame:
    """Bars from (source_file, body) pages: a JSON array of 12-element arrays of strings and numbers."""
    rows = pages.select("source_file", F.posexplode(F.from_json("body", "array<array<string>>")).alias("line_no", "fields")).withColumn("line_no", F.col("line_no").cast("long"))
    return _candle(rows, F.col("fields"), start, end, constants, "rest")
