"""Run records: one before the work, one at every stage and one at the end, folded by run id.

A process that dies leaves its last stage behind, still 'running'; the next run logs it as
interrupted. What ended a run stays: a record that comes after it changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import exists
from ..sources.tables import append_run_record

#: A run's record; counters are there from the first one on.
RUN = """id string, venue string, market_type string, symbol string, interval string, range_start timestamp, range_end timestamp, stage string, status string, rows_fetched long, rows_inserted long,
    rows_repaired long, gaps_remaining long, partitions_verified long, started_at timestamp, finished_at timestamp, error_message string, work string, step int, observed_at timestamp"""
FIELDS = [x.split()[0] for x in RUN.split(",")]
COUNTERS = ("rows_fetched", "rows_inserted", "rows_repaired", "gaps_remaining", "partitions_verified")


class Run:
    """A run that logs itself: `Run(...)` begins it, `advance` names the next stage, `finish` ends it."""

    def __init__(self, spark: SparkSession, run_log: str, on_stage: Callable[[str], None] | None = None, **fields):
        self.spark, self.log, self.on_stage = spark, run_log, on_stage
        self.row = dict.fromkeys(FIELDS) | dict.fromkeys(COUNTERS, 0)
        self.row |= {"id": str(uuid.uuid4()), "started_at": datetime.now(timezone.utc), "stage": "starting", "status": "running", "step": 0} | fields
        self._append()

    def _append(self) -> None:
        self.row["observed_at"] = datetime.now(timezone.utc)
        append_run_record(self.record(), f"{self.log}/runs")

    def record(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(self.row[f] for f in FIELDS)], RUN)

    def note(self, **fields) -> None:
        """Fields for the next record."""
        self.row |= fields

    def advance(self, stage: str, **fields) -> None:
        self.row |= {"stage": stage, "step": self.row["step"] + 1} | fields
        self._append()
        if self.on_stage:
            self.on_stage(stage)

    def finish(self, status: str, error: Exception | None = None) -> DataFrame:
        stage = self.row["stage"] if error else "complete"
        self.row |= {"status": status, "stage": stage, "step": self.row["step"] + 1, "finished_at": datetime.now(timezone.utc)}
        if error:
            self.row["error_message"] = f"{type(error).__name__}: {error}"[:1000]
        self._append()
        return self.record()


def run_events(spark: SparkSession, run_log: str) -> DataFrame:
    """Every record of every run."""
    path = f"{run_log}/runs"
    return spark.read.schema(RUN).json(path) if exists(spark, path) else spark.createDataFrame([], RUN)


def fold_runs(events: DataFrame) -> DataFrame:
    """The state of each run: the first record that ended it, else the newest."""
    at, x = F.struct("observed_at", "step"), F.struct(*[c for c in events.columns if c != "id"])
    ended = F.min_by(x, F.when(F.col("status") != "running", at))
    return events.groupBy("id").agg(F.coalesce(ended, F.max_by(x, at)).alias("x")).select("id", "x.*")


def read_runs(spark: SparkSession, run_log: str) -> DataFrame:
    return fold_runs(run_events(spark, run_log))


def close_interrupted(spark: SparkSession, run_log: str) -> list[str]:
    """Log every run that is still 'running' as interrupted, and return the work tables they left. Runs of one
    table do not overlap, so there are as many as processes died since the last run."""
    left = read_runs(spark, run_log).filter("status = 'running'").collect()
    if left:
        now = datetime.now(timezone.utc)
        rows = [tuple((r.asDict() | {"status": "interrupted", "finished_at": now, "observed_at": now, "step": (r.step or 0) + 1})[f] for f in FIELDS) for r in left]
        append_run_record(spark.createDataFrame(rows, RUN), f"{run_log}/runs")
    return [r.work for r in left if r.work]
