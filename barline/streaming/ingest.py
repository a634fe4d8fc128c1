"""Message ingest from an inbox folder: every batch takes effect once, however often it is run.

Accepted messages are known by id, quarantined events by a key that holds the batch, and artifacts are
made anew from the batch's own messages. A process that dies between two writes leaves a batch that,
run again under its id, adds exactly what was missing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import canonical_json
from ..operators.messages import classify_messages, explode_artifacts, ingest_outcomes, validate_envelopes
from ..sources.envelopes import parse_envelopes
from ..sources.staging import stage
from ..sources.tables import write_artifacts, write_quarantine

MESSAGES = "id string, canonical_hash string, json string, source_uri string, batch string"
_ARTIFACTS = "array<struct<name: string, uri: string, url: string, sha256: string, kind: string>>"


def ingest_batch(files: DataFrame, messages: str, quarantine: str, work: str, roles: list[str], batch: str | None = None, artifacts: str | None = None) -> DataFrame:
    """Validate and classify landed files (path, content), append accepted messages, their artifacts (where
    a folder is named) and quarantined rejects, and return the outcome counts.

    A batch run again under its id changes nothing that it has written and adds what it has not; another
    batch with the same files accepts nothing twice and logs its own rejects.
    """
    spark = files.sparkSession
    batch = batch or uuid.uuid4().hex
    rows = validate_envelopes(parse_envelopes(files), "json", roles)
    rows = stage(rows.withColumns({"id": F.lower(F.get_json_object("json", "$.id")), "canonical_hash": F.sha2(canonical_json(F.col("json")), 256), "arrival": F.col("source_uri")}), work)
    valid = rows.filter("json IS NOT NULL AND size(codes) = 0")
    known = spark.read.schema(MESSAGES).parquet(messages)
    classified = stage(classify_messages(valid, known), work)
    accepted = classified.filter("outcome = 'accepted'").select("id", "canonical_hash", "json", "source_uri", F.lit(batch).alias("batch"))
    accepted.write.mode("append").parquet(messages)
    if artifacts:
        own = spark.read.schema(MESSAGES).parquet(messages).filter(F.col("batch") == batch)
        each = own.select(F.col("id").alias("message_id"), F.from_json(F.get_json_object("json", "$.artifacts"), _ARTIFACTS).alias("artifacts"))
        write_artifacts(explode_artifacts(each, ["message_id"]), artifacts, batch)
    invalid = rows.filter("json IS NULL OR size(codes) > 0").select("source_uri", "raw_sha256", F.lit(None).cast("string").alias("message_id"), F.lit("invalid").alias("kind"), F.when(F.col("json").isNull(), "json").otherwise(F.array_join("codes", ",")).alias("error_text"))
    clash = classified.filter("outcome = 'integrity_conflict'").select("source_uri", "raw_sha256", F.col("id").alias("message_id"), F.lit("integrity_conflict").alias("kind"), F.lit("same id, other content").alias("error_text"))
    write_quarantine(invalid.unionByName(clash).withColumn("occurred_at", F.current_timestamp()), quarantine, batch)
    bad = rows.filter("json IS NULL OR size(codes) > 0").agg(F.count("*").alias("messages")).select(F.lit("invalid").alias("outcome"), "messages")
    return ingest_outcomes(classified).unionByName(bad.filter("messages > 0"))


def find_message(spark: SparkSession, messages: str, id: str) -> DataFrame:
    """The stored message of an id, or no row. The id reaches the scan as a pushed filter."""
    return spark.read.schema(MESSAGES).parquet(messages).filter(F.col("id") == id.lower()).select("id", "canonical_hash", "json", "source_uri")


def ingest_envelopes(spark: SparkSession, inbox: str, messages: str, quarantine: str, work: str, roles: list[str], checkpoint: str, artifacts: str | None = None) -> StreamingQuery:
    """Ingest every landed file once, then stop. The stream numbers its batches, and numbers one that it
    has to repeat as before."""
    spark.createDataFrame([], MESSAGES).write.mode("append").parquet(messages)
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(inbox)

    def run(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, messages, quarantine, work, roles, f"stream-{number}", artifacts).collect()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
