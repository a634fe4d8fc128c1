"""Insert-only merge of bars with conflict detection. Only `merge` may add bars to a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import same_values, values_of
from ..schemas import PROVENANCE, ROW_KEY, VALUES


class ConflictError(ValueError):
    """Incoming bars contradict stored ones; nothing was merged."""


@dataclass
class MergeResult:
    inserted: DataFrame
    conflicts: DataFrame


def _tagged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each incoming key: its least and greatest market values, the row of least provenance, and the
    stored values. Both sides are shuffled once, by the row key."""
    rest = [c for c in incoming.columns if c not in ROW_KEY]
    first = dict.fromkeys([c for c in (*PROVENANCE, *rest) if c in rest])
    given = incoming.groupBy(*ROW_KEY).agg(F.min(values_of()).alias("lo"), F.max(values_of()).alias("hi"), F.min(F.struct(*first)).alias("x"))
    return given.join(existing.select(*ROW_KEY, values_of().alias("stored")), ROW_KEY, "left")


def contradictions(incoming: DataFrame) -> DataFrame:
    """Keys that a batch itself gives with different market values."""
    return incoming.groupBy(*ROW_KEY).agg(F.min(values_of()).alias("lo"), F.max(values_of()).alias("hi")).filter("NOT lo <=> hi").select(*ROW_KEY)


def _conflicts(tagged: DataFrame) -> DataFrame:
    differs = "NOT lo <=> hi OR (stored IS NOT NULL AND NOT (stored <=> lo))"
    return tagged.filter(differs).select(*ROW_KEY).distinct()


def find_conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Keys with any different market value on both sides, or in the incoming rows themselves
    (provenance is not compared)."""
    return _conflicts(_tagged(existing, incoming))


def merge(existing: DataFrame, incoming: DataFrame) -> MergeResult:
    """Rows to append, one per key (of equal ones that of least provenance), and keys that conflict.
    Stored rows keep their provenance; replays and repeated rows add nothing."""
    tagged = _tagged(existing, incoming)
    once = tagged.filter("stored IS NULL").select(*[F.col(c) if c in ROW_KEY else F.col("x")[c].alias(c) for c in incoming.columns])
    return MergeResult(once, _conflicts(tagged))


def insert_only_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The merged table; raises ConflictError before anything is built if a key conflicts."""
    result = merge(existing, incoming)
    bad = result.conflicts.limit(1).collect()
    if bad:
        raise ConflictError(f"conflicting bar: {bad[0].asDict()}")
    return existing.unionByName(result.inserted)


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every key of either side with 'equal', 'different', 'left_only' or 'right_only'."""
    a, b = left.select(*ROW_KEY, *VALUES).alias("a"), right.select(*ROW_KEY, *VALUES).alias("b")
    both = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ROW_KEY], "full_outer")
    status = F.when(F.col("b.open_time").isNull(), "left_only").when(F.col("a.open_time").isNull(), "right_only").when(same_values("a", "b"), "equal").otherwise("different")
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ROW_KEY], status.alias("status"))


def cell_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (key, column) for every differing cell; a row missing on a side is 'missing_left' or
    'missing_right', a key that a side holds more than once 'repeated_left' or 'repeated_right'.
    Rows are compared by hash first, cells only where the hashes differ. Repeats are counted on the
    partitioning that the join needs, so each side is shuffled once."""
    columns = [c for c in [*VALUES, *PROVENANCE, "schema_version"] if c in left.columns and c in right.columns]
    copies = F.count("*").over(Window.partitionBy(*ROW_KEY))
    a, b = (df.select(*ROW_KEY, *columns, F.xxhash64(*columns).alias("h"), copies.alias("copies")).alias(n) for df, n in ((left, "a"), (right, "b")))
    both = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ROW_KEY], "full_outer").filter("NOT a.h <=> b.h OR a.copies > 1 OR b.copies > 1")
    cells = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in columns]))
    found = F.when(F.col("a.open_time").isNull(), F.array(F.lit("missing_left"))).when(F.col("b.open_time").isNull(), F.array(F.lit("missing_right"))).otherwise(cells)
    repeated = F.array_compact(F.array(*[F.when(F.col(f"{n}.copies") > 1, F.lit(f"repeated_{side}")) for n, side in (("a", "left"), ("b", "right"))]))
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ROW_KEY], F.explode(F.concat(found, repeated)).alias("column")).distinct()


def symmetric_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with `side`."""
    one = left.exceptAll(right).withColumn("side", F.lit("left"))
    return one.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
