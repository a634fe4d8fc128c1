"""Complete bars from a stream of finer bars."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.intervals import SECONDS, close_time, duration
from ..schemas import CANDLE_COLUMNS, ROW_KEY, VOLUMES


def resample_stream(stream: DataFrame, base: str, target: str, late: str = "7 days") -> DataFrame:
    """Bars of `target`, each emitted once the watermark has passed it, if all its children came.

    Children may be up to `late` behind; repeats of a child within that time are dropped, and
    buckets that stay incomplete give nothing.
    """
    slots = stream.filter((F.col("interval") == base) & (F.unix_micros("open_time") % (SECONDS[base] * 1_000_000) == 0))
    once = slots.withWatermark("open_time", late).dropDuplicatesWithinWatermark(ROW_KEY)
    grouped = once.groupBy("venue", "market_type", "symbol", F.window("open_time", duration(target)).alias("w")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        *[F.sum(v).cast("decimal(38,18)").alias(v) for v in VOLUMES], F.sum("trade_count").alias("trade_count"), F.count("*").alias("n"),
    )
    whole = grouped.filter(F.col("n") == SECONDS[target] // SECONDS[base])
    out = whole.withColumns({"interval": F.lit(target), "open_time": F.col("w.start"), "close_time": close_time(F.col("w.start"), SECONDS[target]), "source": F.lit("aggregate"), "source_file": F.lit(f"canonical:{base}")})
    return out.select(*CANDLE_COLUMNS)


#: What is kept of a bucket: children so far, which of them (a bit each), and their bar, exact decimals as text.
_STATE = "n int, seen binary, open_at long, open string, high string, low string, close_at long, close string, volumes array<string>, trades long"
_EMITTED = "venue string, market_type string, symbol string, start long, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), " + ", ".join(f"{v} decimal(38,18)" for v in VOLUMES) + ", trade_count long"


class _Bucket(StatefulProcessor):
    """One (key, bucket): emits at its last child, and forgets itself when the watermark passes its end."""

    def __init__(self, children: int, step: int):
        self.children, self.step = children, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bar", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = int(key[3])
        if self.state.exists():
            n, seen, *bar = self.state.get()
            seen = bytearray(seen)
        else:
            n, seen, bar = 0, bytearray(self.children // 8 + 1), None
            self.handle.registerTimer((start + self.children * self.step) // 1000)
        with decimal.localcontext(prec=60):
            for frame in rows:
                for r in frame.itertuples(index=False):
                    slot = (int(r.at) - start) // self.step
                    if seen[slot >> 3] >> (slot & 7) & 1:
                        continue
                    seen[slot >> 3] |= 1 << (slot & 7)
                    n += 1
                    bar = _with_child(bar, r)
        if n == self.children:
            _, first, high, low, _, close, volumes, trades = bar
            yield pd.DataFrame([(*key, *(decimal.Decimal(x) for x in (first, high, low, close, *volumes)), trades)], columns=[x.split()[0] for x in _EMITTED.split(", ")])
            n += 1  # emitted: only `seen` still counts
        self.state.update((n, bytes(seen), *bar))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _with_child(bar, r):
    """The bar of a bucket with one more child, whatever order children come in."""
    at, volumes = int(r.at), [getattr(r, v) for v in VOLUMES]
    if bar is None:
        return at, str(r.open), str(r.high), str(r.low), at, str(r.close), [str(v) for v in volumes], int(r.trade_count)
    open_at, first, high, low, close_at, close, sums, trades = bar
    if at < open_at:
        open_at, first = at, str(r.open)
    if at > close_at:
        close_at, close = at, str(r.close)
    high, low = max(decimal.Decimal(high), r.high), min(decimal.Decimal(low), r.low)
    return open_at, first, str(high), str(low), close_at, close, [str(decimal.Decimal(a) + b) for a, b in zip(sums, volumes)], trades + int(r.trade_count)


def resample_early(stream: DataFrame, base: str, target: str, late: str = "7 days") -> DataFrame:
    """Bars of `target` as in `resample_stream`, each emitted in the batch that brings its last child
    instead of when the watermark has passed.

    State is kept for (key, bucket), one partial bar and a bit for each child, until the watermark
    passes the bucket's end; repeats of a child are dropped, incomplete buckets give nothing. The
    session's state store must be RocksDB's (`STATE_STORE`).
    """
    size, step = SECONDS[target] * 1_000_000, SECONDS[base] * 1_000_000
    at = F.unix_micros("open_time")
    slots = stream.filter((F.col("interval") == base) & (at % step == 0)).withWatermark("open_time", late)
    rows = slots.select("venue", "market_type", "symbol", (at - F.pmod(at, F.lit(size))).alias("start"), at.alias("at"), "open", "high", "low", "close", *VOLUMES, "trade_count", "open_time")
    grouped = rows.groupBy("venue", "market_type", "symbol", "start")
    bars = grouped.transformWithStateInPandas(_Bucket(size // step, step), _EMITTED, "Append", "EventTime")
    start = F.timestamp_micros("start")
    out = bars.withColumns({"interval": F.lit(target), "open_time": start, "close_time": close_time(start, SECONDS[target]), "source": F.lit("aggregate"), "source_file": F.lit(f"canonical:{base}")})
    return out.select(*CANDLE_COLUMNS)


#: Setting and value that `resample_early` needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
