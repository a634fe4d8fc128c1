"""Every schema of the library, declared once; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

DECIMAL = T.DecimalType(38, 18)
SCHEMA_VERSION = "1"

KEY = ["venue", "market_type", "symbol", "interval"]
ROW_KEY = [*KEY, "open_time"]
PRICES = ["open", "high", "low", "close"]
VOLUMES = ["base_asset_volume", "quote_asset_volume", "taker_buy_base_volume", "taker_buy_quote_volume"]
#: Columns that make two bars of one key the same bar; provenance is not among them.
VALUES = [*PRICES, "base_asset_volume", "close_time", "quote_asset_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume"]
PROVENANCE = ["source", "source_file"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, False) for k, v in fields.items()])


_text, _time, _long = T.StringType(), T.TimestampType(), T.LongType()

CANDLE = _struct(
    venue=_text, market_type=_text, symbol=_text, interval=_text, open_time=_time, open=DECIMAL, high=DECIMAL, low=DECIMAL, close=DECIMAL, base_asset_volume=DECIMAL, close_time=_time,
    quote_asset_volume=DECIMAL, trade_count=_long, taker_buy_base_volume=DECIMAL, taker_buy_quote_volume=DECIMAL, source=_text, source_file=_text,
)
CANDLE_COLUMNS = CANDLE.names
STORED = T.StructType([T.StructField("schema_version", _text, False), *CANDLE.fields])

ARTIFACT = T.StructType([T.StructField(x, _text) for x in ("name", "uri", "url", "sha256", "kind")])
ROUTE = "domain string, cloud_conversation_key string, local_lane string"
