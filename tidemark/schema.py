"""Schemas of inputs."""

from __future__ import annotations

from pyspark.sql import types as T

OHLCV = T.StructType(
    [T.StructField("date", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "buy_volume", "sell_volume", "volume")]
)
BAR_COLUMNS = ("open", "high", "low", "close", "buy_volume", "sell_volume", "volume")
MAPPING_COLUMNS = ("indicator_name", "signal_family", "natural_direction")
