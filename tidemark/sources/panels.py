"""OHLCV panels derived from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ohlcv import TIMEFRAMES


def event_panel(spark: SparkSession, sf_dir: str, timeframe: str = "4H") -> DataFrame:
    """Event types as assets, values as prices and volumes; vix is the bar's mean value plus 10."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    even = F.col("user_id") % 2 == 0
    out = e.groupBy(F.col("event_type").alias("asset"), F.window("ts", TIMEFRAMES[timeframe])["start"].alias("date")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.sum(F.when(even, F.col("value")).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(even, 0.0).otherwise(F.col("value"))).alias("sell_volume"), F.sum("value").alias("volume"),
        (F.avg("value") + 10).alias("vix"),
    )
    return out


def order_panel(spark: SparkSession, sf_dir: str, assets: int = 10) -> DataFrame:
    """Daily bars of unit prices; suppliers, modulo a number, are the assets.

    The first and the last line of a bar have its least and greatest order; those orders come from an aggregate that hashes, so
    that only their few lines are sorted (a least struct over all lines would sort them all).
    """
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, order = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)), F.col("l_orderkey")
    at = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    bought = F.col("l_linestatus") == "O"
    x = x.withColumns({"asset": (F.col("l_suppkey") % assets).cast("string"), "date": F.window("l_shipdate", "1 day")["start"]})
    whole = x.groupBy("asset", "date").agg(
        F.max(price).alias("high"), F.min(price).alias("low"),
        F.sum(F.when(bought, F.col("l_quantity")).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(bought, 0.0).otherwise(F.col("l_quantity"))).alias("sell_volume"), F.sum("l_quantity").alias("volume"),
        F.when(F.count_if(order.isNull()) == 0, F.min(order)).alias("__least"), F.max(order).alias("__most"),
    )
    same = lambda a, d: F.col("asset").eqNullSafe(F.col(a)) & F.col("date").eqNullSafe(F.col(d))
    bounds = whole.select(F.col("asset").alias("__a"), F.col("date").alias("__d"), "__least", "__most")  # a row a bar
    outer = x.join(F.broadcast(bounds), same("__a", "__d") & (order.eqNullSafe(F.col("__least")) | order.eqNullSafe(F.col("__most"))))
    ends = outer.groupBy(F.col("asset").alias("__e"), F.col("date").alias("__f")).agg(F.min_by(price, at).alias("open"), F.max_by(price, at).alias("close"))
    return whole.join(F.broadcast(ends), same("__e", "__f")).select("asset", "date", "open", "high", "low", "close", "buy_volume", "sell_volume", "volume")
