"""Event-time bars over a stream of ticks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, size: str = "1 hour", late: str = "1 day", asset: str = "asset", date: str = "date", price: str = "price", volume: str = "volume") -> DataFrame:
    """Open, high, low, close and volume of each asset and window; ticks later than the watermark are dropped."""
    return ticks.withWatermark(date, late).groupBy(asset, F.window(date, size)).agg(
        F.min_by(price, date).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, date).alias("close"), F.sum(volume).alias("volume")
    ).select(asset, F.col("window.start").alias(date), "open", "high", "low", "close", "volume")


def place_for(spark: SparkSession, name: str) -> str:
    """A folder for a stream's checkpoints and result, shared by driver and executors; in local mode a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run an aggregated stream over what there is; its table is written below path, batch after batch, and read from there."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{last}")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as a stream of ticks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return raw.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("date"), F.col("value").alias("price"), F.col("value").alias("volume"))
