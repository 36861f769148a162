"""OHLCV sources: CSV files of assets, bars of any timeframe, the indicator mapping, null reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import Panel
from ..schema import BAR_COLUMNS, MAPPING_COLUMNS, OHLCV

#: Bars whose length divides a day, so that epoch and midnight give the same bins.
TIMEFRAMES = {"1H": "1 hour", "4H": "4 hours", "1D": "1 day"}


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the last by order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def scan_ohlcv(spark: SparkSession, path: str, pattern: str = "*_*_*.csv", empty_ok: bool = True) -> DataFrame:
    """asset, date, OHLCV of every file of a folder; the asset is the second part of the file's name.

    Rows whose date can't be read are dropped; of a repeated date the last row of the file stays.
    """
    try:
        raw = spark.read.schema(OHLCV).option("header", True).option("pathGlobFilter", pattern).option("enforceSchema", False).csv(path)
    except Exception as e:
        if empty_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "asset string, date timestamp_ntz, " + ", ".join(f"{c} double" for c in BAR_COLUMNS))
        raise
    parts = F.split(F.col("_metadata.file_name"), "_")
    named = raw.select(
        F.when(F.size(parts) >= 3, parts[1]).otherwise(F.raise_error(F.concat(F.lit("no asset in file name "), F.col("_metadata.file_name")))).alias("asset"),
        F.expr("try_cast(date AS timestamp_ntz)").alias("date"),
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in BAR_COLUMNS],
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
    )
    return latest(named.where(F.col("date").isNotNull()), ["asset", "date"], ["__block", "__row"]).select("asset", "date", *BAR_COLUMNS)


def prepare(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Lower-case trimmed names, numeric prices (NaN is null), rows with a date, the last of a repeated key."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    out = df.toDF(*names)
    missing = {"open", "high", "low", "close"} - set(names)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    numbers = [c for c in (*BAR_COLUMNS, "vix") if c in names]
    as_double = lambda c: F.expr(f"nanvl(try_cast(`{c}` AS double), cast(NULL AS double))")
    out = out.withColumns({c: as_double(c) for c in numbers}).withColumn("__row", F.monotonically_increasing_id()).where(F.col(panel.date).isNotNull())
    return latest(out, panel.keys, ["__row"]).drop("__row")


def bars(ticks: DataFrame, timeframe: str, panel: Panel = Panel()) -> DataFrame:
    """Bars from finer ones: first open, highest high, lowest low, last close, summed volumes (0 where all are null).

    Bins are closed on the left and named after their start; a bin without any price is left out.
    """
    start = F.window(panel.date, TIMEFRAMES.get(timeframe, timeframe))["start"]
    date = F.col(panel.date)
    volumes = [c for c in ("buy_volume", "sell_volume", "volume") if c in ticks.columns]
    out = ticks.groupBy(*panel.series, start.alias("__start")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), date)).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), date)).alias("close"),
        *[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in volumes],
    )
    priced = F.coalesce("open", "high", "low", "close").isNotNull()
    return out.where(priced).withColumnRenamed("__start", panel.date).select(*panel.series, panel.date, "open", "high", "low", "close", *volumes)


def panel_of(ticks: DataFrame, timeframes=("1H", "4H", "1D"), panel: Panel = Panel()) -> DataFrame:
    """Bars of several timeframes in one table with a column timeframe."""
    return reduce(DataFrame.unionByName, [bars(ticks, t, panel).withColumn("timeframe", F.lit(t)) for t in timeframes])


def load(spark: SparkSession, path: str, timeframes=("1H", "4H", "1D")) -> DataFrame:
    return panel_of(scan_ohlcv(spark, path), timeframes)


def union_of(frames: dict, name: str = "timeframe") -> DataFrame:
    """A mapping of tables (or of mappings of tables) as one table; keys become columns, outermost first named."""
    out = []
    for key, value in frames.items():
        df = union_of(value, "asset") if isinstance(value, dict) else value
        out.append(df.withColumn(name, F.lit(key)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def scan_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Indicator metadata (semicolons); rows without a name are dropped, of a repeated name the last stays."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    missing = set(MAPPING_COLUMNS) - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = raw.select(*MAPPING_COLUMNS).where(F.col("indicator_name").isNotNull()).withColumn("__row", F.monotonically_increasing_id())
    return latest(rows, ["indicator_name"], ["__row"]).drop("__row")


def null_counts(df: DataFrame, by: str = "asset") -> DataFrame:
    """Nulls of each other column, by asset."""
    return df.groupBy(by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns if c != by])
