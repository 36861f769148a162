"""The regression dataset kept in a folder and brought up to date when bars arrive, without working on older months again.

A folder holds the bars by month and the dataset by horizon and month. New bars change rows of three kinds: their own
dates', earlier ones whose targets look ahead into them (the last rows of their series, as many as the longest horizon
has steps), and all rows of those dates, since signals and scalings compare assets of a date. append() finds the first
such date and makes the dataset again from its month on; months before are not written.

Features with a bounded memory are computed from the rows since then and as many earlier ones as the deepest of them
reads: a level of the catalogue reads one window at most, so levels times the longest window bound it. The others
(decaying means, running sums, fits by row number) run over the bars of whole series, which are few beside the dataset's
rows. Either way values equal those of a dataset made at once.

Months are replaced by dynamic partition overwrite, those left without rows are deleted, and the bars are added last, so
an append that was stopped can be repeated. Appends to one folder go one at a time.

Edge cases: bars without asset, date or context are left out; no new bars change nothing; repeated keys, and bars no
later than the last one of their series, are errors (such a history is made again with create()); extra columns are
ignored, missing ones are errors; series may begin or end at any date.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import INDICATOR_DEFAULTS, merged
from ..functions.windows import Panel
from ..sources.stored import drop, store
from .dataset import duplicate_keys, regression_dataset
from .indicators import catalogue, compute_indicators
from .signals import SIGNAL_DEFAULTS
from .targets import HORIZONS, normalize_horizons

#: Columns of the catalogue that sum, or number, all rows of a series.
RUNNING = ("_position", "_ad", "ad_line", "obv", "pvt", "nvi", "pvi")
MONTH = "month"


@dataclass(frozen=True)
class Recipe:
    """What a folder's dataset is made by; create() and append() of one folder take the same.

    keys: indicators (all, if None). columns: which of their columns to keep (all, if None). options go to regression_dataset.
    """

    panel: Panel = Panel()
    keys: tuple[str, ...] | None = None
    columns: tuple[str, ...] | None = None
    horizons: dict = field(default_factory=lambda: dict(HORIZONS))
    config: dict | None = None
    options: dict = field(default_factory=dict)

    @property
    def steps(self) -> int:
        return max(normalize_horizons(self.horizons).values())

    @property
    def lag(self) -> int:
        return merged(SIGNAL_DEFAULTS, self.options.get("signal_config"))["lag"]


def longest_window(config: dict | None) -> int:
    """The largest whole number of the parameters, and one more for a difference."""
    found = [v for group in merged(INDICATOR_DEFAULTS, config).values() for x in group.values() for v in (x if isinstance(x, list) else [x])]
    return 1 + max(v for v in found if isinstance(v, int) and not isinstance(v, bool))


def memories(recipe: Recipe, columns: list[str]) -> tuple[list[str], list[str], int]:
    """Indicators of unbounded memory, the others, and how many earlier rows a row of the latter depends on."""
    cat = catalogue(recipe.panel, recipe.config, "volume" in columns, "vix" in columns)
    known: dict[str, float] = {}

    def levels(name: str) -> float:
        if name not in known:
            if name in cat.kernels or name in RUNNING:
                known[name] = float("inf")
            else:
                made = cat.native.get(name) or cat.after.get(name)
                known[name] = 1 + max(map(levels, made[1]), default=0) if made else 0
        return known[name]

    depth = {k: max(map(levels, cat.columns[k]), default=0) for k in recipe.keys or cat.columns}
    bounded = [k for k, d in depth.items() if d < float("inf")]
    return [k for k in depth if k not in bounded], bounded, int(max((depth[k] for k in bounded), default=0)) * longest_window(recipe.config)


def features_since(bars: DataFrame, recipe: Recipe, start=None) -> DataFrame:
    """Features of the rows from a date on, and of so many before it in each series as differences of signals read; all rows without a date."""
    panel = recipe.panel
    endless, bounded, reach = memories(recipe, bars.columns)
    date, tail = F.col(panel.date), bars

    def wanted(df: DataFrame) -> DataFrame:
        if start is None:
            return df
        ahead = F.lead(panel.date, recipe.lag).over(panel.ordered())
        return df.withColumn("__ahead", ahead).where((date >= F.lit(start)) | F.col("__ahead").isNull() | (F.col("__ahead") >= F.lit(start))).drop("__ahead")

    if start is not None:
        back = Window.partitionBy(*panel.series).orderBy(date.desc())
        before = bars.where(date < F.lit(start)).withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= reach + recipe.lag).drop("__back")
        tail = before.unionByName(bars.where(date >= F.lit(start)))
    out = wanted(compute_indicators(tail, bounded, panel, recipe.config, base=False))
    if endless:
        more = wanted(compute_indicators(bars, endless, panel, recipe.config, base=False))
        out = out.join(more.select(*panel.keys, *[c for c in more.columns if c not in out.columns]), panel.keys, "left")
    if recipe.columns is not None:
        out = out.select(*panel.keys, "close", *[c for c in recipe.columns if c in out.columns])
    return out


def rows_since(bars: DataFrame, recipe: Recipe, start=None) -> DataFrame:
    """The dataset's rows from a date on, with their month."""
    out = regression_dataset(features_since(bars, recipe, start), recipe.panel, recipe.horizons, check=False, **recipe.options)
    out = out if start is None else out.where(F.col(recipe.panel.date) >= F.lit(start))
    return with_month(out, recipe.panel)


def with_month(df: DataFrame, panel: Panel) -> DataFrame:
    return df.withColumn(MONTH, F.year(panel.date) * 100 + F.month(panel.date))


def whole_keys(bars: DataFrame, panel: Panel) -> DataFrame:
    out = bars.dropna(subset=panel.keys)
    if not duplicate_keys(out, panel.keys).isEmpty():
        raise ValueError("repeated keys")
    return out


def _write(df: DataFrame, path: str, by: list[str], mode: str) -> None:
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema_{name}").schema).parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The dataset of a folder, in the order of columns of regression_dataset."""
    return _read(spark, path, "dataset").select(*[c for c in spark.read.parquet(f"{path}/schema_dataset").columns if c != MONTH])


def create(bars: DataFrame, path: str, recipe: Recipe = Recipe()) -> None:
    """A new folder with the dataset of all bars; an existing one is an error."""
    held = store(whole_keys(bars, recipe.panel), "bars")
    rows = rows_since(held, recipe)
    dated = with_month(held, recipe.panel)
    for name, df in (("dataset", rows), ("bars", dated)):
        df.limit(0).write.parquet(f"{path}/schema_{name}")
    _write(rows, f"{path}/dataset", ["horizon", MONTH], "errorifexists")
    _write(dated, f"{path}/bars", [MONTH], "errorifexists")
    drop(held)


def first_change(old: DataFrame, fresh: DataFrame, recipe: Recipe):
    """The first day of the month from which on rows change; one row comes to the driver."""
    panel = recipe.panel
    back = Window.partitionBy(*panel.series).orderBy(F.col(panel.date).desc())
    touched = old.select(*panel.keys).join(fresh.select(*panel.series).distinct(), panel.series, "left_semi")
    last = touched.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= recipe.steps).drop("__back")
    first = last.unionByName(fresh.select(*panel.keys)).agg(F.min(panel.date).alias("at"))
    return first.select(F.date_trunc("month", "at").cast(old.schema[panel.date].dataType).alias("at"), (F.year("at") * 100 + F.month("at")).alias(MONTH)).first()


def append(bars: DataFrame, path: str, recipe: Recipe = Recipe()) -> int | None:
    """Bring a folder up to date with bars that are later than all of their series; the first month written, as 202401, or None."""
    spark, panel = bars.sparkSession, recipe.panel
    old = _read(spark, path, "bars").drop(MONTH)
    fresh = store(whole_keys(bars.select(*old.columns), panel), "fresh-bars")
    try:
        if fresh.isEmpty():
            return None
        last = old.groupBy(*panel.series).agg(F.max(panel.date).alias("__last"))
        if not fresh.join(last, panel.series).where(F.col(panel.date) <= F.col("__last")).isEmpty():
            raise ValueError("bars that are no later than the last one of their series")
        start, month = first_change(old, fresh, recipe)
        rows = store(rows_since(old.unionByName(fresh), recipe, start), "fresh-rows")
        _write(rows, f"{path}/dataset", ["horizon", MONTH], "overwrite")
        made = rows.select("horizon", MONTH).distinct()
        stale = _read(spark, path, "dataset").where(F.col(MONTH) >= month).select("horizon", MONTH).distinct().exceptAll(made).collect()  # folders
        for horizon, old_month in stale:
            _delete(spark, f"{path}/dataset/horizon={horizon}/{MONTH}={old_month}")
        _write(with_month(fresh, panel), f"{path}/bars", [MONTH], "append")
        drop(rows)
        return month
    finally:
        drop(fresh)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
