"""Time splits: calendars, purged blocks, fixed, expanding and rolling folds. Steps count dates of the calendar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import unknown_horizons
from .targets import HORIZONS, normalize_horizons

# fixed values: half-year validation blocks of the expanding scheme, and the fixed split
EXPANDING = (("2022-12-31", "2023-01-01", "2023-06-30"), ("2023-06-30", "2023-07-01", "2023-12-31"), ("2023-12-31", "2024-01-01", "2024-06-30"), ("2024-06-30", "2024-07-01", "2024-12-31"))
FIXED = {"train": ("2019-01-01", "2023-12-31"), "val": ("2024-01-01", "2024-12-31"), "test": ("2025-01-01", "2025-12-31")}


def steps_of(horizons=HORIZONS, column: str = "horizon") -> Column:
    """The rows that a horizon label spans; null if unknown."""
    pairs = [x for k, v in normalize_horizons(horizons).items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.col(column)]


def calendar(df: DataFrame, date: str = "date", dates: DataFrame | None = None) -> DataFrame:
    """Distinct dates with positions from 0. Dates are few: one row each goes through one window.

    With dates, a calendar from elsewhere (its column is called like this one's), a position is that of its last date not
    after the row's; dates before its first have none and are left out.
    """
    own = df.select(date).where(F.col(date).isNotNull()).distinct()
    if dates is None:
        return own.withColumn("pos", F.row_number().over(Window.orderBy(date)) - 1)
    known = dates.select(F.col(date).cast(own.schema[date].dataType).alias(date)).where(F.col(date).isNotNull()).distinct()
    both = own.select(date, F.lit(0).alias("__known")).unionByName(known.select(date, F.lit(1).alias("__known"))).groupBy(date).agg(F.max("__known").alias("__known"), F.min("__known").alias("__only"))
    placed = both.withColumn("pos", (F.sum("__known").over(Window.orderBy(date)) - 1).cast("int"))
    return placed.where((F.col("__only") == 0) & (F.col("pos") >= 0)).select(date, "pos")


def last_position(known: DataFrame, dates: DataFrame | None, date: str) -> DataFrame:
    """One row: __last, the last position of a calendar."""
    if dates is None:
        return known.agg(F.max("pos").alias("__last"))
    return dates.select(date).where(F.col(date).isNotNull()).distinct().agg((F.count(F.lit(1)) - 1).alias("__last"))


def block(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    """Rows from start to end; the end is a moment, so bars later on its day are out."""
    return df.where(F.col(date).between(F.lit(str(start)).cast("timestamp_ntz"), F.lit(str(end)).cast("timestamp_ntz")))


def purge(df: DataFrame, horizons=HORIZONS, date: str = "date", dates: DataFrame | None = None) -> DataFrame:
    """Rows whose target is known inside the block: position plus steps is still a date of its calendar, the rows' own or dates (a table with that column)."""
    known = calendar(df, date, dates)
    last = last_position(known, dates, date)
    out = df.withColumn("__steps", steps_of(horizons)).join(known, date).join(F.broadcast(last))
    return out.where(F.col("__steps").isNotNull() & (F.col("pos") + F.col("__steps") <= F.col("__last"))).drop("__steps", "pos", "__last")


def prepared(df: DataFrame, date: str = "date", order: tuple[str, ...] = ("asset", "indicator_name", "horizon")) -> DataFrame:
    """df with date as a moment without time zone, sorted by date and the other keys that are there; a date that is missing or can't be read is an error when rows are read."""
    day = F.col(date).try_cast("timestamp_ntz")
    df = df.withColumn(date, F.coalesce(day, F.raise_error(F.lit(f"{date} is missing or no date")).cast("timestamp_ntz")))
    return df.orderBy(date, *[c for c in order if c in df.columns])


def purged_blocks(df: DataFrame, blocks: list[tuple], horizons, date: str) -> DataFrame:
    """df, once for each block (start, end, purged or not, literal columns) that a row is in; purged ones without rows whose target ends later.

    One scan: rows are exploded into their blocks, and each block's calendar is numbered in a window of its own.
    """
    names = list(blocks[0][3])
    kind = "timestamp_ntz"
    each = [F.when(F.col(date).between(F.lit(str(a)).cast(kind), F.lit(str(b)).cast(kind)), F.struct(F.lit(i).alias("__block"), F.lit(p).alias("__purge"), *[F.lit(v).alias(k) for k, v in own.items()])) for i, (a, b, p, own) in enumerate(blocks)]
    rows = df.select("*", steps_of(horizons).alias("__steps"), F.explode(F.array_compact(F.array(*each))).alias("__in")).select(*df.columns, "__steps", "__in.*")
    days = rows.where("__purge").select("__block", F.col(date).alias("__day")).distinct()
    days = days.withColumn("__pos", F.row_number().over(Window.partitionBy("__block").orderBy("__day")) - 1)
    days = days.withColumn("__last", F.max("__pos").over(Window.partitionBy("__block"))).withColumnRenamed("__block", "__own")
    met = rows.join(days, (F.col("__block") == F.col("__own")) & (F.col(date) == F.col("__day")), "left")
    return met.where(~F.col("__purge") | (F.col("__pos") + F.col("__steps") <= F.col("__last"))).select(*df.columns, *names)


def fixed_split(df: DataFrame, bounds: dict = FIXED, horizons=HORIZONS, date: str = "date") -> DataFrame:
    """df with the column split: train and val purged, test whole."""
    (a, b), (c, d), (e, f) = (bounds[k] for k in ("train", "val", "test"))
    if not str(a) <= str(b) < str(c) <= str(d) < str(e) <= str(f):
        raise ValueError("the blocks must follow one another")
    unknown_horizons([r[0] for r in df.select("horizon").distinct().collect()], normalize_horizons(horizons), strict=True)  # labels are few
    return purged_blocks(df, [(a, b, True, {"split": "train"}), (c, d, True, {"split": "val"}), (e, f, False, {"split": "test"})], horizons, date)


def expanding_folds(df: DataFrame, folds=EXPANDING, start: str = "2019-01-01", horizons=HORIZONS, date: str = "date") -> DataFrame:
    """df with fold_id and block (train or val); training always begins at start and ends before the validation block. Both are purged."""
    blocks = [(a, b, True, {"fold_id": i, "block": name}) for i, (train_end, val_start, val_end) in enumerate(folds) for name, a, b in (("train", start, train_end), ("val", val_start, val_end))]
    return purged_blocks(df, blocks, horizons, date)


@dataclass(frozen=True)
class Rolling:
    """Windows of dates: training, embargo, test, moved on by the test's length."""

    train: int = 365
    test: int = 30
    embargo: int = 5

    def n_splits(self, n_dates: int) -> int:
        if n_dates < self.train:
            raise ValueError("fewer dates than a training window")
        return (n_dates - 1 - self.train - self.embargo) // self.test + 1 if n_dates > self.train + self.embargo else 0

    def folds(self, n_dates: int) -> list[tuple[int, int, int, int, int]]:
        """(fold, first and end position of training, of test); the last test may be short."""
        ends = [self.train + k * self.test for k in range(self.n_splits(n_dates))]
        return [(k, e - self.train, e, e + self.embargo, min(e + self.embargo + self.test, n_dates)) for k, e in enumerate(ends)]

    def placed(self, df: DataFrame, horizons, date: str, dates: DataFrame | None) -> DataFrame:
        """df with __steps, pos and __n, the number of dates of the calendar: days of the rows whose horizon is known, or of dates."""
        day = lambda c: F.date_trunc("day", F.col(c)).cast("timestamp_ntz")
        known = df.withColumns({"__day": day(date), "__steps": steps_of(horizons)}).where(F.col("__steps").isNotNull())
        given = None if dates is None else dates.select(day(date).alias("__day")).distinct()
        days = calendar(known.select(F.col("__day")), "__day", given)
        total = last_position(days, given, "__day").select((F.col("__last") + 1).alias("__n"))
        return known.join(days, "__day").join(F.broadcast(total)).drop("__day")

    def assign(self, df: DataFrame, horizons=HORIZONS, date: str = "date", dates: DataFrame | None = None) -> DataFrame:
        """df with fold_id and block; rows whose horizon is unknown are left out, training rows whose target ends after training too.

        A row is in few folds, so those are computed from its position and exploded: no join of rows with folds.
        """
        p, n, e = F.col("pos"), F.col("__n"), F.col("__end")
        last = F.floor((n - 1 - self.train - self.embargo) / F.lit(self.test)).cast("int")
        # the folds whose training or test may hold the position
        low = F.greatest(F.lit(0), F.floor((p - self.train - self.embargo - self.test) / F.lit(self.test)).cast("int"))
        high = F.least(last, F.ceil((p + 1) / F.lit(self.test)).cast("int"))
        rows = self.placed(df, horizons, date, dates).where((n > self.train + self.embargo) & (low <= high))
        rows = rows.withColumn("fold_id", F.explode(F.sequence(low, high))).withColumn("__end", self.train + F.col("fold_id") * self.test)
        in_train = (p >= e - self.train) & (p < e)
        in_test = (p >= e + self.embargo) & (p < F.least(e + self.embargo + self.test, n))
        placed = rows.withColumn("block", F.when(in_train, F.when(p + F.col("__steps") < e, "train").otherwise("purged")).when(in_test, "test"))
        return placed.where(F.col("block").isNotNull()).drop("__steps", "__n", "__end", "pos")

    def train_spans(self, df: DataFrame, horizons=HORIZONS, date: str = "date", dates: DataFrame | None = None) -> DataFrame:
        """df with __lo and __hi, the first and last fold that a row trains (none: __lo is the greater): what assign() tells by rows, as an interval."""
        p, n = F.col("pos"), F.col("__n")
        last = F.floor((n - 1 - self.train - self.embargo) / F.lit(self.test))
        met = self.placed(df, horizons, date, dates)
        low = F.greatest(F.lit(0), F.floor((p + F.col("__steps") - self.train) / F.lit(self.test)) + 1)
        high = F.when(n > self.train + self.embargo, F.least(last, F.floor(p / F.lit(self.test)))).otherwise(-1)
        return met.withColumns({"__lo": low.cast("int"), "__hi": high.cast("int")}).drop("__steps", "__n", "pos")

    def summary(self, assigned: DataFrame, date: str = "date") -> DataFrame:
        """One row a fold: first and last dates and rows of its blocks."""
        of = lambda b: F.col("block") == b
        trained = of("train") | of("purged")
        return assigned.groupBy("fold_id").agg(
            F.min(F.when(trained, F.col(date))).alias("train_start"), F.max(F.when(trained, F.col(date))).alias("train_end"), F.min(F.when(of("test"), F.col(date))).alias("test_start"), F.max(F.when(of("test"), F.col(date))).alias("test_end"),
            F.count_if(trained).alias("n_train_rows_raw"), F.count_if(of("train")).alias("n_train_rows_after_purge"), F.count_if(of("purged")).alias("n_train_rows_purged"), F.count_if(of("test")).alias("n_test_rows"),
        )


def split_summary(df: DataFrame, by: str = "split", date: str = "date") -> DataFrame:
    """Rows, dates, distinct keys, rows of each horizon and rates of each part; positive is a target over 0."""
    each = df.groupBy(by, "horizon").agg(F.count(F.lit(1)).alias("n")).where("horizon IS NOT NULL").groupBy(F.col(by).alias("__by")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", "n")))).alias("horizon_counts"))
    whole = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(date).alias("n_dates"), F.countDistinct("asset").alias("n_assets"), F.countDistinct("indicator_name").alias("n_indicators"),
        F.avg("target").alias("target_rate"), F.avg((F.col("target") > 0).cast("double")).alias("positive_rate"),
    )
    return whole.join(each, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
