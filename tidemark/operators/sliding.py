"""Order statistics over the last n rows of long series: places of extremes, percent rank, mean absolute deviation, entropy of bins.

A window expression hands each row an array of its window; here a series is cut into blocks of rows, a block takes the
n - 1 rows before it along, and a task works out all windows of a block at once, as views of one array. A series of any
length spreads over tasks, none holds more than a block and its lead-in, and the price of a longer window is that of
reading memory.

Blocks need row numbers: rows are numbered inside slices of time, and slices begin where the ones before end (one row a
slice meets in that sum). Values are those of functions.windows: null unless the window holds n values, NaN counts as null.

Edge cases: null dates sort first; rows of one date have no defined order; n of 1 is allowed; empty tables give empty
results; columns of the input stay as they are, whatever their types.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import Panel
from .scan import SLICE, slice_seconds, sliced

#: Values that a step of a task holds as views at a time.
STEP = 1 << 20


def first_high(v: np.ndarray) -> np.ndarray:
    return v.argmax(axis=1).astype(float)


def first_low(v: np.ndarray) -> np.ndarray:
    return v.argmin(axis=1).astype(float)


def percent_rank(v: np.ndarray) -> np.ndarray:
    return (v <= v[:, -1:]).sum(axis=1) / v.shape[1]


def mean_deviation(v: np.ndarray) -> np.ndarray:
    return np.abs(v - v.mean(axis=1, keepdims=True)).sum(axis=1) / v.shape[1]


def bin_entropy(v: np.ndarray, bins: int) -> np.ndarray:
    low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
    flat = np.where(low == high, 0.5, 0.0)
    low, high = low - flat, high + flat
    place = np.minimum(np.floor((v - low) / (high - low) * bins), bins - 1)
    out = np.zeros(len(v))
    for b in range(bins):
        share = (place == b).sum(axis=1) / v.shape[1]
        out -= share * np.log(np.where(share > 0, share, 1.0))
    return out / math.log(max(bins, 2))


#: What a window (a row of a matrix, oldest value first) gives; "entropy" takes the number of bins besides.
KINDS = {"argmax": first_high, "argmin": first_low, "percent_rank": percent_rank, "mean_deviation": mean_deviation, "entropy": bin_entropy}


def over_windows(x: np.ndarray, n: int, value) -> np.ndarray:
    """value of each full window without NaN; NaN elsewhere."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    views = np.lib.stride_tricks.sliding_window_view(x, n)
    known = np.cumsum(np.concatenate([[0], ~np.isnan(x)]))
    whole = known[n:] - known[:-n] == n
    step = max(1, STEP // n)
    for at in range(0, len(views), step):
        some = np.flatnonzero(whole[at : at + step]) + at
        if len(some):
            out[some + n - 1] = value(views[some])
    return out


def numbered(df: DataFrame, panel: Panel, seconds: int | None = None) -> DataFrame:
    """df with __at: the number of a row in its series, from 0, without a window over whole series."""
    now = sliced(df, panel, seconds or slice_seconds(df, panel))
    now = now.withColumn(SLICE, F.coalesce(SLICE, F.lit(-(1 << 62))))
    part = [*panel.series, SLICE]
    before = Window.partitionBy(*panel.series).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = now.groupBy(*part).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    same = F.lit(True)
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(panel.date)) - 1
    return now.withColumn("__at", inside).join(starts, same).withColumn("__at", F.col("__at") + F.col("__from")).drop("__from", SLICE, *[f"__p{i}" for i in range(len(part))])


def add_sliding(df: DataFrame, wanted: dict[str, tuple], panel: Panel = Panel(), block_rows: int = 65_536, seconds: int | None = None) -> DataFrame:
    """df with columns name: (kind of KINDS, column, rows of the window[, bins]). block_rows bounds a task's rows, but for the lead-in; seconds is a slice's length."""
    if odd := {k for k, *_ in wanted.values()} - set(KINDS):
        raise ValueError(f"unknown kinds: {sorted(odd)}")
    lead = max((n for _, _, n, *_ in wanted.values()), default=1) - 1
    block, at = max(block_rows, lead, 1), F.col("__at")
    first = F.floor(at / block)
    # a row serves its own block, and the next one if it is in that one's lead-in
    homes = F.when(at % block >= block - lead, F.array(first, first + 1)).otherwise(F.array(first)) if lead else F.array(first)
    placed = numbered(df, panel, seconds).withColumn("__block", F.explode(homes))
    given = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in wanted]])

    def run(key, t):
        t = t.sort_by("__at")
        own = np.asarray(t["__at"]) // block == key[-1].as_py()
        numbers: dict[str, np.ndarray] = {}
        kept = t.filter(pa.array(own)).select(given)
        for name, (kind, column, n, *more) in wanted.items():
            if column not in numbers:
                numbers[column] = np.asarray(t[column].cast(pa.float64()).to_numpy(), dtype=float)
            found = over_windows(numbers[column], n, lambda v: KINDS[kind](v, *more))[own]  # noqa: B023
            kept = kept.append_column(name, pa.array(found, mask=np.isnan(found), type=pa.float64()))
        return kept

    return placed.groupBy(*panel.series, "__block").applyInArrow(run, schema)
