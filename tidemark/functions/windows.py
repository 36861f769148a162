"""Window expressions of one series per group: every rolling one is null until its window holds n values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sdiv(a, b) -> Column:
    """Division whose zero denominators and non-finite results are null."""
    q = col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))
    return F.when(F.abs(q) < float("inf"), q)


def log_positive(x) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


#: Expressions that recur in a catalogue, by what they stand for; those of another gateway to Spark are dropped.
_KEPT: dict = {}


def kept(key: tuple, make):
    from pyspark import SparkContext

    if _KEPT.get("gateway") is not SparkContext._gateway:
        _KEPT.clear()
        _KEPT["gateway"] = SparkContext._gateway
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


@dataclass(frozen=True)
class Panel:
    """Names of a panel's keys, and the windows that follow from them."""

    asset: str = "asset"
    date: str = "date"
    context: tuple[str, ...] = ()

    @property
    def series(self) -> list[str]:
        return [*self.context, self.asset]

    @property
    def section(self) -> list[str]:
        return [*self.context, self.date]

    @property
    def keys(self) -> list[str]:
        return [*self.context, self.asset, self.date]

    def ordered(self) -> WindowSpec:
        return kept((self, "ordered"), lambda: Window.partitionBy(*self.series).orderBy(self.date))

    def last(self, n: int) -> WindowSpec:
        return kept((self, "last", n), lambda: self.ordered().rowsBetween(-(n - 1), 0))

    def across(self, *more: str) -> WindowSpec:
        """All rows of a date, in order of asset, so that sums of floating point numbers come out alike in every run."""
        return Window.partitionBy(*self.section, *more).orderBy(self.asset).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    # plain moves

    def lag(self, x, k: int = 1) -> Column:
        if not isinstance(x, str):
            return F.lag(x, k).over(self.ordered())
        return kept((self, "lag", x, k), lambda: F.lag(x, k).over(self.ordered()))

    def lead(self, x, k: int = 1) -> Column:
        return F.lead(col(x), k).over(self.ordered())

    def diff(self, x, k: int = 1) -> Column:
        return col(x) - self.lag(x, k)

    def change(self, x, k: int = 1) -> Column:
        """x over its value k rows ago, less one."""
        return sdiv(x, self.lag(x, k)) - 1

    def running_sum(self, x) -> Column:
        """Null rows stay null; the sum goes on."""
        return F.when(col(x).isNotNull(), F.sum(col(x)).over(self.ordered().rowsBetween(Window.unboundedPreceding, 0)))

    def running_product(self, x) -> Column:
        return F.product(col(x)).over(self.ordered().rowsBetween(Window.unboundedPreceding, 0))

    # full windows

    def full(self, x, n: int, value: Column) -> Column:
        known = lambda: F.count(col(x)).over(self.last(n)) == n
        return F.when(kept((self, "full", x, n), known) if isinstance(x, str) else known(), value)

    def mean(self, x, n: int) -> Column:
        if not isinstance(x, str):
            return self.full(x, n, F.avg(x).over(self.last(n)))
        return kept((self, "mean", x, n), lambda: self.full(x, n, F.avg(x).over(self.last(n))))

    def sum(self, x, n: int) -> Column:
        return self.full(x, n, F.sum(col(x)).over(self.last(n)))

    def min(self, x, n: int) -> Column:
        return self.full(x, n, F.min(col(x)).over(self.last(n)))

    def max(self, x, n: int) -> Column:
        return self.full(x, n, F.max(col(x)).over(self.last(n)))

    def std(self, x, n: int, ddof: int = 0, least: int | None = None) -> Column:
        w = self.last(n)
        value = {0: F.stddev_pop, 1: F.stddev_samp}.get(ddof)
        out = value(col(x)).over(w) if value else F.sqrt(F.var_pop(col(x)).over(w) * F.count(col(x)).over(w) / F.nullif(F.greatest(F.count(col(x)).over(w) - ddof, F.lit(0)), F.lit(0)))
        return F.when(F.count(col(x)).over(w) >= (n if least is None else least), out)

    def kurtosis(self, x, n: int) -> Column:
        """Bias-corrected excess kurtosis; -3 where all values are equal."""
        w = self.last(n)
        corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)).over(w) + 6)
        return self.full(x, n, F.when(F.max(col(x)).over(w) == F.min(col(x)).over(w), F.lit(-3.0)).otherwise(corrected))

    def weighted(self, x, weights: list[float]) -> Column:
        """Weighted mean; the last weight goes to the current row."""
        total = sum(weights)
        terms = [self.lag(x, len(weights) - 1 - i) * (w / total) if i < len(weights) - 1 else col(x) * (w / total) for i, w in enumerate(weights)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def gathered(self, x, n: int) -> Column:
        """The window's values, oldest first; null unless there are n."""
        return self.full(x, n, F.collect_list(col(x)).over(self.last(n)))

    def trend(self, x, n: int, position: str) -> tuple[Column, Column, Column]:
        """Slope, intercept (at the oldest row) and fitted value (at the current row) of a line through the window; position numbers the rows."""
        w = self.last(n)
        slope = self.full(x, n, F.regr_slope(col(x), F.col(position)).over(w))
        mean = self.mean(x, n)
        return slope, mean - slope * (n - 1) / 2, mean + slope * (n - 1) / 2

    def time_correlation(self, x, n: int, position: str) -> Column:
        w = self.last(n)
        spread = F.stddev_pop(col(x)).over(w) * F.stddev_pop(F.col(position)).over(w)
        varies = F.max(col(x)).over(w) > F.min(col(x)).over(w)
        return self.full(x, n, F.when(varies, F.covar_pop(col(x), F.col(position)).over(w) / F.nullif(spread, F.lit(0.0))))

    def sign_entropy(self, x, n: int) -> Column:
        """Entropy of the shares of falls, rests and rises, over ln 3."""
        w, total = self.last(n), None
        for hit in (col(x) < 0, col(x) == 0, col(x) > 0):
            share = F.sum(F.when(hit, 1).otherwise(0)).over(w) / F.lit(float(n))
            term = F.when(share > 0, -share * F.ln(share)).otherwise(0.0)
            total = term if total is None else total + term
        return self.full(x, n, total / math.log(3))


# of arrays that gathered() gives


def mean_abs_deviation(values: Column, mean: Column, n: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / n


def percent_rank(values: Column, x: Column, n: int) -> Column:
    return F.size(F.filter(values, lambda v: v <= x)).cast("double") / n * F.when(values.isNotNull(), F.lit(1.0))


def bin_entropy(values: Column, bins: int) -> Column:
    """Entropy of a histogram of equal bins between the extremes, over ln(max(bins, 2))."""
    low, high = F.array_min(values), F.array_max(values)
    low, high = F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, high + 0.5).otherwise(high)
    place = F.transform(values, lambda v: F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)))
    total = None
    for b in range(bins):
        share = F.size(F.filter(place, lambda p: p == b)) / F.size(values)  # noqa: B023
        term = F.when(share > 0, -share * F.ln(share)).otherwise(0.0)
        total = term if total is None else total + term
    return F.when(values.isNotNull(), total / math.log(max(bins, 2)))


def first_position(values: Column, value: Column) -> Column:
    """How many rows into the window the value first stands, from 0."""
    return F.array_position(values, value).cast("double") - 1


def gaussian_weights(n: int, offset: float, sigma: float) -> list[float]:
    m, s = offset * (n - 1), n / sigma
    return [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]


def fibonacci_weights(n: int) -> list[float]:
    out = [1.0, 1.0]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return out[:n]
