"""Recursive means of long series, in DataFrame functions: a series is cut by time and its pieces are worked on apart.

A decaying mean is a chain of maps y -> p y + q, one a row; maps compose to such maps. A series is cut into slices of
equal time. In a slice running products of p and sums of q over them give each row's map from the slice's start; a slice
ends in one map, those of a series (few: one a slice) are chained by the same means, and each row applies its map to the
mean that its slice begins with. What a row needs of earlier slices besides (the number of values so far, how long the
last one is ago, the value before) is carried in the same way, so no window holds more than a slice.

Running products fall under what a double holds; the rows of a slice are therefore cut again into stretches over which no
mean decays by more than 1e-150. Stretches are the same for all means of a round, so that rows are sorted once, whatever
the number of means. Stretches end in a map each, too; those of a series (one in some hundred rows) are chained for a few
means at a time, in stretches of each mean's own: one after another owes nothing to what came before the latter, which at
that factor is below the last bit.

A task gets the rows of a slice or of a few: slices are dealt to as many tasks as there are rows for, which Spark is not
to put together again, since all windows over them take memory at once.

Rows meet what is told of their slices by a join; the rows of each round of means are written to the shared folder, so
that plans don't grow with the rounds. The last such table stays for the result to read, until release().

Values are those of the grouped map in recursive.py: null rows carry the mean on and make the next value weigh more, and a
mean is null before as many values as it spans. A series without a date column's value in a row is not defined; dates of a
series are distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Panel, sdiv
from ..sources.stored import drop, store

SLICE, STRETCH = "__slice", "__stretch"
#: Rows of a slice in the densest series, and means that are chained at a time.
ROWS, TOGETHER = 65_536, 3
#: A stretch ends where the product of its maps' factors falls below 10 ** -DECADES.
DECADES = 150
BEFORE, SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def extent(df: DataFrame, panel: Panel = Panel(), rows: int = ROWS) -> tuple[int, int]:
    """Seconds of a slice in which the densest series has about so many rows, and how many tasks have so many; two totals come to the driver."""
    at = F.unix_micros(F.col(panel.date).cast("timestamp")) / 1e6
    each = df.groupBy(*panel.series).agg(F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at)).alias("span"))
    found, n = each.agg(F.min(F.when(F.col("span") > 0, F.col("span") * rows / F.col("n"))), F.sum("n")).first()
    return max(1, int(found or 1)), max(1, math.ceil((n or 0) / rows))


def slice_seconds(df: DataFrame, panel: Panel = Panel(), rows: int = ROWS) -> int:
    return extent(df, panel, rows)[0]


def sliced(df: DataFrame, panel: Panel, seconds: int) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.unix_micros(F.col(panel.date).cast("timestamp")) / F.lit(seconds * 1_000_000)))


class Scan:
    """Windows over the slices of a panel's series, and what goes from slice to slice."""

    def __init__(self, panel: Panel = Panel(), tasks: int = 1):
        self.panel, self.tasks = panel, tasks
        self.part = [*panel.series, SLICE]
        self.made: list[DataFrame] = []
        self.together = False  # whether the rows of a slice are in one task

    def dealt(self, df: DataFrame) -> DataFrame:
        if self.together:
            return df
        self.together = True
        return df.repartition(self.tasks, *self.part)

    def rows(self, frame=SO_FAR, *more: str):
        return Window.partitionBy(*self.part, *more).orderBy(self.panel.date).rowsBetween(*frame)

    def across(self, frame=BEFORE):
        return Window.partitionBy(*self.panel.series).orderBy(SLICE).rowsBetween(*frame)

    def told(self, each: DataFrame, columns: list[Column], *more: str) -> DataFrame:
        """A row a slice (or a stretch, if more names it) of columns that its rows are to meet, stored."""
        out = store(each.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate([*self.part, *more])], *columns), "scan-slices")
        self.made.append(out)
        return out

    def lagged(self, df: DataFrame, columns: Iterable[str]) -> DataFrame:
        """df with __lag_<column>: the value of the row before, whichever slice that is in."""
        df, columns = self.dealt(df), list(columns)
        # slices without rows don't exist, so the slice before is the last one that has some
        one = Window.partitionBy(*self.panel.series).orderBy(SLICE)
        each = df.groupBy(*self.part).agg(*[F.max_by(F.struct(F.col(c).alias("v")), self.panel.date).alias(f"__end_{c}") for c in columns])
        met = self.met(df, self.told(each, [F.lag(f"__end_{c}").over(one).alias(f"__old_{c}") for c in columns]))
        w = Window.partitionBy(*self.part).orderBy(self.panel.date)
        first = F.row_number().over(w) == 1
        return met.withColumns({f"__lag_{c}": F.when(first, F.col(f"__old_{c}.v")).otherwise(F.lag(c).over(w)) for c in columns}).drop(*[f"__old_{c}" for c in columns])

    def mapped(self, df: DataFrame, maps: dict[str, tuple[str, str]], last: Iterable[str]) -> DataFrame:
        """df with its rows' stretches and __a_<name>, __b_<name> for maps (p, q): a row's mean is a times the mean that its stretch begins with, plus b. Of those in last, p is 0 or 1."""
        decaying = [n for n in maps if n not in last]
        lost = [F.when(F.col(p) > 10.0**-DECADES, -F.log10(F.col(p))).otherwise(F.lit(2.0 * DECADES)) for p, _ in (maps[n] for n in decaying)]
        most = F.lit(0.0) if not lost else lost[0] if len(lost) == 1 else F.greatest(*lost)
        df = df.withColumn(STRETCH, F.floor(F.sum(most).over(self.rows()) / DECADES))
        own = self.rows(SO_FAR, STRETCH)
        first = F.row_number().over(own) == 1
        df = df.withColumns({f"__r_{n}": F.product(F.when(first, F.lit(1.0)).otherwise(F.col(maps[n][0]))).over(own) for n in decaying})
        out = {f"__a_{n}": F.first(maps[n][0]).over(own) * F.col(f"__r_{n}") for n in decaying} | {f"__b_{n}": F.col(f"__r_{n}") * F.sum(F.col(maps[n][1]) / F.col(f"__r_{n}")).over(own) for n in decaying}
        for n, (p, q) in ((n, maps[n]) for n in last):
            out |= {f"__a_{n}": F.min(p).over(own), f"__b_{n}": F.coalesce(F.last(F.when(F.col(p) == 0, F.col(q)), ignorenulls=True).over(own), F.lit(0.0))}
        return df.withColumns(out).drop(*[f"__r_{n}" for n in decaying])

    def chained(self, df: DataFrame, maps: dict[str, tuple[str, str]], part: list[str], order: list[str]) -> DataFrame:
        """df with __a_<name>, __b_<name> for maps (p, q): a row's mean is a times the mean that its part begins with, plus b."""
        w = Window.partitionBy(*part).orderBy(*order)
        own = {n: Window.partitionBy(*part, f"__c_{n}").orderBy(*order) for n in maps}
        lost = {n: F.when(F.col(p) > 10.0**-DECADES, -F.log10(F.col(p))).otherwise(F.lit(2.0 * DECADES)) for n, (p, _) in maps.items()}
        df = df.withColumns({f"__c_{n}": F.floor(F.sum(lost[n]).over(w.rowsBetween(*SO_FAR)) / DECADES) for n in maps})
        df = df.withColumns({f"__r_{n}": F.product(F.when(F.row_number().over(own[n]) == 1, F.lit(1.0)).otherwise(F.col(p))).over(own[n].rowsBetween(*SO_FAR)) for n, (p, _) in maps.items()})
        df = df.withColumns({f"__q_{n}": F.col(f"__r_{n}") * F.sum(F.col(q) / F.col(f"__r_{n}")).over(own[n].rowsBetween(*SO_FAR)) for n, (_, q) in maps.items()} | {f"__p_{n}": F.first(p).over(own[n].rowsBetween(*SO_FAR)) * F.col(f"__r_{n}") for n, (p, _) in maps.items()})
        # what the stretch before ended with; null in the first one
        df = df.withColumns({f"__l_{n}": F.lag(f"__q_{n}").over(w) for n in maps})
        df = df.withColumns({f"__l_{n}": F.first(F.struct(F.col(f"__l_{n}").alias("v"))).over(own[n].rowsBetween(*SO_FAR))["v"] for n in maps})
        out = {}
        for n in maps:
            later = F.col(f"__l_{n}").isNotNull()
            out |= {f"__a_{n}": F.when(later, 0.0).otherwise(F.col(f"__p_{n}")), f"__b_{n}": F.col(f"__q_{n}") + F.when(later, F.col(f"__p_{n}") * F.col(f"__l_{n}")).otherwise(0.0)}
        return df.withColumns(out).drop(*[f"__{x}_{n}" for n in maps for x in "crqpl"])

    def means(self, df: DataFrame, wanted: dict[str, tuple[str, float, int]]) -> DataFrame:
        """df with decaying means: name to (column, share of the newest value, values before there is one)."""
        panel, before, df = self.panel, self.across(), self.dealt(df)
        sources = {s: f"__s{i}" for i, s in enumerate(dict.fromkeys(s for s, _, _ in wanted.values()))}
        df = df.withColumn("__row", F.row_number().over(Window.partitionBy(*self.part).orderBy(panel.date)))
        known = {s: F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")) for s in sources}
        each = df.groupBy(*self.part).agg(F.count(F.lit(1)).alias("__n"), *[x for s, k in sources.items() for x in (F.max(F.when(known[s], F.col("__row"))).alias(f"__at{k}"), F.count_if(known[s]).alias(f"__of{k}"))])
        each = each.withColumn("__rows", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        earlier = [F.max(F.col("__rows") + F.col(f"__at{k}")).over(before).alias(f"__last{k}") for k in sources.values()]
        earlier += [F.coalesce(F.sum(f"__of{k}").over(before), F.lit(0)).alias(f"__many{k}") for k in sources.values()]
        df = self.met(df, self.told(each, [F.col("__rows"), *earlier]))
        place, maps, columns = F.col("__rows") + F.col("__row"), {}, {}
        for name, (s, share, least) in wanted.items():
            k = sources[s]
            gap = place - F.coalesce(F.max(F.when(known[s], place)).over(self.rows(BEFORE)), F.col(f"__last{k}"))
            old = F.pow(F.lit(1.0 - share), gap.cast("double"))
            x = F.col(s).cast("double")
            columns[f"__p_{name}__"] = F.when(~known[s], 1.0).otherwise(F.coalesce(old / (old + share), F.lit(0.0)))
            columns[f"__q_{name}__"] = F.when(~known[s], 0.0).otherwise(F.coalesce(share * x / (old + share), x))
            columns[f"__k_{name}__"] = F.col(f"__many{k}") + F.count_if(known[s]).over(self.rows()) >= least
            maps[name] = (f"__p_{name}__", f"__q_{name}__")
        df = df.withColumns(columns).drop("__row", "__rows", *[f"__{x}{k}" for k in sources.values() for x in ("last", "many")])
        last = [n for n, (_, share, _) in wanted.items() if share >= 1]
        df = store(self.mapped(df, maps, last).drop(*[c for m in maps.values() for c in m]), "scan-rows")
        self.together = False
        drop(*self.made)  # what rows met so far is in them now
        self.made = [df]
        ends = store(df.groupBy(*self.part, STRETCH).agg(*[F.max_by(f"__{x}_{n}", panel.date).alias(f"__e{x}_{n}") for n in wanted for x in "ab"]), "scan-ends")
        order, names = [SLICE, STRETCH], list(wanted)
        one = Window.partitionBy(*panel.series).orderBy(*order)
        for some in (names[i : i + TOGETHER] for i in range(0, len(names), TOGETHER)):
            told = self.chained(ends, {n: (f"__ea_{n}", f"__eb_{n}") for n in some}, panel.series, order)
            told = told.withColumns({f"__in_{n}": F.coalesce(F.lag(f"__b_{n}").over(one), F.lit(0.0)) for n in some})
            told = store(told.drop(*[f"__{x}_{n}" for n in some for x in ("a", "b", "ea", "eb")]), "scan-ends")
            drop(ends)
            ends = told
        df = self.met(df, self.told(ends, [F.col(f"__in_{n}") for n in wanted], STRETCH), STRETCH)
        drop(ends)
        out = {n: F.when(F.col(f"__k_{n}__"), F.col(f"__a_{n}") * F.col(f"__in_{n}") + F.col(f"__b_{n}")) for n in wanted}
        return df.withColumns(out).drop(STRETCH, *[f"__{x}_{n}" for n in wanted for x in ("a", "b", "in")], *[f"__k_{n}__" for n in wanted])

    def met(self, df: DataFrame, told: DataFrame, *more: str) -> DataFrame:
        same, n = F.col(SLICE) == F.col(f"__p{len(self.part) - 1}"), len(self.part)
        for i, c in enumerate(self.part[:-1]):
            same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
        for i, c in enumerate(more, n):
            same = same & (F.col(c) == F.col(f"__p{i}"))
        return df.join(told, same).drop(*[f"__p{i}" for i in range(n + len(more))])


#: Kinds of recursive.kernel that decaying means make up.
LINEAR = ("ema", "wilder", "atr", "difference", "spread", "percent", "imbalance", "rsi", "rsx")


def add_segmented(df: DataFrame, panel: Panel, wanted: dict[str, tuple], seconds: int | None = None) -> DataFrame:
    """What recursive.add_recursive adds for the kinds of LINEAR (the same specifications), of series of any length. seconds is the length of a slice; by default one of 65,536 rows."""
    odd = {k for k, *_ in wanted.values()} - set(LINEAR)
    if odd:
        raise ValueError(f"no decaying means: {sorted(odd)}")
    length, tasks = extent(df, panel)
    scan, columns = Scan(panel, tasks), [*df.columns, *wanted]
    now = sliced(df, panel, seconds or length)
    done, left, helpers = set(df.columns), dict(wanted), {}

    def moves(source: str) -> tuple[str, str]:
        """Columns of the rises and falls of a column, once it and its lag are there."""
        nonlocal now
        if f"__up_{source}" not in done:
            now = scan.lagged(now, [source])
            move = F.col(source) - F.col(f"__lag_{source}")
            now = now.withColumns({f"__up_{source}": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), f"__down_{source}": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))})
            done.update((f"__up_{source}", f"__down_{source}"))
        return f"__up_{source}", f"__down_{source}"

    def strength(up: str, down: str) -> Column:
        gain, loss = F.col(up), F.col(down)
        return F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 * sdiv(gain, gain + loss))

    # each round: the means whose sources are there, all in one scan; then the expressions over them
    while left:
        batch, ready = {}, {}
        for name, (kind, *args) in list(left.items()):
            if kind in ("ema", "wilder") and args[0] in done:
                batch[name] = (args[0], 2 / (args[1] + 1) if kind == "ema" else 1 / args[1], args[1])
            elif kind == "atr":
                if "__tr" not in done:
                    now = scan.lagged(now, ["close"])
                    now = now.withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__lag_close")), F.abs(F.col("low") - F.col("__lag_close"))))
                    done.add("__tr")
                batch[name] = ("__tr", 1 / args[0], args[0])
            elif kind == "rsx" and f"__e_{name}" not in helpers:
                helpers[f"__e_{name}"] = ("ema", "close", args[1])
            elif kind in ("rsi", "rsx"):
                source = "close" if kind == "rsi" else f"__e_{name}"
                if source not in done:
                    continue
                up, down = moves(source)
                if f"__g_{name}" in done:
                    if kind == "rsi":
                        ready[name] = strength(f"__g_{name}", f"__f_{name}")
                    elif f"__i_{name}" not in done:
                        ready[f"__i_{name}"] = strength(f"__g_{name}", f"__f_{name}")
                    else:
                        batch[name] = (f"__i_{name}", 2 / (max(2, args[1]) + 1), max(2, args[1]))
                else:
                    batch |= {f"__g_{name}": (up, 1 / args[0], args[0]), f"__f_{name}": (down, 1 / args[0], args[0])}
            elif kind in ("difference", "spread", "percent", "imbalance") and set(args) <= done:
                a, b = map(F.col, args)
                ready[name] = {"difference": lambda: a - b, "spread": lambda: 100 * sdiv(a - b, b), "percent": lambda: 100 * sdiv(a, b), "imbalance": lambda: 100 * sdiv(F.abs(a - b), a + b)}[kind]()  # noqa: B023
        batch |= {n: (s, 2 / (m + 1), m) for n, (_, s, m) in helpers.items() if n not in done}
        if not batch and not ready:
            raise ValueError(f"columns that nothing makes: {sorted(left)}")
        if ready:
            now = now.withColumns(ready)
        if batch:
            now = scan.means(now, batch)
        done.update(batch, ready)
        left = {n: s for n, s in left.items() if n not in done}
    out = now.select(*columns)
    out.reads = scan.made
    return out


def release(df: DataFrame) -> None:
    """Delete the tables that a result of add_segmented reads."""
    drop(*df.reads)


def stretches_of(span: int) -> int:
    """Rows of a stretch of an exponential mean of that span."""
    return max(1, int(DECADES / -math.log10(1 - 2 / (span + 1)))) if span > 1 else 1
