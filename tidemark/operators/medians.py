"""Exact medians of many columns at once, by selection: no task holds a column.

A sketch of each column brackets its middle ranks; values below the bracket are counted and those inside it, a few in
10,000, are stored. What is inside is narrowed in the same way until it is few, sorted, and the middle is read off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import drop, store

#: Rank errors of a sketch are one in ACCURACY; so many values of a column may be gathered in a list.
ACCURACY, MOST = 10_000, 10_000


def medians(df: DataFrame, columns: list[str], by: list[str] | None = None, accuracy: int = ACCURACY, most: int = MOST) -> DataFrame:
    """by, column, n, median: the mean of the two middle values that are neither null nor NaN, as F.median gives; null without any. discard() deletes what it reads.

    Columns are read as doubles. df is read twice.
    """
    by = by or []
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    rows = df.select(*by, *[v.alias(f"__v{i}") for i, v in enumerate(value.values())])
    slack = 2.0 / accuracy
    ends = F.array(F.lit(0.5 - slack), F.lit(0.5 + slack))
    facts = [F.struct(F.lit(i).alias("c"), F.count(f"__v{i}").alias("n"), F.percentile_approx(f"__v{i}", ends, accuracy).alias("q")) for i in range(len(columns))]
    first = rows.groupBy(*by).agg(*[x.alias(f"__f{i}") for i, x in enumerate(facts)])
    state = first.select(*by, F.explode(F.array(*[F.col(f"__f{i}") for i in range(len(columns))])).alias("x")).select(*by, "x.c", "x.n", F.col("x.q")[0].alias("lo"), F.col("x.q")[1].alias("hi"))
    state = store(state, "brackets")
    long = rows.select(*by, F.posexplode(F.array(*[f"__v{i}" for i in range(len(columns))])).alias("c", "v")).where("v IS NOT NULL")
    return _narrowed(long, state, columns, by, accuracy, most)


def _same(by: list[str], prefix: str):
    same = F.col("c") == F.col(f"{prefix}c")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def _narrowed(long: DataFrame, state: DataFrame, columns: list[str], by: list[str], accuracy: int, most: int) -> DataFrame:
    """Brackets as [lo, hi]; base values are known to lie below the rows of long."""
    state = state.withColumn("base", F.lit(0).cast("long"))
    old = [state]
    kept = None
    while True:
        told = state.select(*[F.col(b).alias(f"__s{i}") for i, b in enumerate(by)], F.col("c").alias("__sc"), "lo", "hi")
        met = long.join(F.broadcast(told), _same(by, "__s")) if kept is None else long.join(told, _same(by, "__s"))
        counts = met.groupBy(*by, "c").agg(F.count_if(F.col("v") < F.col("lo")).alias("under"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("inside"))
        inside = store(met.where(F.col("v").between(F.col("lo"), F.col("hi"))).select(*by, "c", "v"), "inside")
        named = counts.select(*[F.col(b).alias(f"__s{i}") for i, b in enumerate(by)], F.col("c").alias("__sc"), "under", "inside")
        checked = state.join(named, _same(by, "__s"), "left").select(*by, "c", "n", "lo", "hi", (F.col("base") + F.coalesce("under", F.lit(0))).alias("base"), F.coalesce("inside", F.lit(0)).alias("inside"))
        checked = store(checked, "counts")
        drop(*old, *([kept] if kept is not None else []))
        old, kept = [checked], inside
        low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
        wrong = checked.where((F.col("n") > 0) & ((low < F.col("base")) | (high >= F.col("base") + F.col("inside"))))
        if not wrong.isEmpty():
            raise ArithmeticError("a sketch missed the middle by more than its accuracy")
        wide = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
        if checked.where(wide).isEmpty():
            break
        # neighbours, in a grid of the bracket's quantiles, of the ranks that are looked for
        grid = 64
        marks = inside.groupBy(*by, "c").agg(F.percentile_approx("v", F.array(*[F.lit(k / grid) for k in range(grid + 1)]), accuracy).alias("marks"))
        marks = marks.select(*[F.col(b).alias(f"__s{i}") for i, b in enumerate(by)], F.col("c").alias("__sc"), "marks")
        share = lambda rank: (rank - F.col("base")) / F.col("inside") * grid
        lower, upper = F.greatest(F.floor(share(low)) - 1, F.lit(0)), F.least(F.ceil(share(high)) + 1, F.lit(grid))
        state = checked.join(marks, _same(by, "__s"), "left").select(*by, "c", "n", F.when(wide, F.col("marks")[lower.cast("int")]).otherwise(F.col("lo")).alias("lo"), F.when(wide, F.col("marks")[upper.cast("int")]).otherwise(F.col("hi")).alias("hi"), "base")
        long = inside
    gathered = inside.join(checked.select(*[F.col(b).alias(f"__s{i}") for i, b in enumerate(by)], F.col("c").alias("__sc"), "lo", "hi"), _same(by, "__s")).where("lo < hi").groupBy(*by, "c").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    gathered = gathered.select(*[F.col(b).alias(f"__s{i}") for i, b in enumerate(by)], F.col("c").alias("__sc"), "vs")
    at = lambda rank: F.col("vs")[(rank - F.col("base")).cast("int")]
    middle = F.when(F.col("n") == 0, None).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((at(low) + at(high)) / 2)
    names = F.array(*[F.lit(c) for c in columns])
    out = checked.join(gathered, _same(by, "__s"), "left").select(*by, names[F.col("c")].alias("column"), "n", middle.alias("median"))
    out.reads = [checked, inside]
    return out


def discard(made: DataFrame) -> None:
    drop(*made.reads)
