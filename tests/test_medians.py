"""Medians by selection against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.medians import discard, medians


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(2)
    n = 6000
    columns = [r.normal(size=n), np.exp(8 * r.normal(size=n)), r.integers(0, 3, n).astype(float), np.where(r.random(n) < 0.6, 7.0, r.normal(size=n)), np.full(n, np.nan), np.where(r.random(n) < 0.4, np.nan, -np.abs(r.normal(size=n)))]
    rows = [(["a", "b", None][i % 3], *[None if np.isnan(c[i]) and i % 2 else float(c[i]) for c in columns]) for i in range(n)]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} double" for i in range(6))).repartition(5)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("most", [10_000, 40])
def test_equals_sorting(table, by, most):
    names = [f"x{i}" for i in range(6)]
    made = medians(table, names, by, accuracy=200, most=most)
    got = {(*[r[b] for b in by], r["column"]): r["median"] for r in made.collect()}
    clean = table.select("g", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
    want = {(*[r[b] for b in by], c): r[c] for r in clean.groupBy(*by).agg(*[F.median(c).alias(c) for c in names]).collect() for c in names}
    assert got == want
    discard(made)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "x double")
    assert medians(df, ["x"]).first()["median"] == 2.5
    assert [tuple(r) for r in medians(df.limit(0), ["x"]).collect()] == [("x", 0, None)]
    assert medians(df.withColumn("g", F.lit("k")).limit(0), ["x"], ["g"]).count() == 0
