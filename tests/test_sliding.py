"""Sliding order statistics by blocks against the window expressions, and against brute force."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.functions.windows import Panel
from tidemark.operators.sliding import add_sliding

P = Panel()
WANTED = {"up": ("argmax", "close", 7), "down": ("argmin", "close", 7), "rank": ("percent_rank", "close", 5), "mad": ("mean_deviation", "close", 6), "h": ("entropy", "close", 8, 4), "one": ("percent_rank", "close", 1)}


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = np.random.default_rng(5), []
    for asset, n in (("A", 300), ("B", 41), ("C", 3), (None, 30)):
        for i in range(n):
            x = float(r.integers(0, 6))  # many ties
            x = None if r.random() < 0.04 else float("nan") if r.random() < 0.02 else 4.0 if 60 < i < 75 else x
            rows.append((asset, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i if i < 100 else 3 * i), x, f"{asset}{i}"))
    return spark.createDataFrame(rows, "asset string, date timestamp_ntz, close double, `a note` string").cache()


def expected(bars):
    out = bars.withColumn("c", F.when(~F.isnan("close"), F.col("close")))
    out = out.withColumns({f"w{n}": P.gathered("c", n) for n in (1, 5, 6, 7, 8)}).withColumn("m", P.mean("c", 6))
    return out.select("asset", "date", X.first_position(F.col("w7"), F.array_max("w7")).alias("up"), X.first_position(F.col("w7"), F.array_min("w7")).alias("down"), X.percent_rank(F.col("w5"), F.col("c"), 5).alias("rank"), X.mean_abs_deviation(F.col("w6"), F.col("m"), 6).alias("mad"), X.bin_entropy(F.col("w8"), 4).alias("h"), X.percent_rank(F.col("w1"), F.col("c"), 1).alias("one"))


def frame(df):
    return df.toPandas().sort_values(["asset", "date"], na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("block,seconds", [(7, 3600 * 5), (16, 3600 * 40), (65_536, None)])
def test_equals_the_window_expressions(bars, block, seconds):
    got, want = frame(add_sliding(bars, WANTED, P, block, seconds)), frame(expected(bars))
    assert list(got.columns) == [*bars.columns, *WANTED] and len(got) == len(want)
    for name in WANTED:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-12, err_msg=name)


def test_corners(spark, bars):
    assert add_sliding(bars.limit(0), WANTED).count() == 0
    assert add_sliding(bars, {}).count() == bars.count()
    with pytest.raises(ValueError, match="unknown"):
        add_sliding(bars, {"x": ("mode", "close", 3)})


def test_long_windows_cost_little_more(spark):
    x = spark.range(20_000).select(F.lit("A").alias("asset"), F.timestamp_seconds(F.col("id") * 60).alias("date"), F.rand(3).alias("close"))

    def seconds(n):
        began = time.time()
        out = add_sliding(x, {"r": ("percent_rank", "close", n), "u": ("argmax", "close", n)}, P, 4096)
        assert out.where("r IS NOT NULL").count() == 20_000 - n + 1
        return time.time() - began

    seconds(20)
    short = min(seconds(20) for _ in range(2))
    assert min(seconds(500) for _ in range(2)) < 2 * short + 0.5
