"""A dataset that grows by appends against one made at once."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import incremental as I
from tidemark.operators.incremental import Recipe, append, create, read_dataset


@pytest.fixture(scope="module")
def bars(spark):
    """Half a year of daily bars: one series ends early, one begins late, one has a hole, one lags behind."""
    r, rows = np.random.default_rng(2), []
    for asset, first, last in (("A", 0, 180), ("B", 0, 180), ("C", 20, 180), ("D", 0, 70), ("E", 150, 180), ("F", 0, 172)):
        price = 40.0
        for i in range(first, last):
            price = max(1.0, price * (1 + 0.04 * r.normal()))
            if asset == "C" and 90 <= i < 130:
                continue
            high, low = price * (1 + 0.02 * r.random()), price * (1 - 0.02 * r.random())
            buy, sell = float(r.integers(1, 90)), float(r.integers(1, 90))
            rows.append((asset, dt.datetime(2024, 1, 10) + dt.timedelta(days=i), low + (high - low) * r.random(), high, low, price, buy, sell, buy + sell, "x"))
    return spark.createDataFrame(rows, "asset string, date timestamp_ntz, open double, high double, low double, close double, buy_volume double, sell_volume double, volume double, source string").cache()


SMALL = Recipe(keys=("rsi", "know_sure_thing", "on_balance_volume", "moving_averages", "bollinger_bands", "price_distance", "linear_regression"), horizons={"1d": 1, "6d": 6})


def frame(df):
    keys = ["date", "asset", "indicator_name", "horizon"]
    return df.toPandas().sort_values(keys).reset_index(drop=True)


def agree(got, want):
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in want.columns:
        if want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert (got[c] == want[c]).all(), c


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def day(n):
    return F.lit(dt.datetime(2024, 1, 10) + dt.timedelta(days=n)).cast("timestamp_ntz")


def test_appends_equal_a_rebuild(bars, tmp_path):
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    held = bars.where(F.col("date") < day(120)).where((F.col("asset") != "F") | (F.col("date") < day(112)))
    create(held, grown, SMALL)
    before = files(f"{grown}/dataset")
    first = append(bars.where(F.col("date").between(day(112), day(139))).join(held.select("asset", "date"), ["asset", "date"], "left_anti"), grown, SMALL)
    after = files(f"{grown}/dataset")
    old = {k: v for k, v in before.items() if int(k.split("month=")[1].split("/")[0]) < first}
    # day 112 is the first of May, and F's last six rows before it look ahead into what came; C's lie before its hole
    assert first == 202404 and old and all(after.get(k) == v for k, v in old.items())
    assert append(bars.where(F.col("date") > day(139)), grown, SMALL) == 202405
    create(bars, whole, SMALL)
    agree(frame(read_dataset(bars.sparkSession, grown)), frame(read_dataset(bars.sparkSession, whole)))
    assert append(bars.limit(0), grown, SMALL) is None
    with pytest.raises(ValueError, match="no later"):
        append(bars.where("asset = 'A'").limit(3), grown, SMALL)


def test_the_whole_catalogue(bars, tmp_path):
    """Rows of unbounded memory and those of bounded memory, all indicators, inactive rows and missing targets too."""
    recipe = Recipe(options={"include_inactive": True, "drop_missing": False})
    create(bars.where(F.col("date") < day(150)), str(tmp_path / "a"), recipe)
    append(bars.where(F.col("date") >= day(150)), str(tmp_path / "a"), recipe)
    want = I.rows_since(bars, recipe).drop("month")
    agree(frame(read_dataset(bars.sparkSession, str(tmp_path / "a"))), frame(want))


def test_corners(bars, tmp_path):
    """Months that lose all their rows go; null keys are left out; repeated keys are errors; folders may begin empty."""
    path = str(tmp_path / "x")
    create(bars.limit(0), path, SMALL)
    assert read_dataset(bars.sparkSession, path).count() == 0
    nameless = bars.limit(5).withColumn("asset", F.lit(None).cast("string"))
    append(bars.where(F.col("date") < day(60)).unionByName(nameless), path, SMALL)
    want = I.rows_since(bars.where(F.col("date") < day(60)), SMALL).drop("month")
    agree(frame(read_dataset(bars.sparkSession, path)), frame(want))
    stray = os.path.join(path, "dataset", "horizon=1d", "month=202403")
    kept = read_dataset(bars.sparkSession, path).count()
    extra = bars.sparkSession.read.schema(bars.sparkSession.read.parquet(f"{path}/schema_dataset").drop("horizon", "month").schema).parquet(f"{path}/dataset/horizon=1d").limit(1)
    extra.write.parquet(os.path.join(path, "dataset", "horizon=old", "month=202403"))
    assert read_dataset(bars.sparkSession, path).count() == kept + 1 and os.path.exists(stray)
    append(bars.where(F.col("date") == day(60)), path, SMALL)
    assert not os.path.exists(os.path.join(path, "dataset", "horizon=old", "month=202403"))
    with pytest.raises(ValueError, match="repeated"):
        append(bars.where(F.col("date") == day(61)).unionByName(bars.where(F.col("date") == day(61))), path, SMALL)
