"""Means of long series by slices against the grouped map."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import Panel
from tidemark.operators import scan
from tidemark.operators.recursive import add_recursive

WANTED = {
    "fast": ("ema", "close", 2), "one": ("ema", "close", 1), "slow": ("ema", "close", 50), "w": ("wilder", "close", 14), "line": ("difference", "fast", "slow"), "signal": ("ema", "line", 9),
    "rel": ("spread", "fast", "slow"), "range": ("atr", 5), "strength": ("rsi", 14), "smooth": ("rsx", 14, 5), "share": ("percent", "w", "range"), "odd": ("imbalance", "w", "range"),
}


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = np.random.default_rng(8), []
    for asset, n, gaps in (("A", 900, 0.0), ("B", 700, 0.3), ("C", 3, 0.0), ("D", 400, 0.97), (None, 60, 0.1)):
        price = 50.0
        for i in range(n):
            price = max(0.5, price + r.normal())
            hole = r.random() < gaps or (asset == "B" and 200 <= i < 420)
            close = None if hole else float(round(price, 1)) if i % 11 else float(round(price))
            at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i if i < 300 else i + 5000)
            rows.append((asset, at, float(price + 1), float(price - 1), close))
    return spark.createDataFrame(rows, "asset string, date timestamp_ntz, high double, low double, close double").cache()


def frame(df):
    out = df.toPandas()
    return out.sort_values(["asset", "date"], na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("seconds", [3600, 10**9])
def test_equals_the_grouped_map(bars, seconds):
    got, want = frame(scan.add_segmented(bars, Panel(), WANTED, seconds)), frame(add_recursive(bars.where("asset IS NOT NULL"), Panel(), WANTED))
    assert list(got.columns) == [*bars.columns, *WANTED] and len(got) == bars.count()
    got = got[got["asset"].notna()].reset_index(drop=True)
    for name in WANTED:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-9, err_msg=name)


def test_stretches_of_long_slices(spark):
    """Decays far below a double's range inside one slice, for quick and slow means."""
    n = 20_000
    r = np.random.default_rng(1)
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), float(x)) for i, x in enumerate(np.cumsum(r.normal(size=n)))]
    df = spark.createDataFrame(rows, "asset string, date timestamp_ntz, close double")
    wanted = {f"e{k}": ("ema", "close", k) for k in (2, 3, 20, 500)}
    got, want = frame(scan.add_segmented(df, Panel(), wanted, 15_000)), frame(add_recursive(df, Panel(), wanted))
    for name in wanted:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-9)
    assert scan.stretches_of(2) < 400 < scan.stretches_of(20)


def test_no_python_and_no_whole_series(bars):
    made = scan.add_segmented(bars, Panel(), {"fast": ("ema", "close", 12), "slow": ("ema", "close", 26)}, 600)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
    assert scan.slice_seconds(bars, rows=100) > 0 and made.where(F.col("slow").isNotNull()).count() > 0


def test_unknown_kinds_and_columns(bars):
    with pytest.raises(ValueError):
        scan.add_segmented(bars, Panel(), {"x": ("parabolic", 0.02, 0.2, 0)}, 600)
    with pytest.raises(ValueError):
        scan.add_segmented(bars, Panel(), {"x": ("ema", "nowhere", 3)}, 600)
    made = scan.add_segmented(bars, Panel(), {"x": ("rsi", 3), "y": ("ema", "x", 3)}, 3600)
    assert all(os.path.isdir(t.stored_at) for t in made.reads)
    scan.release(made)
    assert not any(os.path.isdir(t.stored_at) for t in made.reads)
    assert scan.add_segmented(bars.limit(0), Panel(), {"x": ("ema", "close", 3)}).count() == 0


def test_memory_of_a_task_does_not_grow_with_means_or_rows(spark, bars):
    """Slices are dealt to tasks by a fixed number, and one sort by stretch serves all means of a round."""
    scanned = scan.Scan(Panel(), 7)
    now = scan.sliced(bars, Panel(), 600)
    plans = []
    for spans in ((12,), (5, 12, 20, 26)):
        maps = {f"e{k}": (f"p{k}", f"q{k}") for k in spans}
        ready = now.withColumns({c: F.lit(0.5) for m in maps.values() for c in m})
        scanned.together = False
        plans.append(scanned.mapped(scanned.dealt(ready), maps, [])._jdf.queryExecution().executedPlan().toString())
    assert plans[0].count("Sort [") == plans[1].count("Sort [") == 2
    assert all("REPARTITION_BY_NUM" in p and p.count("Exchange") == 1 for p in plans)
    assert scan.extent(bars, rows=100)[1] == -(-bars.count() // 100)
