"""Edge cases of the panel engine on hand-made bars."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.windows import Panel
from tidemark.operators import metrics as M
from tidemark.operators.indicators import compute_indicators
from tidemark.operators.recursive import ema
from tidemark.operators.targets import cross_scaled_returns, future_returns, normalize_horizons
from tidemark.operators.temporal import Rolling
from tidemark.sources.ohlcv import bars, prepare, scan_mapping, scan_ohlcv

DAY = dt.datetime(2024, 1, 1)


def frame(spark, closes, asset="A", volume=True, spread=1.0):
    rows = [(asset, DAY + dt.timedelta(days=i), c, None if c is None else c + spread, None if c is None else c - spread, c, 10.0 + i) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "asset string, date timestamp_ntz, open double, high double, low double, close double, volume double")
    return df if volume else df.drop("volume")


def last(df, column):
    return df.orderBy("date").toPandas()[column].iloc[-1]


def test_constant_price(spark):
    x = compute_indicators(frame(spark, [5.0] * 60), ["correlation_trend_indicator", "kurtosis", "bollinger_bands", "rsi"], base=False).orderBy("date").toPandas().iloc[-1]
    assert pd.isna(x["cti_20"]) and x["kurtosis_20"] == -3 and pd.isna(x["bb_percent_b_20_2"]) and x["rsi_14"] == 50


def test_monotone_prices(spark):
    up, down = frame(spark, [float(i) for i in range(10, 70)]), frame(spark, [float(i) for i in range(70, 10, -1)])
    keys = ["rsi", "money_flow_index", "aroon_indicator"]
    x = compute_indicators(up, keys, base=False).orderBy("date").toPandas().iloc[-1]
    y = compute_indicators(down, keys, base=False).orderBy("date").toPandas().iloc[-1]
    assert x["rsi_14"] == 100 and pd.isna(x["mfi_14"]) and x["aroon_up_25"] == 96 and x["aroon_down_25"] == 0
    assert y["rsi_14"] == 0 and y["mfi_14"] == 0 and y["aroon_up_25"] == 0 and y["aroon_down_25"] == 96


def test_flat_bars_and_missing_columns(spark):
    x = compute_indicators(frame(spark, [float(i % 7 + 1) for i in range(40)], spread=0.0), ["balance_of_power", "accumulation_distribution_line"], base=False)
    assert x.where("bop IS NOT NULL").count() == 0
    y = compute_indicators(frame(spark, [float(i % 7 + 1) for i in range(40)], volume=False), ["on_balance_volume", "percentage_volume_oscillator", "vix", "elder_ray_index"], base=False)
    assert y.where("obv IS NOT NULL OR pvo_12_26 IS NOT NULL OR vix IS NOT NULL OR elder_ray_bull_13 IS NOT NULL").count() == 0


def test_short_series_and_zero_prices(spark):
    x = compute_indicators(frame(spark, [1.0, 2.0, 0.0, 4.0, 5.0]), ["kaufman_adaptive_moving_average", "rate_of_change", "moving_averages"], base=True).toPandas()
    assert x["kama_10_2_30"].isna().all() and x["sma_10"].isna().all() and np.isfinite(x["simple_return_1"].dropna()).all()


def test_kama_at_full_speed():
    """With fast=1 a steady trend leaves nothing of the mean before: it is the price."""
    from tidemark.operators.recursive import kama, linear_recurrence

    got = kama(pd.Series([float(i) for i in range(1, 41)]), 10, 1, 30)
    assert got.iloc[9] == 5.5 and got.iloc[10:].tolist() == [float(i) for i in range(11, 41)]
    r = np.random.default_rng(0)
    keep, add = np.where(r.random(300) < 0.2, 0.0, r.random(300)), r.normal(size=300)
    want, y = [], 2.0
    for k, a in zip(keep, add):
        y = k * y + a
        want.append(y)
    np.testing.assert_allclose(linear_recurrence(2.0, keep, add), want, rtol=1e-12)


def test_ema_carries_over_gaps():
    x = pd.Series([1.0, np.nan, 3.0])
    a = 2 / 3
    assert ema(x, 2).iloc[2] == pytest.approx(((1 - a) ** 2 * 1 + a * 3) / ((1 - a) ** 2 + a))


def test_features_ignore_the_future(spark):
    closes = [float(np.sin(i) * 5 + 20 + i % 3) for i in range(70)]
    keys = ["macd", "aroon_indicator", "parabolic_sar", "know_sure_thing", "chande_momentum_oscillator"]
    a = compute_indicators(frame(spark, closes[:60]), keys, base=False).orderBy("date").toPandas()
    b = compute_indicators(frame(spark, closes), keys, base=False).orderBy("date").toPandas().iloc[:60]
    pd.testing.assert_frame_equal(a, b)


def test_bars_skip_nulls(spark):
    ticks = frame(spark, [None, 2.0, 3.0])
    got = bars(ticks, "7 days").toPandas()
    assert (got["open"].iloc[0], got["close"].iloc[0]) == (2.0, 3.0)


def test_prepare_keeps_the_last_duplicate(spark):
    x = frame(spark, [1.0, 2.0]).unionByName(frame(spark, [1.0, 9.0])).coalesce(1)
    y = prepare(x.toDF(*[c.upper() for c in x.columns]))
    assert y.count() == 2 and last(y, "close") == 9.0
    with pytest.raises(ValueError):
        prepare(x.drop("close"))


def test_csv_sources(spark, tmp_path):
    head = "date,open,high,low,close,buy_volume,sell_volume,volume\n"
    (tmp_path / "X_BTC_future.csv").write_text(head + "2024-01-01 00:00:00,1,2,1,2,1,1,2\nbad,1,1,1,1,1,1,1\n2024-01-01 00:00:00,1,2,1,3,1,1,2\n")
    x = scan_ohlcv(spark, str(tmp_path)).toPandas()
    assert list(x["asset"]) == ["BTC"] and list(x["close"]) == [3.0]
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "m.csv").write_text("indicator_name;signal_family;natural_direction\nA;f;b\n;g;c\nA;h;d\n")
    assert [r.signal_family for r in scan_mapping(spark, str(tmp_path / "map")).collect()] == ["h"]


def test_horizons_beyond_the_history(spark):
    x = future_returns(frame(spark, [1.0, 2.0, 3.0]), {"far": 9})
    assert x.where("future_return_far IS NOT NULL").count() == 0
    assert normalize_horizons([1, 3]) == {"h1": 1, "h3": 3} and normalize_horizons({"a b": 2}) == {"a_b": 2}
    with pytest.raises(ValueError):
        normalize_horizons([0])


@pytest.mark.parametrize("n", [2, 3, 4])
def test_cross_section_needs_assets(spark, n):
    parts = [frame(spark, [1.0 + i, 2.0 + i * i], asset=str(i)) for i in range(n)]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    known = cross_scaled_returns(x, {"h": 1}).where("future_return_cs_std_h IS NOT NULL").count()
    assert known == (0 if n < 3 else n)


def test_split_counts():
    r = Rolling(10, 3, 2)
    for d in range(10, 60):
        k, e = 0, 10
        while e + 2 < d:
            k, e = k + 1, e + 3
        assert r.n_splits(d) == k
    with pytest.raises(ValueError):
        r.n_splits(9)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.9), (1.0, 0.4), (0.0, 0.1), (None, 0.5)], "target double, pred_proba_success double")
    m = M.classification_metrics(df).first()
    assert (m.n_obs, m.accuracy, m.roc_auc) == (4, 0.5, pytest.approx(0.625))
    one = M.classification_metrics(df.where("target = 1")).first()
    assert one.roc_auc is None
    with pytest.raises(Exception, match="not binary"):
        M.confusion(df.withColumn("pred_class", (df.pred_proba_success * 10).cast("int")), None).collect()


def test_ties_and_nulls_in_ranks(spark):
    df = spark.createDataFrame([("g", "a", 0.5), ("g", "b", 0.5), ("g", "c", 0.9), ("g", "d", None)], "g string, indicator_name string, pred_proba_success double")
    r = {x.indicator_name: (x.rank_pred_proba, x.rank_pct_pred_proba) for x in M.add_ranks(df, ["g"]).collect()}
    assert r == {"c": (1.0, 1.0), "a": (2.0, 0.5), "b": (3.0, 0.5), "d": (None, None)}


def test_panel_with_context(spark):
    a, b = frame(spark, [float(i) for i in range(1, 31)]), frame(spark, [float(31 - i) for i in range(1, 31)])
    from pyspark.sql import functions as F

    x = a.withColumn("timeframe", F.lit("1H")).unionByName(b.withColumn("timeframe", F.lit("4H")))
    y = compute_indicators(x, ["momentum_indicator"], Panel(context=("timeframe",)), base=False)
    assert {r.timeframe: r.m for r in y.groupBy("timeframe").agg(F.min("momentum_10").alias("m")).collect()} == {"1H": 10.0, "4H": -10.0}


def wide(spark):
    """Two features with signals and returns, three assets, one horizon."""
    rows = [(f"A{a}", DAY + dt.timedelta(days=d), 10.0 + a * d, 1.0 if (a + d) % 2 else -1.0, float(d % 3 > 0), 0.5, 0.25, 1.0, 1.0, 2.0, 3.0, 0.4 * (a - 1)) for a in range(3) for d in range(6)]
    sides = ", ".join(f"`{f}__{p}` double" for f in ("rsi_14", "mine") for p in ("signal_direction", "signal_active", "signal_strength", "signal_signed_value"))
    return spark.createDataFrame(rows, f"asset string, date timestamp_ntz, close double, {sides}, future_return_cs_scaled_h1 double")


def test_targets_of_wide_tables(spark):
    from tidemark.operators import reshape as R

    x = R.add_targets(wide(spark), {"h1": 1})
    assert {"rsi_14__target_h1", "mine__target_h1"} <= set(x.columns)
    one = R.add_target(wide(spark), "rsi_14", "h1", inactive="zero")
    zero = one.where("`rsi_14__signal_active` = 0 AND `rsi_14__target_h1` <> 0").count()
    assert zero == 0 and one.where("`rsi_14__target_h1` IS NULL").count() == 0
    later = R.add_target(wide(spark), "rsi_14", "h1", inactive="drop_later")
    assert later.where("`rsi_14__signal_active` = 0 AND `rsi_14__target_h1` = 1").count() > 0
    assert R.signals_to_long(x).count() == 36 and R.targets_to_long(x).count() == 36


def test_dataset_of_wide_tables(spark, caplog):
    from tidemark.operators import reshape as R

    x = R.add_targets(wide(spark), {"h1": 1}, ["rsi_14"])
    with caplog.at_level("WARNING"):
        got = R.wide_dataset(x).toPandas()
    assert "mine" in caplog.text and set(got["indicator_name"]) == {"rsi_14"} and set(got["signal_family"]) == {"extreme_zone_oscillator"} and (got["signal_active"] == 1).all()
    both = R.add_targets(wide(spark), {"h1": 1})
    with pytest.raises(ValueError, match="family"):
        R.wide_dataset(both, families={"rsi_14": "extreme_zone_oscillator"})
    assert R.wide_dataset(both, families={"rsi_14": "a", "mine": "b"}).select("signal_family").distinct().count() == 2
    for bad, match in ((x.unionByName(x), "repeated"), (wide(spark), "target"), (x.drop(*[c for c in x.columns if "__signal_" in c]), "signal")):
        with pytest.raises(ValueError, match=match):
            R.wide_dataset(bad)
    with pytest.raises(ValueError, match="horizons"):
        R.wide_dataset(x, horizons=["h9"])


def test_datasets_are_written_by_horizon(spark, tmp_path):
    from tidemark.operators import reshape as R

    x = R.wide_dataset(R.add_targets(wide(spark), {"h1": 1}, ["rsi_14"]))
    R.write_dataset(x, str(tmp_path / "d"))
    assert (tmp_path / "d" / "horizon=h1").is_dir() and spark.read.parquet(str(tmp_path / "d")).count() == x.count()


def test_dates_are_checked(spark):
    from tidemark.operators.temporal import prepared

    good = spark.createDataFrame([("2024-01-02", "B"), ("2024-01-01", "A")], "date string, asset string")
    assert [r.asset for r in prepared(good).collect()] == ["A", "B"]
    with pytest.raises(Exception, match="no date"):
        prepared(good.unionByName(spark.createDataFrame([("soon", "C")], good.schema))).collect()


@pytest.mark.parametrize("ddof", [0, 1, 2])
def test_deviation_of_any_freedom(spark, ddof):
    parts = [frame(spark, [10.0, 10.0 + i * i], asset=str(i)) for i in range(4)]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = cross_scaled_returns(x, {"h": 1}, ddof=ddof).where("future_return_cs_std_h IS NOT NULL").first().future_return_cs_std_h
    assert got == pytest.approx(np.std([0.0, 0.1, 0.4, 0.9], ddof=ddof))
    raised = cross_scaled_returns(parts[0].unionByName(parts[0].withColumn("asset", parts[0].asset)), {"h": 1}, min_assets=2, policy="epsilon", min_std=0.5)
    assert {r.future_return_cs_std_h for r in raised.collect()} == {0.5, None}


def test_unknown_parameters_are_errors(spark):
    x = frame(spark, [float(i) for i in range(1, 40)])
    y = compute_indicators(x, ["coppock_curve"], config={"coppock": {"long_window": 20}}, base=False)
    assert "coppock_20_11_10" in y.columns
    for bad in ({"coppock": {"long": 20}}, {"copock": {}}):
        with pytest.raises(KeyError):
            compute_indicators(x, ["coppock_curve"], config=bad)
    assert "asset" in compute_indicators(x.withColumnRenamed("volume", "other"), [], config={"general": {"include_all_original_columns": True}}).columns


def kama_by_rows(v, n, fast, slow):
    """The recurrence, row by row."""
    y = [None] * len(v)
    for i in range(len(v)):
        if i == n - 1:
            known = [x for x in v[:n] if x is not None]
            y[i] = sum(known) / len(known) if known else None
        elif i >= n:
            start = y[i - 1] if y[i - 1] is not None else v[i - 1]
            moves = [abs(v[k] - v[k - 1]) if v[k] is not None and v[k - 1] is not None else None for k in range(i - n + 1, i + 1)]
            if v[i] is None or start is None:
                y[i] = y[i - 1]
            else:
                er = 0.0 if None in moves or sum(moves) == 0 or v[i - n] is None else abs(v[i] - v[i - n]) / sum(moves)
                y[i] = start + (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2 * (v[i] - start)
    return y


def test_kama_in_stretches():
    from tidemark.operators.recursive import kama

    r = np.random.default_rng(8)
    for gaps in (0.0, 0.1, 0.6):
        v = [None if r.random() < gaps else float(x) for x in 100 + np.cumsum(r.normal(0, 2, 300))]
        for k in (v, [None] * 15 + v):
            want = np.array([np.nan if x is None else x for x in kama_by_rows(k, 10, 2, 30)])
            np.testing.assert_allclose(kama(pd.Series(k, dtype=float), 10, 2, 30).to_numpy(), want, rtol=1e-9)


def test_tables_of_several_sources(spark):
    from tidemark.sources.ohlcv import union_of

    a, b = frame(spark, [1.0, 2.0]).drop("asset"), frame(spark, [3.0]).drop("asset")
    got = union_of({"1H": {"X": a, "Y": b}, "4H": {"X": b}})
    assert {(r.timeframe, r.asset) for r in got.select("timeframe", "asset").distinct().collect()} == {("1H", "X"), ("1H", "Y"), ("4H", "X")}


def test_tables_as_they_come(spark):
    from tidemark.operators.indicators import features_of

    x = frame(spark, [float(i * i % 11 + 5) for i in range(40)])
    raw = x.unionByName(x.where("close = 5").withColumn("close", x.close * 0 + 7)).selectExpr("asset AS Symbol", "date AS `Date`", "open", "high", "low", "CAST(close AS STRING) AS ` CLOSE`", "volume", "high AS HIGH")
    got = features_of(raw.coalesce(1), ["momentum_indicator"])
    assert got.columns[:2] == ["symbol", "date"] and got.count() == 40
    assert got.where("close = 5").count() == 0 and got.where("momentum_10 IS NOT NULL").count() == 30


def test_close_scores_fall_into_many_steps(spark):
    """Scores within a thousandth of a half, and ties: no step holds much more than its share, and the area is that of ranks."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(6)
    p = 0.5 + 0.001 * r.random(20_000)
    p[:4000] = 0.5
    y = (r.random(20_000) < p + 200 * (p - 0.5005)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"target": y, "pred_proba_success": p}))
    each = df.select(F.col("pred_proba_success").alias("p")).distinct()
    sizes = [x["count"] for x in M.with_steps(each, "p", 64).groupBy("step").count().collect()]
    assert len(sizes) >= 60 and max(sizes) <= 2 * each.count() / 64
    order = pd.Series(p).rank().to_numpy()
    want = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert M.classification_metrics(df).first().roc_auc == pytest.approx(want, abs=1e-12)
    assert M.classification_metrics(df.limit(0)).first().n_obs is None


def test_order_panel_sorts_no_whole_table(spark, tmp_path):
    """First and last lines of a bar, with missing keys and prices and repeated keys; only lines of the outer orders meet an aggregate that sorts."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tidemark.sources.panels import order_panel

    day = dt.datetime(2024, 1, 1, 5)
    rows = [(7, 1, 1, 2.0, 10.0, "O", day), (7, 2, 1, 4.0, 10.0, "F", day), (3, 9, 11, 5.0, 10.0, "O", day), (3, 9, 21, 5.0, 20.0, "O", day), (None, 1, 2, 1.0, 3.0, "O", day), (5, 1, 2, 1.0, 4.0, "O", day), (9, 3, 2, 0.0, 4.0, "F", day), (1, 1, None, 1.0, 6.0, "O", day)]
    x = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz")
    x.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = order_panel(spark, str(tmp_path))
    got = {r.asset: (r.open, r.high, r.low, r.close, r.volume) for r in made.collect()}
    assert got == {"1": (2.0, 5.0, 2.0, 2.5, 16.0), "2": (3.0, 4.0, 3.0, None, 2.0), None: (6.0, 6.0, 6.0, 6.0, 1.0)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and all("min_by" in line for line in plan.splitlines() if "SortAggregate" in line)
    assert made.where(F.col("date").isNull()).count() == 0
