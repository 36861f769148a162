"""Queries against their SQL on the small tables, value by value."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tidemark.plans import queries as Q

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.01")
CHOSEN = [
    "bars_4h", "resample_timeframes", "all_indicators", "large_panel_indicators", "ind_aroon_indicator", "ind_parabolic_sar", "ind_kaufman_adaptive_moving_average", "ind_even_better_sinewave", "ind_adx", "entropy_bins",
    "signals_trend_filter", "signals_extreme_zone_oscillator", "signals_bollinger", "signals_all_primary", "signals_wide", "signals_to_long", "signals_placeholders", "family_counts", "loo_zscore", "vol_scaled_returns", "cs_scaled_returns", "cross_section_report",
    "targets_long", "single_target", "targets_to_long", "target_alignment", "regression_dataset", "wide_dataset", "whole_dataset_by_indicator", "horizon_purge", "fixed_split", "split_summary", "expanding_folds", "rolling_folds", "temporal_prepared",
    "classification_metrics", "prediction_ranks", "topk_detail", "topk_summary", "confusion", "threshold_sweep", "cross_sectional_scaler", "stream_bars", "tick_means", "stream_means", "logit_scores", "dataset_appended", "sliding_statistics",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(frame, columns):
    out = frame[columns].copy()
    for c in columns:
        out[c] = out[c].map(lambda v: "" if v is None or v != v else repr(float(f"{float(v):.4g}") + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return out.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (Counter(shown(x, columns).itertuples(index=False, name=None)) for x in (got, want))
    assert a == b, (list((a - b))[:3], list((b - a))[:3])


def test_catalogue_is_whole():
    from tidemark.operators.indicators import BASE, catalogue

    cat = catalogue()
    assert len(cat.columns) == 69
    names = {n for v in cat.columns.values() for n in v}
    assert len(names - BASE) == 123


def test_primary_signals():
    from tidemark.functions.windows import Panel
    from tidemark.operators.indicators import catalogue
    from tidemark.operators.signals import families_of, family_counts, signal_columns

    names = [n for v in catalogue().columns.values() for n in v]
    rules = signal_columns(Panel(), names)
    counts = {r: list(rules.values()).count(r) for r in set(rules.values())}
    assert counts == {"centered_oscillator": 22, "extreme_zone_oscillator": 10, "trend_filter": 20, "volume_confirmation": 9, "bollinger": 1}
    assert family_counts(families_of(Panel(), names, context=False)) == {"band_channel_level": 1, "centered_oscillator": 22, "extreme_zone_oscillator": 10, "trend_filter": 20, "volume_confirmation": 9}


def test_backtests_run_every_fold(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.backtest import by_horizon, forest_backtest, horizon_metrics, logit_backtest, top_k
    from tidemark.operators.temporal import Rolling

    windows = Rolling(20, 4, 1)
    data = Q.dataset(spark, "/root/testdata/sf0.001").persist()
    folds = {k for k, *_ in windows.folds(data.select(F.to_date("date")).distinct().count())}
    oos = logit_backtest(data, splitter=windows, horizons=Q.HORIZONS)["oos"]
    assert len(folds) == 3 and {r.fold_id for r in oos.select("fold_id").distinct().collect()} == folds
    forest = forest_backtest(data, splitter=windows, horizons=Q.HORIZONS, trees=5)
    assert {r.fold_id for r in forest["fold_metrics"].collect()} == folds
    groups = oos.where("y_true IS NOT NULL AND y_proba_pred IS NOT NULL").select("date", "asset", "horizon").distinct().count()
    assert top_k(oos)[1].first().n_groups == groups
    # no row of 24d can be trained on in 20 dates
    assert [r.horizon for r in horizon_metrics(by_horizon(data, horizons=Q.HORIZONS, splitter=windows)).orderBy("horizon").collect()] == ["1d", "4d"]
