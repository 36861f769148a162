"""Registered queries of the panel engine: one or more for each kind of operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import Panel
from ..operators import metrics as M
from ..operators.backtest import by_horizon, forest_backtest, horizon_metrics, logit_backtest, top_k
from ..operators.batched import fit_batched, grid_batched
from ..operators.dataset import dataset_summary, duplicate_keys, regression_dataset
from ..operators.incremental import Recipe, append, create, read_dataset
from ..operators.indicators import catalogue, compute_indicators
from ..operators.ml import cross_sectional_scale, fit_forest, grid
from ..operators.reshape import add_target, add_targets, dataset_order, signals_to_long, targets_to_long, wide_dataset
from ..operators.scan import add_segmented
from ..operators.signals import add_signals, leave_one_out, wide_signals
from ..operators.sliding import add_sliding
from ..operators.targets import alignment_report, cross_scaled_returns, cross_section_report, future_returns, target_report, targets_long, validate_alignment, vol_scaled_returns
from ..operators.temporal import Rolling, block, calendar, expanding_folds, fixed_split, prepared, purge, split_summary
from ..sources.ohlcv import bars, null_counts, panel_of
from ..sources.panels import event_panel, order_panel
from ..sources.stored import drop, store
from ..streaming.bars import drain, event_ticks, place_for, stream_bars
from ..streaming.means import run_to_end, stream_means
from . import oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HORIZONS = O.RETURNS


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, without negative zeros; 0 digits means seven figures."""
    one = lambda c: F.col(c).cast("float").cast("double") if digits == 0 else F.round(c, digits) + F.lit(0.0)
    return df.select(*[one(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _indicator(key: str) -> None:
    @query(f"ind_{key}", O.indicator_sql(key))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compute_indicators(event_panel(spark, sf_dir), [key], base=False)
        return rounded(out.select("asset", "date", *catalogue().columns[key]), 0 if key in O.LARGE else 6)


for _key in catalogue().columns:
    _indicator(_key)

# sources

BAR_NAMES = ["open", "high", "low", "close", "buy_volume", "sell_volume", "volume"]


def _bars(name: str, hours: int, timeframe: str) -> None:
    @query(name, f"WITH {O.event_bars(hours)} SELECT asset, date, {O.rounded(BAR_NAMES)} FROM bars")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(event_panel(spark, sf_dir, timeframe).select("asset", "date", *BAR_NAMES))


for _n, _h, _t in (("bars_1h", 1, "1H"), ("bars_4h", 4, "4H"), ("bars_1d", 24, "1D")):
    _bars(_n, _h, _t)

ROLLED = f"""WITH {O.event_bars(1)} SELECT asset, timeframe, date, {O.rounded(['open', 'high', 'low', 'close', 'volume'])} FROM (
SELECT asset, '4H' AS timeframe, time_bucket(INTERVAL '4 hours', date) AS date, arg_min(open, b.date) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.date) AS close, sum(volume) AS volume FROM bars b GROUP BY 1, 2, 3
UNION ALL SELECT asset, '1D', time_bucket(INTERVAL '24 hours', date), arg_min(open, b.date), max(high), min(low), arg_max(close, b.date), sum(volume) FROM bars b GROUP BY 1, 2, 3)"""


@query("resample_timeframes", ROLLED)
def resample_timeframes(spark, sf_dir):
    hours = event_panel(spark, sf_dir, "1H")
    return rounded(panel_of(hours, ("4H", "1D")).select("asset", "timeframe", "date", "open", "high", "low", "close", "volume"))


@query("order_bars_1d", f"WITH {O.order_bars()} SELECT asset, date, {O.rounded(BAR_NAMES, 0)} FROM bars")
def order_bars_1d(spark, sf_dir):
    return rounded(order_panel(spark, sf_dir).select("asset", "date", *BAR_NAMES), 0)


@query("null_counts", f"WITH {O.event_bars(4)}, f AS ({O.indicator_sql('rate_of_change', digits=None)}) SELECT asset, count(*) FILTER (WHERE roc_10 IS NULL) AS roc_10, 0::BIGINT AS close FROM f GROUP BY asset".replace(f"WITH {O.event_bars(4)}, f", "WITH f", 1))
def nulls(spark, sf_dir):
    x = compute_indicators(event_panel(spark, sf_dir), ["rate_of_change"], base=False)
    return null_counts(x.select("asset", "close", "roc_10"))


BASE_NAMES = ["hlc_average", "median_price", "ohlc_average", "true_range", "simple_return_1", "log_return_1"]


@query("base_features", f"""WITH {O.event_bars(4)} SELECT asset, date, {O.rounded(BASE_NAMES)} FROM (SELECT asset, date, {O.HLC} AS hlc_average, (high + low) / 2 AS median_price, (open + high + low + close) / 4 AS ohlc_average, {O.TR} AS true_range,
{O.div('close', O.lag('close'))} - 1 AS simple_return_1, CASE WHEN close > 0 AND {O.lag('close')} > 0 THEN ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN {O.lag('close')} > 0 THEN {O.lag('close')} END) END AS log_return_1 FROM bars)""")
def base_features(spark, sf_dir):
    return rounded(compute_indicators(event_panel(spark, sf_dir), [], base=True).select("asset", "date", *BASE_NAMES))


_ALL = [n for names in catalogue().columns.values() for n in names]
_BIG = [n for k in O.LARGE for n in catalogue().columns[k]]
_DISTINCT = list(dict.fromkeys([*BASE_NAMES, *_ALL]))


@query("all_indicators", f"WITH feats AS ({O.features_sql(list(catalogue().columns))}), b AS (SELECT asset, date, {O.div('close', O.lag('close'))} - 1 AS simple_return_1, {O.TR} AS true_range, CASE WHEN close > 0 AND {O.lag('close')} > 0 THEN ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN {O.lag('close')} > 0 THEN {O.lag('close')} END) END AS log_return_1 FROM feats) SELECT asset, date, {O.rounded([n for n in _DISTINCT if n not in _BIG])}, {O.rounded(_BIG, 0)} FROM feats JOIN b USING (asset, date)")
def all_indicators(spark, sf_dir):
    """The whole catalogue in one pass."""
    out = compute_indicators(event_panel(spark, sf_dir))
    small = rounded(out.select("asset", "date", *[n for n in _DISTINCT if n not in _BIG], *[F.col(n).cast("float").alias(n) for n in _BIG]))
    return small.select(*[F.col(n).cast("double").alias(n) if n in _BIG else F.col(n) for n in small.columns])


_LARGE_PANEL = ["bollinger_bands", "donchian_channel", "acceleration_bands", "awesome_oscillator", "bias_indicator", "chande_momentum_oscillator", "coppock_curve", "detrended_price_oscillator", "ease_of_movement", "know_sure_thing", "qstick_indicator", "relative_vigor_index", "midprice_indicator", "quantile_indicator", "commodity_channel_index", "stochastic_oscillator", "alma", "aroon_indicator", "efficiency_ratio", "ichimoku", "chaikin_money_flow", "on_balance_volume"]
_GAPPED = O.order_bars().replace("bars AS (", "whole AS (", 1) + ", bars AS (SELECT asset, date, open, high, low, CASE WHEN day(date) % 17 <> 3 THEN close END AS close, CASE WHEN day(date) % 13 <> 5 THEN volume END AS volume FROM whole WHERE day(date) <> 29)"
_LARGE_NAMES = [n for k in _LARGE_PANEL for n in catalogue().columns[k]]


def _gapped_sql() -> str:
    out = "bars"
    for i, key in enumerate(_LARGE_PANEL):
        ctes, last = O.staged("", O.INDICATORS[key])
        out += f" JOIN (WITH {ctes.lstrip(',').strip().removeprefix(',')} SELECT asset, date, {', '.join(catalogue().columns[key])} FROM {last}) f{i} USING (asset, date)"
    return f"WITH {_GAPPED} SELECT asset, date, {O.rounded(_LARGE_NAMES, 0)} FROM {out}"


@query("large_panel_indicators", _gapped_sql())
def large_panel(spark, sf_dir):
    """Some 20,000 daily bars with missing prices, volumes and days; seven figures."""
    x, day = order_panel(spark, sf_dir), F.dayofmonth("date")
    x = x.where(day != 29).select("asset", "date", "open", "high", "low", F.when(day % 17 != 3, F.col("close")).alias("close"), F.when(day % 13 != 5, F.col("volume")).alias("volume"))
    return rounded(compute_indicators(x, _LARGE_PANEL, base=False).select("asset", "date", *_LARGE_NAMES), 0)


_BINS = " + ".join(f"(CASE WHEN len(list_filter(k, lambda x: x = {b})) > 0 THEN -(len(list_filter(k, lambda x: x = {b})) / 20.0) * ln(len(list_filter(k, lambda x: x = {b})) / 20.0) ELSE 0 END)" for b in range(10))


@query("entropy_bins", f"""WITH {O.event_bars(4)}, r AS (SELECT asset, date, CASE WHEN close > 0 AND {O.lag('close')} > 0 THEN ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN {O.lag('close')} > 0 THEN {O.lag('close')} END) END AS r FROM bars),
v AS (SELECT *, {O.glist('r', 20)} AS v FROM r), m AS (SELECT *, CASE WHEN list_min(v) = list_max(v) THEN list_min(v) - 0.5 ELSE list_min(v) END AS lo, CASE WHEN list_min(v) = list_max(v) THEN list_max(v) + 0.5 ELSE list_max(v) END AS hi FROM v),
b AS (SELECT *, list_transform(v, lambda x: least(floor((x - lo) / (hi - lo) * 10), 9)) AS k FROM m) SELECT asset, date, round(CASE WHEN v IS NOT NULL THEN ({_BINS}) / ln(10) END, 6) + 0.0 AS entropy_20 FROM b""")
def entropy_bins(spark, sf_dir):
    out = compute_indicators(event_panel(spark, sf_dir), ["entropy_indicator"], config={"entropy": {"mode": "bins"}}, base=False)
    return rounded(out.select("asset", "date", "entropy_20"))


# signals

PARTS = ["value", "signal_direction", "signal_active", "signal_strength", "signal_signed_value", "cs_mean_loo", "cs_std_loo", "cs_zscore_loo"]


def features(spark: SparkSession, sf_dir: str, rules: list[str]) -> DataFrame:
    return compute_indicators(event_panel(spark, sf_dir), sorted({k for r in rules for k in O.SIGNALS[r].values()}), base=False)


def chosen(rules: list[str]) -> dict[str, str]:
    return {c: r for r in rules for c in O.SIGNALS[r]}


def _signals(rule: str) -> None:
    keys = sorted(set(O.SIGNALS[rule].values()))
    digits = 0 if rule == "volume_confirmation" else 5
    names = O.rounded(PARTS, digits) if digits == 0 else ", ".join(f"round(CAST({n} AS DOUBLE), 5) + 0.0 AS {n}" for n in PARTS)
    sql = f"WITH feats AS ({O.features_sql(keys)}), {O.signals_sql([rule])} SELECT asset, date, indicator_name, CASE WHEN rule = 'bollinger' THEN 'band_channel_level' ELSE rule END AS signal_family, {names} FROM (SELECT * RENAME (mu AS cs_mean_loo, sd AS cs_std_loo, z AS cs_zscore_loo) FROM sig)"

    @query(f"signals_{rule}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(add_signals(features(spark, sf_dir, [rule]), columns=chosen([rule])).select("asset", "date", "indicator_name", "signal_family", *PARTS), digits)


for _r in O.SIGNALS:
    _signals(_r)


SIDES = ["signal_direction", "signal_active", "signal_strength", "signal_signed_value"]
_CENTRED = f"WITH feats AS ({O.features_sql(sorted(set(O.SIGNALS['centered_oscillator'].values())))}), {O.returns_sql('feats')}, {O.signals_sql(['centered_oscillator'], 'cs', ''.join(f', future_return_cs_scaled_{x}' for x in HORIZONS))}"
_SIDES = ", ".join(f"round({p}, 5) + 0.0 AS {p}" for p in SIDES)


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, forward returns and the signals of the centred oscillators, one row a bar."""
    rules = ["centered_oscillator"]
    x = cross_scaled_returns(features(spark, sf_dir, rules), HORIZONS)
    carry = ["close", *[c for c in x.columns if c.startswith("future_return")]]
    return wide_signals(add_signals(x, columns=chosen(rules), carry=carry), carry=carry)


@query("signals_wide", f"{_CENTRED} SELECT asset, date, " + ", ".join(f"round(max({p}) FILTER (WHERE indicator_name = '{n}'), 5) + 0.0 AS {n}__{p}" for n in O.SIGNALS["centered_oscillator"] for p in SIDES) + " FROM sig GROUP BY asset, date")
def signals_wide(spark, sf_dir):
    wide = wide_table(spark, sf_dir)
    return rounded(wide.select("asset", "date", *[f"{n}__{p}" for n in O.SIGNALS["centered_oscillator"] for p in SIDES]), 5)


@query("signals_to_long", f"{_CENTRED} SELECT asset, date, indicator_name, {_SIDES} FROM sig")
def long_again(spark, sf_dir):
    return rounded(signals_to_long(wide_table(spark, sf_dir)), 5)


_PRIMARY, _LIMITS = O.all_primary()
_EVERY = sorted({k for r in _PRIMARY.values() for k in r.values()})
_ALL_SIGNALS = f"WITH feats AS MATERIALIZED ({O.features_sql(_EVERY)}), {O.signals_sql(list(_PRIMARY), 'feats', '', _PRIMARY, _LIMITS)}"
_FAMILY = "CASE WHEN rule = 'bollinger' THEN 'band_channel_level' ELSE rule END"


@query("signals_all_primary", f"{_ALL_SIGNALS} SELECT {_FAMILY} AS signal_family, indicator_name, count(signal_direction) AS n_directions, CAST(sum(signal_active) AS BIGINT) AS n_active FROM sig GROUP BY 1, 2")
def signals_all_primary(spark, sf_dir):
    """All primary columns of the whole catalogue, counted by family and activity."""
    long = add_signals(compute_indicators(event_panel(spark, sf_dir)))
    return long.groupBy("signal_family", "indicator_name").agg(F.count("signal_direction").alias("n_directions"), F.sum("signal_active").cast("long").alias("n_active"))


_BANDS = [n for n in ("accbands_percent_b_20", "donchian_width_20", "keltner_width_20_10_2")]


@query("signals_placeholders", f"WITH {O.event_bars(4)} SELECT signal_family, indicator_name, (SELECT count(*) FROM bars) AS n_rows, 0::BIGINT AS n_signals FROM (VALUES " + ", ".join(f"('{f}', '{n}')" for f, n in [*[("band_channel_level", n) for n in _BANDS], ("context_filter", "atr_14")]) + ") q(signal_family, indicator_name)")
def placeholders(spark, sf_dir):
    """Bands without a rule and context filters, where rows without a signal are asked for."""
    x = compute_indicators(event_panel(spark, sf_dir), ["acceleration_bands", "donchian_channel", "keltner_channel", "atr"], base=False)
    long = add_signals(x, config={"unimplemented_bands": "nan", "context_placeholders": True})
    return long.groupBy("signal_family", "indicator_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.coalesce("signal_direction", "signal_active", "signal_strength", "signal_signed_value")).alias("n_signals"))


@query("loo_zscore", f"""WITH {O.event_bars(4)}, d AS (SELECT asset, date, close - {O.lag('close')} AS d FROM bars), o AS (SELECT a.asset, a.date, any_value(a.d) AS d, avg(b.d) AS mu, CASE WHEN count(b.d) > 1 THEN stddev_samp(b.d) END AS sd FROM d a LEFT JOIN d b ON a.date = b.date AND a.asset <> b.asset GROUP BY 1, 2)
SELECT asset, date, round(mu, 5) + 0.0 AS mean, round(CASE WHEN sd >= 1e-12 THEN sd END, 5) + 0.0 AS std, round((d - mu) / CASE WHEN sd >= 1e-12 THEN sd END, 5) + 0.0 AS z FROM o""")
def loo_zscore(spark, sf_dir):
    """Against a join of every row with the others of its date, which the engine does by sums."""
    p = Panel()
    x = event_panel(spark, sf_dir).withColumn("d", p.diff("close"))
    mean, std, z = leave_one_out("d", p.across())
    return rounded(x.select("asset", "date", mean.alias("mean"), std.alias("std"), z.alias("z")), 5)


# returns and targets

_R = [f"future_return_{x}" for x in HORIZONS]


@query("future_returns", f"""WITH {O.event_bars(4)} SELECT asset, date, {O.rounded(_R + [r.replace('return', 'log_return') for r in _R])} FROM (SELECT asset, date, {', '.join(f"{O.div(O.lead('close', h), 'close')} - 1 AS future_return_{x}, CASE WHEN close > 0 AND {O.lead('close', h)} > 0 THEN ln(CASE WHEN {O.lead('close', h)} > 0 THEN {O.lead('close', h)} END) - ln(CASE WHEN close > 0 THEN close END) END AS future_log_return_{x}" for x, h in HORIZONS.items())} FROM bars)""")
def returns(spark, sf_dir):
    out = future_returns(event_panel(spark, sf_dir), HORIZONS)
    return rounded(out.select("asset", "date", *_R, *[r.replace("return", "log_return") for r in _R]))


_S = [f"future_return_scaled_{x}" for x in HORIZONS]


@query("vol_scaled_returns", f"""WITH {O.event_bars(4)}, a AS (SELECT *, {O.div('close', O.lag('close'))} - 1 AS r, {', '.join(f"{O.div(O.lead('close', h), 'close')} - 1 AS f_{x}" for x, h in HORIZONS.items())} FROM bars),
v AS (SELECT *, {O.full('r', 20, f"stddev_samp(r) {O.w(20)}")} AS s FROM a), g AS (SELECT *, CASE WHEN s >= 1e-12 THEN s END AS past_vol_simple_20 FROM v)
SELECT asset, date, {O.rounded(['past_vol_simple_20', *_S])} FROM (SELECT *, {', '.join(f'f_{x} / past_vol_simple_20 AS future_return_scaled_{x}' for x in HORIZONS)} FROM g)""")
def vol_scaled(spark, sf_dir):
    return rounded(vol_scaled_returns(event_panel(spark, sf_dir), HORIZONS).select("asset", "date", "past_vol_simple_20", *_S))


_C = [f"future_return_cs_{k}_{x}" for x in HORIZONS for k in ("std", "scaled")]


@query("cs_scaled_returns", f"WITH {O.event_bars(4)}, {O.returns_sql()} SELECT asset, date, {O.rounded(_C)} FROM cs")
def cs_scaled(spark, sf_dir):
    return rounded(cross_scaled_returns(event_panel(spark, sf_dir), HORIZONS).select("asset", "date", *_C))


RULES = ["centered_oscillator", "extreme_zone_oscillator", "bollinger"]
_KEYS = sorted({k for r in RULES for k in O.SIGNALS[r].values()})
_CARRY = "".join(f", future_return_cs_scaled_{x}" for x in HORIZONS)
_TARGETS = f"WITH feats AS ({O.features_sql(_KEYS)}), {O.returns_sql('feats')}, {O.signals_sql(RULES, 'cs', _CARRY)}, {O.target_rows()}"


def target_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cross_scaled_returns(features(spark, sf_dir, RULES), HORIZONS)
    return targets_long(add_signals(x, columns=chosen(RULES), carry=[f"future_return_cs_scaled_{h}" for h in HORIZONS]), HORIZONS)


@query("targets_long", f"{_TARGETS} SELECT asset, date, indicator_name, horizon, signal_direction, signal_active, target FROM tgt")
def targets(spark, sf_dir):
    return target_table(spark, sf_dir).select("asset", "date", "indicator_name", "horizon", "signal_direction", "signal_active", "target")


@query("target_report", f"{_TARGETS} SELECT horizon, count(*) AS n_rows, count(*) FILTER (WHERE signal_active = 1) AS n_active, count(target) AS n_targets, count(*) FILTER (WHERE target = 1) AS n_positive, count(*) FILTER (WHERE target = 0) AS n_zero, count(*) FILTER (WHERE target IS NULL) AS n_null, round(avg(target), 6) + 0.0 AS target_rate FROM tgt GROUP BY horizon")
def report(spark, sf_dir):
    return rounded(target_report(target_table(spark, sf_dir)))


_TAU = f"{_CENTRED}, {O.target_rows(tau=0.1)}"


@query("single_target", f"{_TAU} SELECT asset, date, target AS roc_10__target_4d FROM tgt WHERE indicator_name = 'roc_10' AND horizon = '4d'")
def single_target(spark, sf_dir):
    return add_target(wide_table(spark, sf_dir), "roc_10", "4d").select("asset", "date", "roc_10__target_4d")


@query("targets_to_long", f"{_TAU} SELECT asset, date, indicator_name, horizon, target FROM tgt")
def targets_again(spark, sf_dir):
    return targets_to_long(add_targets(wide_table(spark, sf_dir), HORIZONS))


@query("wide_dataset", f"{_TAU} SELECT asset, date, indicator_name, rule AS signal_family, horizon, {_SIDES}, target FROM tgt WHERE signal_active = 1 AND target IS NOT NULL")
def from_wide(spark, sf_dir):
    out = wide_dataset(add_targets(wide_table(spark, sf_dir), HORIZONS), panel=Panel(), context=[])
    return rounded(dataset_order(out), 5)


_GROUPS = ", ".join(f"(SELECT count(*) FILTER (WHERE {c}) FROM (SELECT date, count(r) AS n, stddev_samp(r) AS s FROM (SELECT date, CASE q.h WHEN '1d' THEN future_return_1d WHEN '4d' THEN future_return_4d ELSE future_return_24d END AS r FROM cs) GROUP BY date)) AS cs_group_{n}" for n, c in (("count", "true"), ("nan_std_count", "s IS NULL"), ("insufficient_assets_count", "n < 3"), ("small_std_count", "s < 1e-12")))


@query("cross_section_report", f"WITH {O.event_bars(4)}, {O.returns_sql()} SELECT h AS horizon, {_GROUPS} FROM (VALUES ('1d'), ('4d'), ('24d')) q(h)")
def groups(spark, sf_dir):
    return cross_section_report(future_returns(event_panel(spark, sf_dir), HORIZONS, log=False), HORIZONS)


@query("target_alignment", f"""{_TAU} SELECT horizon, CASE horizon WHEN '1d' THEN 1 WHEN '4d' THEN 4 ELSE 24 END AS horizon_steps, indicator_name AS feature, 'future_return_cs_scaled_' || horizon AS future_return_col, indicator_name || '__target_' || horizon AS target_col, count(*) AS num_rows, 0::BIGINT AS num_duplicate_asset_datetime,
count(*) FILTER (WHERE fr IS NULL) AS future_return_nan_count, count(*) FILTER (WHERE target IS NULL) AS target_nan_count, count(*) FILTER (WHERE target = 1) AS target_positive_count, count(*) FILTER (WHERE target = 0) AS target_zero_count, round(avg(signal_active) FILTER (WHERE fr IS NOT NULL), 6) + 0.0 AS active_rate_on_available_returns,
'cross_sectional_future_return' AS target_scaling, true AS future_return_cs_std_alignment_ok, 0.0::DOUBLE AS future_return_cs_std_alignment_max_abs_diff, horizon <> '4d' AS future_return_alignment_ok, CASE WHEN horizon = '4d' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS future_return_alignment_max_abs_diff,
any_value(g.cs_group_count) AS cs_group_count, any_value(g.cs_group_nan_std_count) AS cs_group_nan_std_count, any_value(g.cs_group_insufficient_assets_count) AS cs_group_insufficient_assets_count, any_value(g.cs_group_small_std_count) AS cs_group_small_std_count
FROM tgt JOIN (SELECT h AS gh, {_GROUPS} FROM (VALUES ('1d'), ('4d'), ('24d')) q(h)) g ON gh = horizon GROUP BY horizon, indicator_name""")
def target_alignment(spark, sf_dir):
    """Returns of one horizon are one off for one asset; the report must say so."""
    wide = add_targets(wide_table(spark, sf_dir), HORIZONS)
    off = "future_return_cs_scaled_4d"
    wide = wide.withColumn(off, F.when(F.col("asset") == wide.agg(F.min("asset")).first()[0], F.col(off) + 1).otherwise(F.col(off)))
    return rounded(validate_alignment(wide, HORIZONS))


@query("column_agreement", f"WITH {O.event_bars(4)}, {O.returns_sql()} SELECT c AS \"column\", (SELECT count(*) FROM bars) AS n_rows, 0.0::DOUBLE AS max_abs_diff, true AS aligned FROM (VALUES {', '.join(f"('{c}')" for c in _R)}) q(c)")
def column_agreement(spark, sf_dir):
    x = event_panel(spark, sf_dir)
    return rounded(alignment_report(future_returns(x, HORIZONS, log=False), future_returns(x.orderBy("close"), HORIZONS, log=False), ["asset", "date"], _R))


# datasets


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*_KEYS, "price_distance", "midpoint_indicator"]
    x = compute_indicators(event_panel(spark, sf_dir), keys, base=False)
    keep = ["asset", "date", "close", *sorted(chosen(RULES)), "bb_lower_20_2", "bb_upper_20_2", "price_distance_sma_20", "midpoint_14"]
    return regression_dataset(x.select(*keep), horizons=HORIZONS, check=event_panel(spark, sf_dir))


def whole_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset over all primary columns of the catalogue and all context features; the models are fitted on it."""
    panel = event_panel(spark, sf_dir)
    return regression_dataset(compute_indicators(panel), horizons=HORIZONS, check=panel)


_WHOLE = f"WITH feats AS MATERIALIZED ({O.features_sql(_EVERY)}), {O.returns_sql('feats')}, {O.signals_sql(list(_PRIMARY), 'cs', _CARRY, _PRIMARY, _LIMITS)}, {O.target_rows()}, k AS (SELECT * FROM tgt WHERE signal_active = 1 AND target IS NOT NULL)"


@query("whole_dataset_by_indicator", f"{_WHOLE} SELECT indicator_name, horizon, count(*) AS n_rows, round(avg(target), 6) + 0.0 AS target_rate FROM k GROUP BY 1, 2")
def whole(spark, sf_dir):
    out = whole_dataset(spark, sf_dir).groupBy("indicator_name", "horizon").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("target").alias("target_rate"))
    return rounded(out)


@query("family_counts", f"{_WHOLE} SELECT CASE WHEN rule = 'bollinger' THEN 'band_channel_level' ELSE rule END AS signal_family, count(DISTINCT indicator_name) AS n_features, count(*) AS n_rows FROM k GROUP BY 1")
def counts_of_families(spark, sf_dir):
    """Features of each family that the dataset has, and their rows."""
    return whole_dataset(spark, sf_dir).groupBy("signal_family").agg(F.countDistinct("indicator_name").alias("n_features"), F.count(F.lit(1)).alias("n_rows"))


@query("regression_dataset", f"{_TARGETS.replace(O.features_sql(_KEYS), O.features_sql([*_KEYS, 'price_distance', 'midpoint_indicator'])).replace(_CARRY, _CARRY + ', price_distance_sma_20, midpoint_14')} SELECT asset, date, indicator_name, CASE WHEN rule = 'bollinger' THEN 'band_channel_level' ELSE rule END AS signal_family, horizon, signal_direction, signal_active, round(signal_strength, 5) + 0.0 AS signal_strength, round(signal_signed_value, 5) + 0.0 AS signal_signed_value, target, round(price_distance_sma_20, 5) + 0.0 AS price_distance_sma_20, round(midpoint_14, 5) + 0.0 AS midpoint_14 FROM tgt WHERE signal_active = 1 AND target IS NOT NULL")
def regression(spark, sf_dir):
    return rounded(dataset(spark, sf_dir), 5)


@query("dataset_appended", ORACLE_SQL["regression_dataset"])
def dataset_appended(spark, sf_dir):
    """The regression dataset of a folder that was made of the bars before a date, two thirds into the calendar, and brought up to date by two appends."""
    bars, path = event_panel(spark, sf_dir), place_for(spark, "dataset")
    recipe = Recipe(keys=(*_KEYS, "price_distance", "midpoint_indicator"), columns=(*sorted(chosen(RULES)), "bb_lower_20_2", "bb_upper_20_2", "price_distance_sma_20", "midpoint_14"), horizons=HORIZONS)
    low, high = (F.unix_micros(F.col(x).cast("timestamp")) for x in ("low", "high"))
    ends = bars.agg(F.min("date").alias("low"), F.max("date").alias("high")).select(*[F.timestamp_micros((low + (high - low) * k / 6).cast("long")).cast(bars.schema["date"].dataType) for k in (4, 5)]).first()
    first, second = (F.lit(x) for x in ends)
    create(bars.where(F.col("date") < first), path, recipe)
    for later in (bars.where((F.col("date") >= first) & (F.col("date") < second)), bars.where(F.col("date") >= second)):
        append(later, path, recipe)
    return rounded(read_dataset(spark, path).select("date", "asset", "indicator_name", "signal_family", "horizon", "signal_direction", "signal_active", "signal_strength", "signal_signed_value", "target", "price_distance_sma_20", "midpoint_14"), 5)


@query("regression_summary", f"{_TARGETS}, k AS (SELECT * FROM tgt WHERE signal_active = 1 AND target IS NOT NULL) SELECT count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(DISTINCT asset) AS n_assets, count(DISTINCT indicator_name) AS n_indicators, count(DISTINCT horizon) AS n_horizons, count(*) AS n_active, 0::BIGINT AS n_missing_target, round(avg(target), 6) + 0.0 AS target_rate, 0::BIGINT AS n_duplicate_keys FROM k")
def regression_summary(spark, sf_dir):
    return rounded(dataset_summary(dataset(spark, sf_dir)))


@query("duplicate_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_check(spark, sf_dir):
    return duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


# time splits: one row an asset, day and horizon

LABELLED = f"WITH {O.order_bars()}, x AS (SELECT date, asset, h.horizon, h.steps, 'i' || (CAST(asset AS INTEGER) % 3) AS indicator_name, CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM bars, (VALUES ('1d', 1), ('4d', 4), ('24d', 24)) h(horizon, steps))"


def labelled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = order_panel(spark, sf_dir)
    name = F.concat(F.lit("i"), (F.col("asset").cast("int") % 3).cast("string"))
    return x.select("date", "asset", F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon"), name.alias("indicator_name"), F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0).alias("target"))


def _purged(where: str, source: str = "x") -> str:
    return f"(SELECT b.* EXCLUDE (steps) FROM (SELECT *, (SELECT count(DISTINCT date) FROM {source} y WHERE {where.replace('date', 'y.date')}) AS n FROM {source} WHERE {where}) b JOIN (SELECT date AS cal, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM {source} WHERE {where})) ON cal = b.date WHERE pos + b.steps <= n - 1)"


def span(a: str, b: str) -> str:
    return f"date BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'"


@query("calendar", f"{LABELLED} SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT date FROM x)")
def dates(spark, sf_dir):
    return calendar(labelled_days(spark, sf_dir))


@query("horizon_purge", f"{LABELLED} SELECT date, asset, horizon FROM {_purged(span('1996-01-01', '1997-12-31'))}")
def horizon_purge(spark, sf_dir):
    return purge(block(labelled_days(spark, sf_dir), "1996-01-01", "1997-12-31"), HORIZONS).select("date", "asset", "horizon")


SPLIT = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2000-12-31")}
_SPLIT = " UNION ALL ".join([f"SELECT date, asset, horizon, indicator_name, target, '{k}' AS split FROM {_purged(span(*SPLIT[k]))}" for k in ("train", "val")] + [f"SELECT date, asset, horizon, indicator_name, target, 'test' FROM x WHERE {span(*SPLIT['test'])}"])


@query("fixed_split", f"{LABELLED} SELECT date, asset, horizon, split FROM ({_SPLIT})")
def fixed(spark, sf_dir):
    return fixed_split(labelled_days(spark, sf_dir), SPLIT, HORIZONS).select("date", "asset", "horizon", "split")


@query("split_summary", f"{LABELLED}, sp AS ({_SPLIT}) SELECT split, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_dates, count(DISTINCT asset) AS n_assets, count(DISTINCT indicator_name) AS n_indicators, round(avg(target), 6) + 0.0 AS target_rate, round(avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS positive_rate, (SELECT string_agg(horizon || '=' || n, ',' ORDER BY horizon) FROM (SELECT split AS s2, horizon, count(*) AS n FROM sp GROUP BY 1, 2) WHERE s2 = sp.split) AS horizon_counts FROM sp GROUP BY split")
def summary(spark, sf_dir):
    out = split_summary(fixed_split(labelled_days(spark, sf_dir), SPLIT, HORIZONS))
    pairs = F.transform(F.map_entries("horizon_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rounded(out.withColumn("horizon_counts", F.array_join(F.array_sort(pairs), ",")))


@query("temporal_prepared", f"{LABELLED} SELECT date, asset, horizon, indicator_name FROM x")
def ready(spark, sf_dir):
    return prepared(labelled_days(spark, sf_dir)).select("date", "asset", "horizon", "indicator_name")


FOLDS = (("1997-12-31", "1998-01-01", "1998-06-30"), ("1998-06-30", "1998-07-01", "1998-12-31"))
_EXPANDING = " UNION ALL ".join(f"SELECT date, asset, horizon, {i} AS fold_id, '{k}' AS block FROM {_purged(span(a, b))}" for i, (te, vs, ve) in enumerate(FOLDS) for k, a, b in (("train", "1995-01-01", te), ("val", vs, ve)))


@query("expanding_folds", f"{LABELLED} {_EXPANDING}")
def expanding(spark, sf_dir):
    return expanding_folds(labelled_days(spark, sf_dir), FOLDS, "1995-01-01", HORIZONS).select("date", "asset", "horizon", "fold_id", "block")


ROLL = Rolling(365, 300, 5)
_ROLL = f"""{LABELLED}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM x)),
f AS (SELECT k AS fold_id, 365 + 300 * k AS e FROM (SELECT unnest(range(0, 40)) AS k)), p AS (SELECT x.*, pos, fold_id, e, CASE WHEN pos >= e - 365 AND pos < e THEN CASE WHEN pos + steps < e THEN 'train' ELSE 'purged' END WHEN pos >= e + 5 AND pos < e + 305 THEN 'test' END AS block
FROM x JOIN cal USING (date), f WHERE e + 5 < n)"""


@query("rolling_folds", f"{_ROLL} SELECT date, asset, horizon, CAST(fold_id AS INTEGER) AS fold_id, block FROM p WHERE block IS NOT NULL")
def rolling(spark, sf_dir):
    return ROLL.assign(labelled_days(spark, sf_dir), HORIZONS).select("date", "asset", "horizon", "fold_id", "block")


@query("fold_summaries", f"{_ROLL} SELECT CAST(fold_id AS INTEGER) AS fold_id, min(date) FILTER (WHERE block <> 'test') AS train_start, max(date) FILTER (WHERE block <> 'test') AS train_end, min(date) FILTER (WHERE block = 'test') AS test_start, max(date) FILTER (WHERE block = 'test') AS test_end, count(*) FILTER (WHERE block <> 'test') AS n_train_rows_raw, count(*) FILTER (WHERE block = 'train') AS n_train_rows_after_purge, count(*) FILTER (WHERE block = 'purged') AS n_train_rows_purged, count(*) FILTER (WHERE block = 'test') AS n_test_rows FROM p WHERE block IS NOT NULL GROUP BY fold_id")
def folds(spark, sf_dir):
    return ROLL.summary(ROLL.assign(labelled_days(spark, sf_dir), HORIZONS))


# metrics of made-up scores, with ties, nulls and missing targets

SCORED = "WITH s AS (SELECT event_id, date_trunc('day', ts) AS date, event_type AS asset, CASE WHEN user_id % 2 = 0 THEN '1d' ELSE '4d' END AS horizon, 'i' || event_id AS indicator_name, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id * 31 % 7 < 3 THEN 1.0 ELSE 0.0 END AS target, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id * 7919 % 200) / 200.0::DOUBLE END AS pred_proba_success FROM events)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    return e.select(
        "event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), F.col("event_type").alias("asset"), F.when(F.col("user_id") % 2 == 0, "1d").otherwise("4d").alias("horizon"), F.concat(F.lit("i"), i.cast("string")).alias("indicator_name"),
        F.when(i % 11 == 0, None).when(i * 31 % 7 < 3, 1.0).otherwise(0.0).alias("target"), F.when(i % 13 != 0, (i * 7919 % 200) / 200.0).alias("pred_proba_success"),
    )


METRICS = ["target_rate", "accuracy", "f1", "roc_auc", "log_loss", "brier_score"]
_Q = "least(greatest(p, 1e-12), 1 - 1e-12)"


@query("classification_metrics", f"""{SCORED}, v AS (SELECT horizon, target AS y, pred_proba_success AS p FROM s WHERE target IS NOT NULL AND pred_proba_success IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY horizon ORDER BY p) + (count(*) OVER (PARTITION BY horizon, p) - 1) / 2.0 AS rk FROM v)
SELECT horizon, n_obs, {O.rounded(METRICS)} FROM (SELECT horizon, count(*) AS n_obs, avg(y) AS target_rate, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
2 * count(*) FILTER (WHERE y = 1 AND p >= 0.5) / CAST(2 * count(*) FILTER (WHERE y = 1 AND p >= 0.5) + count(*) FILTER (WHERE y = 0 AND p >= 0.5) + count(*) FILTER (WHERE y = 1 AND p < 0.5) AS DOUBLE) AS f1,
(sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE)) AS roc_auc, -avg(y * ln({_Q}) + (1 - y) * ln(1 - {_Q})) AS log_loss, avg((p - y) * (p - y)) AS brier_score FROM r GROUP BY horizon)""")
def metrics(spark, sf_dir):
    return rounded(M.classification_metrics(scored(spark, sf_dir), ["horizon"]))


@query("prediction_ranks", f"""{SCORED} SELECT event_id, CASE WHEN pred_proba_success IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY date, asset, horizon ORDER BY pred_proba_success DESC NULLS LAST, indicator_name) AS DOUBLE) END AS rank_pred_proba,
CASE WHEN pred_proba_success IS NOT NULL THEN round((rank() OVER (PARTITION BY date, asset, horizon ORDER BY pred_proba_success NULLS LAST) + (count(*) OVER (PARTITION BY date, asset, horizon, pred_proba_success) - 1) / 2.0) / count(pred_proba_success) OVER (PARTITION BY date, asset, horizon), 6) + 0.0 END AS rank_pct_pred_proba FROM s""")
def ranks(spark, sf_dir):
    return rounded(M.add_ranks(scored(spark, sf_dir), ["date", "asset", "horizon"]).select("event_id", "rank_pred_proba", "rank_pct_pred_proba"))


_TOP = f"""{SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY date, asset, horizon ORDER BY pred_proba_success DESC, indicator_name) AS r FROM s WHERE target IS NOT NULL AND pred_proba_success IS NOT NULL),
d AS (SELECT date, asset, horizon, count(*) AS group_size, count(target) AS valid_target_count, count(*) FILTER (WHERE r <= 3) AS top_k_count, count(target) FILTER (WHERE r <= 3) AS top_k_valid_target_count, avg(target) AS base_hit_rate_group, avg(target) FILTER (WHERE r <= 3) AS top_k_hit_rate_group, avg(pred_proba_success) AS mean_pred_proba_group, avg(pred_proba_success) FILTER (WHERE r <= 3) AS top_k_mean_pred_proba_group,
avg(target) FILTER (WHERE r <= 3) / nullif(avg(target), 0) AS lift_group FROM k GROUP BY 1, 2, 3)"""
_TOPD = ["base_hit_rate_group", "top_k_hit_rate_group", "mean_pred_proba_group", "top_k_mean_pred_proba_group", "lift_group"]


@query("topk_detail", f"{_TOP} SELECT date, asset, horizon, group_size, valid_target_count, top_k_count, top_k_valid_target_count, {O.rounded(_TOPD)} FROM d")
def topk_detail(spark, sf_dir):
    return rounded(M.top_k_detail(scored(spark, sf_dir), ["date", "asset", "horizon"]))


@query("topk_summary", f"{_TOP} SELECT count(*) AS n_groups, round(avg(base_hit_rate_group), 6) + 0.0 AS mean_base_hit_rate, round(avg(top_k_hit_rate_group), 6) + 0.0 AS mean_top_k_hit_rate, round(avg(top_k_hit_rate_group) / avg(base_hit_rate_group), 6) + 0.0 AS lift_of_means, round(avg(top_k_hit_rate_group) - avg(base_hit_rate_group), 6) + 0.0 AS gap, round(avg(lift_group), 6) + 0.0 AS mean_lift, count(*) FILTER (WHERE group_size < 3) AS groups_smaller_than_k, count(*) FILTER (WHERE base_hit_rate_group = 0) AS groups_with_zero_base, 0::BIGINT AS groups_with_missing_target FROM d")
def topk_summary(spark, sf_dir):
    return rounded(M.top_k_summary(M.top_k_detail(scored(spark, sf_dir), ["date", "asset", "horizon"])))


_CELLS = "count(*) FILTER (WHERE t = 0 AND c = 0) AS tn, count(*) FILTER (WHERE t = 0 AND c = 1) AS fp, count(*) FILTER (WHERE t = 1 AND c = 0) AS fn, count(*) FILTER (WHERE t = 1 AND c = 1) AS tp"
_SHARES = ", ".join(f"round(coalesce({n} / CAST(nullif({of}, 0) AS DOUBLE), 0), 6) + 0.0 AS {n}_{k}" for k, side in (("true", {"tn": "tn + fp", "fp": "tn + fp", "fn": "fn + tp", "tp": "fn + tp"}), ("pred", {"tn": "tn + fn", "fn": "tn + fn", "fp": "fp + tp", "tp": "fp + tp"}), ("all", dict.fromkeys(("tn", "fp", "fn", "tp"), "tn + fp + fn + tp"))) for n, of in side.items())


@query("confusion", f"{SCORED}, c AS (SELECT horizon, target AS t, CASE WHEN pred_proba_success >= 0.5 THEN 1 WHEN pred_proba_success < 0.5 THEN 0 END AS c FROM s), g AS (SELECT horizon, {_CELLS} FROM c WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY horizon) SELECT horizon, tn, fp, fn, tp, {_SHARES} FROM g")
def confusion(spark, sf_dir):
    return rounded(M.confusion(M.score_columns(scored(spark, sf_dir)), ["horizon"]))


@query("threshold_sweep", f"{SCORED}, c AS (SELECT CAST(h AS DOUBLE) AS threshold, target AS t, CASE WHEN pred_proba_success >= h THEN 1 ELSE 0 END AS c FROM s, (VALUES (0.3), (0.5), (0.7)) q(h) WHERE target IS NOT NULL AND pred_proba_success IS NOT NULL), g AS (SELECT threshold, {_CELLS} FROM c GROUP BY 1) SELECT threshold, tn, fp, fn, tp, {_SHARES} FROM g")
def sweep(spark, sf_dir):
    return rounded(M.threshold_sweep(scored(spark, sf_dir)))


@query("cross_sectional_scaler", f"{SCORED} SELECT event_id, round(CASE WHEN count(pred_proba_success) OVER g >= 2 AND stddev_samp(pred_proba_success) OVER g >= 1e-12 THEN (pred_proba_success - avg(pred_proba_success) OVER g) / stddev_samp(pred_proba_success) OVER g END, 6) + 0.0 AS p FROM s WINDOW g AS (PARTITION BY date, horizon)")
def scaler(spark, sf_dir):
    x = scored(spark, sf_dir).withColumn("p", F.col("pred_proba_success"))
    return rounded(cross_sectional_scale(x, ["p"]).select("event_id", "p"))


@query("score_columns", f"{SCORED} SELECT event_id, CAST(CASE WHEN pred_proba_success >= 0.5 THEN 1 WHEN pred_proba_success < 0.5 THEN 0 END AS INTEGER) AS pred_class, round(ln(least(greatest(pred_proba_success, 1e-12), 1 - 1e-12) / (1 - least(greatest(pred_proba_success, 1e-12), 1 - 1e-12))), 5) + 0.0 AS pred_log_odds FROM (SELECT * FROM s WHERE pred_proba_success IS NOT NULL)")
def log_odds(spark, sf_dir):
    x = scored(spark, sf_dir).where("pred_proba_success IS NOT NULL")
    return rounded(M.score_columns(x).select("event_id", "pred_class", "pred_log_odds"), 5)


# models, fitted on all primary columns of the catalogue over weekly bars of orders: windows are longer than the longest horizon

WINDOWS, FOREST_WINDOWS = Rolling(104, 26, 5), Rolling(208, 130, 5)


def weekly_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset of weekly bars, written once to the shared folder: fits read it several times."""
    kept = store(bars(order_panel(spark, sf_dir), "7 days"), "weeks")
    out = store(regression_dataset(compute_indicators(kept), horizons=HORIZONS, check=kept), "dataset")
    drop(kept)
    return out


def fold_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored dataset, its rows before a date two thirds into its calendar whose targets are known by then, and those from it on."""
    x = weekly_dataset(spark, sf_dir)
    at = x.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.expr("date_trunc('day', a + (b - a) * 2 / 3)")).first()[0]
    at = F.lit(at).cast("timestamp_ntz")
    return x, purge(x.where(F.col("date") < at), HORIZONS), x.where(F.col("date") >= at)


def single_fit(rows: DataFrame, settings: list[dict]):
    return fit_batched(rows.withColumns({"__lo": F.lit(0), "__hi": F.lit(0)}), settings)


@query("logit_backtest")
def logit(spark, sf_dir):
    data = weekly_dataset(spark, sf_dir)
    out = logit_backtest(data, splitter=WINDOWS, horizons=HORIZONS)["oos"]
    drop(data)
    return out.select("date", "asset", "indicator_name", "horizon", "fold_id", "y_true", "y_pred", "y_proba_pred", "rank_pred_proba", "train_start", "train_end", "test_start", "test_end", "n_train_rows_after_purge")


@query("forest_backtest")
def forest(spark, sf_dir):
    data = weekly_dataset(spark, sf_dir)
    out = forest_backtest(data, splitter=FOREST_WINDOWS, horizons=HORIZONS, trees=40)
    told = store(out["fold_metrics"], "fold-metrics")
    out["release"]()
    drop(data)
    return told


@query("horizon_backtests")
def horizon_backtests(spark, sf_dir):
    """One backtest a horizon; their metrics."""
    data = weekly_dataset(spark, sf_dir)
    runs = by_horizon(data, logit_backtest, HORIZONS, splitter=WINDOWS)
    told = store(horizon_metrics(runs), "horizon-metrics")
    for run in runs.values():
        run["release"]()
    drop(data)
    return told


@query("backtest_topk")
def backtest_topk(spark, sf_dir):
    data = weekly_dataset(spark, sf_dir)
    out = logit_backtest(data, splitter=WINDOWS, horizons=HORIZONS)
    told = store(top_k(out["oos"])[1], "top-k")
    out["release"]()
    drop(data)
    return told


@query("logit_grid")
def logits(spark, sf_dir):
    data, train, validation = fold_rows(spark, sf_dir)
    out = grid_batched(train, validation, {"penalty": ["l2", "l1", "elasticnet"], "C": [0.05, 1.0], "l1_ratio": [0.5]})
    drop(data)
    return out


@query("forest_grid")
def forests(spark, sf_dir):
    data, train, validation = fold_rows(spark, sf_dir)
    out = grid(fit_forest, train, validation, {"depth": [3, 5], "class_weight": [None, "balanced"]}, {"trees": 20})
    drop(data)
    return out


@query("logit_coefficients")
def coefficients(spark, sf_dir):
    data, train, _ = fold_rows(spark, sf_dir)
    found = single_fit(train, [{"penalty": "l1", "C": 0.1}]).coefficients()
    drop(data)
    return spark.createDataFrame([x[2:] for x in found], "feature string, coefficient double")


@query("logit_sparsity")
def sparse(spark, sf_dir):
    data, train, _ = fold_rows(spark, sf_dir)
    settings = [{"penalty": p, "C": 0.05} for p in ("l1", "l2")]
    found = single_fit(train, settings).coefficients()
    drop(data)
    counts = [[b for _, i, f, b in found if i == k and f != "intercept"] for k in range(2)]
    return spark.createDataFrame([(s["penalty"], len(x), sum(b != 0 for b in x), 1 - sum(b != 0 for b in x) / len(x)) for s, x in zip(settings, counts)], "penalty string, n_features int, n_nonzero int, share_zero double")


@query("forest_importances")
def importances(spark, sf_dir):
    data, train, _ = fold_rows(spark, sf_dir)
    model = fit_forest(train, trees=40, depth=4)
    drop(data)
    return spark.createDataFrame(model.weights(), "feature string, importance double")


# what a solved logit's score equations say: the probabilities and the penalty's slope give each feature the sum that it has over the hits

_SCORE_NUMBERS = ("signal_direction", "signal_strength", "signal_signed_value", "price_distance_sma_20", "midpoint_14")
_SCORE_ROWS = ORACLE_SQL["regression_dataset"].rpartition(" SELECT asset, date, indicator_name")[0]
_NUMBER_SQL = "SELECT '{c}' AS feature, sum(target * (v - m) / s) AS score FROM (SELECT target, coalesce({c}, med) AS v, avg(coalesce({c}, med)) OVER () AS m, coalesce(nullif(stddev_pop(coalesce({c}, med)) OVER (), 0), 1) AS s FROM k, (SELECT median({c}) AS med FROM k))"
_LABEL_SQL = "SELECT '{c}=' || {c}, sum(target) FROM k GROUP BY {c}"


@query("logit_scores", f"{_SCORE_ROWS}, k AS MATERIALIZED (SELECT *, CASE WHEN rule = 'bollinger' THEN 'band_channel_level' ELSE rule END AS signal_family FROM tgt WHERE signal_active = 1 AND target IS NOT NULL), sc AS ({' UNION ALL '.join([_NUMBER_SQL.format(c=c) for c in _SCORE_NUMBERS] + [_LABEL_SQL.format(c=c) for c in ('indicator_name', 'signal_family', 'horizon')])} UNION ALL SELECT 'intercept', sum(target) FROM k) SELECT penalty, feature, round(score, 3) + 0.0 AS score FROM sc, (VALUES ('l1'), ('l2'), ('elasticnet')) p(penalty)")
def logit_scores(spark, sf_dir):
    """Certificates of three logits over the dataset: each feature's sum over the rows with target 1, as the fitted probabilities tell it."""
    settings = [{"penalty": p, "C": 0.5} for p in ("l1", "l2", "elasticnet")]
    found = single_fit(dataset(spark, sf_dir), settings).score_rows()
    return rounded(spark.createDataFrame([(settings[i]["penalty"], f, x) for _, i, f, x in found], "penalty string, feature string, score double"), 3)


TICK_MEANS = {"ema_20": ("ema", "close", 20), "wilder_14": ("wilder", "close", 14), "macd_line_12_26": ("difference", "fast", "slow"), "macd_signal_9": ("ema", "macd_line_12_26", 9), "rsi_14": ("rsi", 14), "rsx_14": ("rsx", 14, 5)}
_TICKS = "bars AS (SELECT event_type AS asset, ts AS date, value AS close FROM events)"
_TICK_STAGES = [
    {"ema_20": O.ema("close", 20), "wilder_14": O.wilder("close", 14), "fast": O.ema("close", 12), "slow": O.ema("close", 26), "smooth": O.ema("close", 5)}, {"macd_line_12_26": "fast - slow"}, {"macd_signal_9": O.ema("macd_line_12_26", 9)},
    *O.rsi_stages("close"), {"rsi_14": "rsi_value"}, {"d2": f"smooth - {O.lag('smooth')}"}, {"g2": "CASE WHEN d2 IS NOT NULL THEN greatest(d2, 0) END", "l2": "CASE WHEN d2 IS NOT NULL THEN greatest(-d2, 0) END"}, {"ag2": O.wilder("g2", 14), "al2": O.wilder("l2", 14)},
    {"s2": "CASE WHEN ag2 IS NULL OR al2 IS NULL THEN NULL WHEN ag2 = 0 AND al2 = 0 THEN 50 WHEN al2 = 0 THEN 100 ELSE 100 * ag2 / (ag2 + al2) END"}, {"rsx_14": O.ema("s2", 5)},
]
_TICK_SQL = O.staged(_TICKS, _TICK_STAGES)


@query("tick_means", f"WITH {_TICK_SQL[0]} SELECT asset, date, {O.rounded(list(TICK_MEANS))} FROM {_TICK_SQL[1]}")
def tick_means(spark, sf_dir):
    """Recursive means over every tick of each event type, a series cut into slices that are worked on apart."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("asset"), F.col("ts").alias("date"), F.col("value").cast("double").alias("close"))
    wanted = {"fast": ("ema", "close", 12), "slow": ("ema", "close", 26), **TICK_MEANS}
    return rounded(add_segmented(ticks, Panel(), wanted).select("asset", "date", *TICK_MEANS))


SLIDING = {"aroon_up": ("argmax", "close", 50), "aroon_down": ("argmin", "close", 50), "rank_100": ("percent_rank", "close", 100), "mad_50": ("mean_deviation", "close", 50), "entropy_100": ("entropy", "close", 100, 10)}
_SLID = f"""ticks AS (SELECT event_type AS asset, ts AS date, value AS close FROM events),
v AS (SELECT *, {O.glist('close', 50)} AS v, {O.glist('close', 100)} AS u FROM ticks), m AS (SELECT *, list_avg(v) AS m, list_min(u) AS lo, list_max(u) AS hi FROM v),
b AS (SELECT *, list_transform(u, lambda x: least(floor((x - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END) / CASE WHEN lo = hi THEN 1 ELSE hi - lo END * 10), 9)) AS k FROM m)"""
_SLID_BINS = " + ".join(f"(CASE WHEN len(list_filter(k, lambda x: x = {i})) > 0 THEN -(len(list_filter(k, lambda x: x = {i})) / 100.0) * ln(len(list_filter(k, lambda x: x = {i})) / 100.0) ELSE 0 END)" for i in range(10))


@query("sliding_statistics", f"""WITH {_SLID} SELECT asset, date, list_position(v, list_max(v)) - 1.0 AS aroon_up, list_position(v, list_min(v)) - 1.0 AS aroon_down,
CASE WHEN u IS NOT NULL THEN round(len(list_filter(u, lambda x: x <= close)) / 100.0, 6) END AS rank_100, round(list_sum(list_transform(v, lambda x: abs(x - m))) / 50, 6) AS mad_50, round(CASE WHEN u IS NOT NULL THEN ({_SLID_BINS}) / ln(10) END, 6) + 0.0 AS entropy_100 FROM b""")
def sliding_statistics(spark, sf_dir):
    """Order statistics over the last 50 and 100 ticks of each event type, in blocks of rows."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("asset"), F.col("ts").alias("date"), F.col("value").cast("double").alias("close"))
    return rounded(add_sliding(ticks, SLIDING).select("asset", "date", *SLIDING))


@query("stream_bars", f"WITH {O.event_bars(4)} SELECT asset, date, {O.rounded(['open', 'high', 'low', 'close', 'volume'])} FROM bars")
def streamed(spark, sf_dir):
    """The 4-hour bars again, from a stream run over what there is."""
    out = drain(stream_bars(event_ticks(spark, sf_dir), "4 hours"), place_for(spark, "bars"))
    return rounded(out.withColumn("date", F.col("date").cast("timestamp_ntz")))


_STREAM_SQL = O.staged(_TICKS, [{"ema_20": O.ema("close", 20), "wilder_14": O.wilder("close", 14)}])


@query("stream_means", f"WITH {_STREAM_SQL[0]} SELECT asset, date, {O.rounded(['ema_20', 'wilder_14'])} FROM {_STREAM_SQL[1]}")
def streamed_means(spark, sf_dir):
    """Two means of every tick, from a stream whose batches carry their state on."""
    out = run_to_end(stream_means(event_ticks(spark, sf_dir), {"ema_20": ("ema", 20), "wilder_14": ("wilder", 14)}), place_for(spark, "means"))
    return rounded(out.select("asset", F.col("date").cast("timestamp_ntz").alias("date"), "ema_20", "wilder_14"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each asset and bar: did a signal's direction match the next cross-sectionally scaled move?"""
    return report(spark, sf_dir)


