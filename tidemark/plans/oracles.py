"""SQL of the registered queries, for DuckDB; written from the formulas, apart from the engine's expressions."""

from __future__ import annotations

import math

from ..operators.indicators import catalogue

ALL = "OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def event_bars(hours: int) -> str:
    return f"""bars AS (SELECT event_type AS asset, time_bucket(INTERVAL '{hours} hours', ts) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0.0 END) AS buy_volume, sum(CASE WHEN user_id % 2 = 0 THEN 0.0 ELSE value END) AS sell_volume, sum(value) AS volume, avg(value) + 10 AS vix FROM events GROUP BY 1, 2)"""


def order_bars(assets: int = 10) -> str:
    at, price = "row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)", "l_extendedprice / nullif(l_quantity, 0)"
    return f"""bars AS (SELECT CAST(l_suppkey % {assets} AS VARCHAR) AS asset, date_trunc('day', l_shipdate) AS date, arg_min({price}, {at}) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, {at}) AS close,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS buy_volume, sum(CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity END) AS sell_volume, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def w(n: int) -> str:
    return f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, e: str) -> str:
    return f"(CASE WHEN count({x}) {w(n)} = {n} THEN {e} END)"


def agg(f: str):
    return lambda x, n: full(x, n, f"{f}({x}) {w(n)}")


sma, rsum, rmin, rmax, std0, glist = (agg(f) for f in ("avg", "sum", "min", "max", "stddev_pop", "list"))


def lag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) OVER (PARTITION BY asset ORDER BY date))"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(CAST(({b}) AS DOUBLE), 0))"


def decay(x: str, alpha: str, least: int) -> str:
    return f"(CASE WHEN count({x}) {ALL} >= {least} THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) {ALL}, lambda y, v: y * (1 - {alpha}) + v * {alpha}) END)"


def ema(x: str, n: int) -> str:
    return decay(x, f"(2.0 / {n + 1})", n)


def wilder(x: str, n: int) -> str:
    return decay(x, f"(1.0 / {n})", n)


def roc(k: int, x: str = "close") -> str:
    return f"(100 * ({div(x, lag(x, k))} - 1))"


def weighted(x: str, weights: list[float]) -> str:
    n, total = len(weights), sum(weights)
    return "((" + " + ".join(f"{float(g)!r} * {lag(x, n - 1 - i) if i < n - 1 else x}" for i, g in enumerate(weights)) + f") / {total!r})"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
HLC = "((high + low + close) / 3)"
UP, DOWN = "(CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END)", "(CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END)"
RN = {"rn": "row_number() OVER (PARTITION BY asset ORDER BY date)"}


def slope(n: int) -> str:
    return full("close", n, f"regr_slope(close, rn) {w(n)}")


def time_corr(n: int) -> str:
    return full("close", n, f"CASE WHEN max(close) {w(n)} > min(close) {w(n)} THEN covar_pop(close, rn) {w(n)} / nullif(stddev_pop(close) {w(n)} * stddev_pop(rn) {w(n)}, 0) END")


def mad(values: str, mean: str) -> str:
    return f"list_avg(list_transform({values}, lambda v: abs(v - {mean})))"


def sign_entropy(x: str, n: int) -> str:
    def term(c):
        share = f"(sum(CASE WHEN {x} {c} 0 THEN 1 ELSE 0 END) {w(n)} / {n}.0)"
        return f"CASE WHEN {share} > 0 THEN -{share} * ln({share}) ELSE 0 END"

    return full(x, n, f"({term('<')} + {term('=')} + {term('>')}) / {math.log(3)!r}")


def gauss(n: int, offset: float, sigma: float) -> list[float]:
    return [math.exp(-((i - offset * (n - 1)) ** 2) / (2 * (n / sigma) ** 2)) for i in range(n)]


def fibs(n: int) -> list[float]:
    a = [1.0, 1.0]
    for _ in range(n - 2):
        a.append(a[-1] + a[-2])
    return a


MFV = div("(close - low) - (high - close)", "high - low") + " * volume"


def rsi_stages(p: str) -> list[dict]:
    return [{"d": f"{p} - {lag(p)}"}, {"g": UP, "l": DOWN}, {"ag": wilder("g", 14), "al": wilder("l", 14)}, {"rsi_value": "CASE WHEN ag IS NULL OR al IS NULL THEN NULL WHEN ag = 0 AND al = 0 THEN 50 WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END"}]


def crossing(prefix: str, x: str) -> list[dict]:
    a, b = ("macd_line_12_26", "fast - slow") if prefix == "macd" else (f"{prefix}_12_26", f"100 * {div('fast - slow', 'slow')}")
    return [{"fast": ema(x, 12), "slow": ema(x, 26)}, {a: b}, {f"{prefix}_signal_12_26_9": ema(a, 9)}, {f"{prefix}_hist_12_26_9": f"{a} - {prefix}_signal_12_26_9"}]


#: Indicator to stages; the last names are the indicator's columns.
INDICATORS: dict[str, list[dict[str, str]]] = {
    "bollinger_bands": [{"bb_middle_20_2": sma("close", 20), "s": std0("close", 20)}, {"bb_upper_20_2": "bb_middle_20_2 + 2 * s", "bb_lower_20_2": "bb_middle_20_2 - 2 * s"}, {"bb_bandwidth_20_2": div("bb_upper_20_2 - bb_lower_20_2", "bb_middle_20_2"), "bb_percent_b_20_2": div("close - bb_lower_20_2", "bb_upper_20_2 - bb_lower_20_2")}],
    "donchian_channel": [{"donchian_upper_20": rmax("high", 20), "donchian_lower_20": rmin("low", 20)}, {"donchian_middle_20": "(donchian_upper_20 + donchian_lower_20) / 2"}, {"donchian_width_20": div("donchian_upper_20 - donchian_lower_20", "donchian_middle_20")}],
    "keltner_channel": [{"tr": TR}, {"keltner_middle_20": ema("close", 20), "a": wilder("tr", 10)}, {"keltner_upper_20_10_2": "keltner_middle_20 + 2 * a", "keltner_lower_20_10_2": "keltner_middle_20 - 2 * a"}, {"keltner_width_20_10_2": div("4 * a", "keltner_middle_20")}],
    "acceleration_bands": [{"f": f"4 * {div('high - low', 'high + low')}"}, {"u": "high * (1 + f)", "l": "low * (1 - f)"}, {"accbands_middle_20": sma("close", 20), "accbands_upper_20": sma("u", 20), "accbands_lower_20": sma("l", 20)}, {"accbands_width_20": div("accbands_upper_20 - accbands_lower_20", "accbands_middle_20"), "accbands_percent_b_20": div("close - accbands_lower_20", "accbands_upper_20 - accbands_lower_20")}],
    "absolute_price_oscillator": [{"apo_12_26": f"{ema('close', 12)} - {ema('close', 26)}"}],
    "accumulation_distribution_oscillator": [{"m": MFV}, {"ad": f"CASE WHEN m IS NOT NULL THEN sum(m) {ALL} END"}, {"ado_3_10": f"{ema('ad', 3)} - {ema('ad', 10)}"}],
    "awesome_oscillator": [{"mp": "(high + low) / 2"}, {"awesome_oscillator_5_34": f"{sma('mp', 5)} - {sma('mp', 34)}"}],
    "balance_of_power": [{"bop": div("close - open", "high - low")}],
    "bias_indicator": [{"m": sma("close", 20)}, {"bias_20": div("close - m", "m")}],
    "chande_forecast_oscillator": [RN, {"cfo_fitted_14": f"{sma('close', 14)} + {slope(14)} * 6.5"}, {"cfo_14": f"100 * {div('close - cfo_fitted_14', 'cfo_fitted_14')}"}],
    "chande_momentum_oscillator": [{"d": f"close - {lag('close')}"}, {"g": UP, "l": DOWN}, {"a": rsum("g", 14), "b": rsum("l", 14)}, {"cmo_14": f"100 * {div('a - b', 'a + b')}"}],
    "coppock_curve": [{"r": f"{roc(14)} + {roc(11)}"}, {"coppock_14_11_10": weighted("r", list(range(1, 11)))}],
    "detrended_price_oscillator": [{"dpo_20": f"{lag('close', 11)} - {sma('close', 20)}"}],
    "ease_of_movement": [{"mp": "(high + low) / 2", "box": div("volume", "high - low")}, {"eom_14": div(f"mp - {lag('mp')}", "box")}, {"eom_sma_14": sma("eom_14", 14)}],
    "elders_force_index": [{"efi_raw": f"(close - {lag('close')}) * volume"}, {"efi_ema_13": ema("efi_raw", 13)}],
    "know_sure_thing": [{f"r{k}": roc(k) for k in (10, 15, 20, 30)}, {"kst_10_15_20_30": f"{sma('r10', 10)} + 2 * {sma('r15', 10)} + 3 * {sma('r20', 10)} + 4 * {sma('r30', 15)}"}, {"kst_signal_10_15_20_30_9": sma("kst_10_15_20_30", 9)}],
    "macd": crossing("macd", "close"),
    "percentage_price_oscillator": crossing("ppo", "close"),
    "percentage_volume_oscillator": crossing("pvo", "volume"),
    "momentum_indicator": [{"momentum_10": f"close - {lag('close', 10)}"}],
    "qstick_indicator": [{"q": "close - open"}, {"qstick_10": sma("q", 10)}],
    "rate_of_change": [{"roc_10": roc(10)}],
    "relative_vigor_index": [{"a": "close - open", "b": "high - low"}, {"rvi_10": div(sma("a", 10), sma("b", 10))}, {"rvi_signal_10_4": sma("rvi_10", 4)}],
    "high_low_close_average": [{"hlc_average": HLC}],
    "median_price": [{"median_price": "(high + low) / 2"}],
    "open_high_low_close_average": [{"ohlc_average": "(open + high + low + close) / 4"}],
    "atr": [{"tr": TR}, {"atr_14": wilder("tr", 14)}],
    "normalized_atr": [{"tr": TR}, {"a": wilder("tr", 14)}, {"natr_14": div("a", "close")}],
    "adx": [
        {"tr": TR, "u": f"high - {lag('high')}", "v": f"{lag('low')} - low"},
        {"pdm": "CASE WHEN u > v AND u > 0 THEN u ELSE 0.0 END", "mdm": "CASE WHEN v > u AND v > 0 THEN v ELSE 0.0 END"},
        {"a": wilder("tr", 14), "p": wilder("pdm", 14), "m": wilder("mdm", 14)},
        {"plus_di_14": f"100 * {div('p', 'a')}", "minus_di_14": f"100 * {div('m', 'a')}"},
        {"dx_14": f"100 * {div('abs(plus_di_14 - minus_di_14)', 'plus_di_14 + minus_di_14')}"},
        {"adx_14": wilder("dx_14", 14)},
    ],
    "choppiness_index": [{"tr": TR}, {"q": div(rsum("tr", 14), f"{rmax('high', 14)} - {rmin('low', 14)}")}, {"choppiness_14": f"100 * log10(nullif(q, 0)) / {math.log10(14)!r}"}],
    "entropy_indicator": [{"r": f"CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN {lag('close')} > 0 THEN {lag('close')} END) END"}, {"entropy_20": sign_entropy("r", 20)}],
    "kurtosis": [{"r": div("close", lag("close")) + " - 1"}, {"kurtosis_20": full("r", 20, f"CASE WHEN max(r) {w(20)} = min(r) {w(20)} THEN -3.0 ELSE kurtosis(r) {w(20)} END")}],
    "mass_index": [{"x": "high - low"}, {"e": ema("x", 9)}, {"e2": ema("e", 9)}, {"q": div("e", "e2")}, {"mass_index_9_25": rsum("q", 25)}],
    "mean_absolute_deviation": [{"v": glist("close", 20), "m": sma("close", 20)}, {"mad_close_20": mad("v", "m")}],
    "midpoint_indicator": [{"midpoint_14": f"({rmax('close', 14)} + {rmin('close', 14)}) / 2"}],
    "midprice_indicator": [{"midprice_14": f"({rmax('high', 14)} + {rmin('low', 14)}) / 2"}],
    "price_distance": [{"price_distance_ref_sma_20": sma("close", 20)}, {"price_distance_sma_20": div("close - price_distance_ref_sma_20", "price_distance_ref_sma_20")}],
    "quantile_indicator": [{"v": glist("close", 20)}, {"quantile_rank_20": "len(list_filter(v, lambda x: x <= close)) / 20.0"}],
    "vix": [{"vix_roc_10": roc(10, "vix"), "vix_sma_20": sma("vix", 20), "s": std0("vix", 20)}, {"vix_zscore_20": div("vix - vix_sma_20", "s")}],
    "center_of_gravity": [{"cog_10": full("close", 10, "-" + div("(" + " + ".join(["close"] + [f"{i} * {lag('close', i - 1)}" for i in range(2, 11)]) + ")", f"sum(close) {w(10)}"))}],
    "commodity_channel_index": [{"tp": HLC}, {"v": glist("tp", 20), "m": sma("tp", 20)}, {"cci_20": div("tp - m", f"0.015 * {mad('v', 'm')}")}],
    "emotion_index_willingness_index": [{"tr": TR, "d": f"abs(close - {lag('close')})"}, {"a": wilder("tr", 14)}, {"q": div("d", "a")}, {"emotion_index_14": f"100 * {sma('q', 14)}", "willingness_index_14": f"100 * {div('close - ' + rmin('low', 14), rmax('high', 14) + ' - ' + rmin('low', 14))}"}],
    "money_flow_index": [{"tp": HLC}, {"m": f"tp - {lag('tp')}", "f": "tp * volume"}, {"a": "CASE WHEN m > 0 THEN f ELSE 0.0 END", "b": "CASE WHEN m < 0 THEN f ELSE 0.0 END"}, {"mfi_14": f"100 - 100 / (1 + {div(rsum('a', 14), rsum('b', 14))})"}],
    "pretty_good_oscillator": [{"tr": TR}, {"pgo_14": div(f"close - {sma('close', 14)}", wilder("tr", 14))}],
    "rsi": [*rsi_stages("close"), {"rsi_14": "rsi_value"}],
    "rsx": [{"smooth": ema("close", 5)}, *rsi_stages("smooth"), {"rsx_14": ema("rsi_value", 5)}],
    "stochastic_oscillator": [{"stochastic_k_14_3": f"100 * {div('close - ' + rmin('low', 14), rmax('high', 14) + ' - ' + rmin('low', 14))}"}, {"stochastic_d_14_3": sma("stochastic_k_14_3", 3)}],
    "moving_averages": [{f"{k}_{n}": (sma if k == "sma" else ema)("close", n) for k in ("sma", "ema") for n in (10, 20, 50)}, {f"{k}_spread_{a}_{b}": div(f"{k}_{a} - {k}_{b}", f"{k}_{b}") for k in ("sma", "ema") for a, b in ((10, 20), (20, 50))}],
    "alma": [{"alma_10_0p85_6": weighted("close", gauss(10, 0.85, 6.0))}],
    "aroon_indicator": [{"h": glist("high", 25), "l": glist("low", 25)}, {"aroon_up_25": "100 * (list_position(h, list_max(h)) - 1) / 25.0", "aroon_down_25": "100 * (list_position(l, list_min(l)) - 1) / 25.0"}, {"aroon_oscillator_25": "aroon_up_25 - aroon_down_25"}],
    "correlation_trend_indicator": [RN, {"cti_20": time_corr(20)}],
    "efficiency_ratio": [{"d": f"abs(close - {lag('close')})"}, {"efficiency_ratio_10": div(f"abs(close - {lag('close', 10)})", rsum("d", 10))}],
    "fibonacci_weighted_moving_average": [{"fib_wma_10": weighted("close", fibs(10))}],
    "ichimoku": [{"ichimoku_tenkan_9": f"({rmax('high', 9)} + {rmin('low', 9)}) / 2", "ichimoku_kijun_26": f"({rmax('high', 26)} + {rmin('low', 26)}) / 2", "ichimoku_span_b_52": f"({rmax('high', 52)} + {rmin('low', 52)}) / 2"}, {"ichimoku_span_a_9_26": "(ichimoku_tenkan_9 + ichimoku_kijun_26) / 2"}, {"ichimoku_cloud_delta_9_26_52": "ichimoku_span_a_9_26 - ichimoku_span_b_52"}],
    "inertia_indicator": [RN, {"s": slope(20), "m": sma("close", 20), "c": time_corr(20)}, {"inertia_20": f"100 * {div('s', 'm')} * c * c", "inertia_fitted_20": "m + s * 9.5"}],
    "linear_decay": [{"linear_decay_10": weighted("close", list(range(1, 11)))}],
    "linear_regression": [RN, {"linreg_slope_20": slope(20), "m": sma("close", 20)}, {"linreg_intercept_20": "m - linreg_slope_20 * 9.5", "linreg_fitted_20": "m + linreg_slope_20 * 9.5"}],
    "accumulation_distribution_line": [{"m": MFV}, {"ad_line": f"CASE WHEN m IS NOT NULL THEN sum(m) {ALL} END"}],
    "chaikin_money_flow": [{"m": MFV}, {"cmf_20": div(rsum("m", 20), rsum("volume", 20))}],
    "elder_ray_index": [{"e": ema("close", 13)}, {"elder_ray_bull_13": "high - e", "elder_ray_bear_13": "low - e"}],
    "on_balance_volume": [{"s": f"coalesce(sign(close - {lag('close')}), 0) * volume"}, {"obv": f"CASE WHEN s IS NOT NULL THEN sum(s) {ALL} END"}],
    "price_volume_trend": [{"s": f"coalesce(volume * {div('close - ' + lag('close'), lag('close'))}, 0)"}, {"pvt": f"sum(s) {ALL}"}],
    "negative_volume_index": [{"g": f"CASE WHEN volume < {lag('volume')} THEN coalesce({div('close', lag('close'))}, 1.0) ELSE 1.0 END"}, {"nvi": f"1000 * product(g) {ALL}"}],
    "positive_volume_index": [{"g": f"CASE WHEN volume > {lag('volume')} THEN coalesce({div('close', lag('close'))}, 1.0) ELSE 1.0 END"}, {"pvi": f"1000 * product(g) {ALL}"}],
    "price_volume_rank": [{"r": div("close", lag("close")) + " - 1"}, {"a": glist("r", 20), "b": glist("volume", 20)}, {"price_volume_rank_20": "(2 * len(list_filter(a, lambda x: x <= r)) / 20.0 - 1) * len(list_filter(b, lambda x: x <= volume)) / 20.0"}],
}

_A1 = math.exp(-1.414 * math.pi / 10)
_B1 = 2 * _A1 * math.cos(1.414 * math.pi / 10)
#: Recursive kernels: (columns of the numbered series, first row, next row); n is the row's number, x the row, p the one before, q the one before that.
SMOOTHER = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS n FROM bars),
walk AS (SELECT asset, n, close AS x, close AS y, CAST(NULL AS DOUBLE) AS y1 FROM numbered WHERE n = 1
  UNION ALL SELECT b.asset, b.n, b.close, CASE WHEN b.n <= 2 THEN b.close ELSE {(1 - _B1 + _A1 * _A1)!r} * (b.close + k.x) / 2 + {_B1!r} * k.y - {(_A1 * _A1)!r} * k.y1 END, k.y FROM walk k JOIN numbered b ON b.asset = k.asset AND b.n = k.n + 1)"""
KAMA = f"""
moves AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS n, abs(close - {lag('close')}) AS d FROM bars),
numbered AS (SELECT *, coalesce({div(f"abs(close - {lag('close', 10)})", rsum('d', 10))}, 0) AS er, avg(close) {w(10)} AS m FROM moves),
walk AS (SELECT asset, n, m AS y FROM numbered WHERE n = 10
  UNION ALL SELECT b.asset, b.n, k.y + pow(b.er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (b.close - k.y) FROM walk k JOIN numbered b ON b.asset = k.asset AND b.n = k.n + 1)"""
PSAR = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS n, lead(close) OVER (PARTITION BY asset ORDER BY date) AS c1 FROM bars),
walk AS (
  SELECT asset, n, CASE WHEN c1 < close THEN high ELSE low END AS stop, CASE WHEN c1 < close THEN -1.0 ELSE 1.0 END AS side, 0.02 AS rate, CASE WHEN c1 < close THEN low ELSE high END AS peak, high AS h1, low AS l1, high AS h2, low AS l2 FROM numbered WHERE n = 1
  UNION ALL SELECT asset, n, CASE WHEN flip THEN peak ELSE near END, CASE WHEN flip THEN -side ELSE side END,
    CASE WHEN flip THEN 0.02 WHEN more THEN least(rate + 0.02, 0.2) ELSE rate END,
    CASE WHEN flip THEN CASE WHEN side > 0 THEN low ELSE high END WHEN more THEN CASE WHEN side > 0 THEN high ELSE low END ELSE peak END, high, low, h1, l1
  FROM (SELECT *, CASE WHEN side > 0 THEN low < near ELSE high > near END AS flip, CASE WHEN side > 0 THEN high > peak ELSE low < peak END AS more
    FROM (SELECT b.asset, b.n, b.high, b.low, k.side, k.rate, k.peak, k.h1, k.l1, CASE WHEN k.side > 0 THEN least(k.stop + k.rate * (k.peak - k.stop), k.l1, k.l2) ELSE greatest(k.stop + k.rate * (k.peak - k.stop), k.h1, k.h2) END AS near
      FROM walk k JOIN numbered b ON b.asset = k.asset AND b.n = k.n + 1)))"""


def rounded(names, digits: int | None = 6) -> str:
    if digits is None:
        return ", ".join(names)
    if digits == 0:  # seven digits, for large running totals
        return ", ".join(f"CAST(CAST({n} AS FLOAT) AS DOUBLE) AS {n}" for n in names)
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in names)


def staged(source: str, stages: list[dict[str, str]], first: str = "bars") -> tuple[str, str]:
    """CTEs, and the name of the last."""
    parts, last = [source], first
    for i, stage in enumerate(stages):
        parts.append(f"t{i} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in stage.items()) + f" FROM {last})")
        last = f"t{i}"
    return ",\n".join(parts), last


#: Running totals and products, too large for six decimals.
LARGE = ("accumulation_distribution_line", "on_balance_volume", "price_volume_trend", "negative_volume_index", "positive_volume_index")


def indicator_sql(key: str, hours: int = 4, digits: int | None = 6) -> str | None:
    names = catalogue().columns[key]
    digits = 0 if digits and key in LARGE else digits
    if key in INDICATORS:
        ctes, last = staged(event_bars(hours), INDICATORS[key])
        return f"WITH {ctes}\nSELECT asset, date, {rounded(names, digits)} FROM {last}"
    start = f"WITH RECURSIVE {event_bars(hours)},"
    if key == "ehlers_super_smoother_filter":
        return f"{start} {SMOOTHER} SELECT asset, date, round(y, 6) + 0.0 AS super_smoother_10 FROM walk JOIN numbered USING (asset, n)"
    if key == "even_better_sinewave":
        return f"""{start} {SMOOTHER}, c AS (SELECT asset, date, close - y AS c, (close - y) * (close - y) AS c2 FROM walk JOIN numbered USING (asset, n)),
o AS (SELECT *, {div('c', f"sqrt({sma('c2', 10)})")} AS even_better_sinewave_10 FROM c), s AS (SELECT *, {ema('even_better_sinewave_10', 5)} AS even_better_sinewave_signal_10_5 FROM o) SELECT asset, date, {rounded(names)} FROM s"""
    if key == "kaufman_adaptive_moving_average":
        return f"{start} {KAMA} SELECT asset, date, round(y, 6) + 0.0 AS kama_10_2_30 FROM numbered LEFT JOIN walk USING (asset, n)"
    if key == "parabolic_sar":
        return f"{start} {PSAR}, o AS (SELECT asset, date, stop AS psar_0p02_0p2, side AS psar_trend_0p02_0p2, rate AS psar_af_0p02_0p2, {div('close - stop', 'stop')} AS psar_distance_0p02_0p2 FROM walk JOIN numbered USING (asset, n)) SELECT asset, date, {rounded(names)} FROM o"
    return None


def features_sql(keys: list[str]) -> str:
    """Unrounded columns of several indicators with the bars, as a query."""
    out, seen = f"(WITH {event_bars(4)} SELECT * FROM bars) bars", {"vix"}
    for i, key in enumerate(keys):
        names = [n for n in catalogue().columns[key] if n not in seen]
        seen.update(names)
        out += f" JOIN (SELECT asset, date, {', '.join(names)} FROM ({indicator_sql(key, digits=None)})) f{i} USING (asset, date)"
    return f"SELECT * FROM {out}"


RETURNS = {"1d": 1, "4d": 4, "24d": 24}


def lead(x: str, k: int) -> str:
    return f"(lead({x}, {k}) OVER (PARTITION BY asset ORDER BY date))"


def returns_sql(source: str = "bars") -> str:
    """CTEs r (forward returns) and cs (their deviations across assets, and scaled)."""
    r = ", ".join(f"{div(lead('close', h), 'close')} - 1 AS future_return_{x}" for x, h in RETURNS.items())
    std = ", ".join(f"CASE WHEN count(future_return_{x}) OVER (PARTITION BY date) >= 3 AND stddev_samp(future_return_{x}) OVER (PARTITION BY date) >= 1e-12 THEN stddev_samp(future_return_{x}) OVER (PARTITION BY date) END AS future_return_cs_std_{x}" for x in RETURNS)
    scaled = ", ".join(f"future_return_{x} / future_return_cs_std_{x} AS future_return_cs_scaled_{x}" for x in RETURNS)
    return f"r AS (SELECT *, {r} FROM {source}), cs0 AS (SELECT *, {std} FROM r), cs AS (SELECT *, {scaled} FROM cs0)"


#: Columns of the signal queries, by rule, with the indicators that they come from.
SIGNALS = {
    "centered_oscillator": {"bop": "balance_of_power", "roc_10": "rate_of_change", "cmo_14": "chande_momentum_oscillator", "macd_hist_12_26_9": "macd"},
    "extreme_zone_oscillator": {"mfi_14": "money_flow_index", "stochastic_k_14_3": "stochastic_oscillator", "cci_20": "commodity_channel_index", "rsi_14": "rsi"},
    "trend_filter": {"efficiency_ratio_10": "efficiency_ratio", "cti_20": "correlation_trend_indicator", "fib_wma_10": "fibonacci_weighted_moving_average"},
    "volume_confirmation": {"cmf_20": "chaikin_money_flow", "obv": "on_balance_volume"},
    "bollinger": {"bb_percent_b_20_2": "bollinger_bands"},
}
# fixed values
LIMITS = {"mfi_14": (0, 100), "stochastic_k_14_3": (0, 100), "cci_20": (-200, 200), "rsi_14": (0, 100)}


def signals_sql(rules: list[str], source: str = "feats", extra: str = "", signals: dict | None = None, limits: dict | None = None) -> str:
    """CTEs ending in sig: long signals of the columns of SIGNALS."""
    rows, signals, limits = [], signals or SIGNALS, limits or LIMITS
    for rule in rules:
        for c in signals[rule]:
            lo, hi = limits.get(c, ("NULL", "NULL"))
            x, base = c, c
            if rule in ("trend_filter", "volume_confirmation"):
                base = f"{c} - {lag(c)}"
            elif rule == "extreme_zone_oscillator":
                base = f"({lo} + {hi}) / 2.0 - CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {lo}), {hi}) END"
            elif rule == "bollinger":
                x, lo, hi = "close", "bb_lower_20_2", "bb_upper_20_2"
                base = f"CASE WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN greatest(close - {hi}, {lo} - close, 0) END"
            rows.append(f"SELECT asset, date, '{c}' AS indicator_name, '{rule}' AS rule, CAST({x} AS DOUBLE) AS value, CAST({base} AS DOUBLE) AS b, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi{extra} FROM {source}")
    g = "OVER (PARTITION BY date, indicator_name)"
    return f"""raw AS ({' UNION ALL '.join(rows)}),
l1 AS (SELECT *, count(b) {g} - CASE WHEN b IS NULL THEN 0 ELSE 1 END AS n, coalesce(sum(b) {g}, 0) - coalesce(b, 0) AS s, coalesce(sum(b * b) {g}, 0) - coalesce(b * b, 0) AS q FROM raw),
l2 AS (SELECT *, CASE WHEN n > 0 THEN s / n END AS mu, CASE WHEN n > 1 THEN sqrt(greatest((q - s * s / n) / (n - 1), 0)) END AS sd0 FROM l1),
l3 AS (SELECT *, CASE WHEN sd0 >= 1e-12 THEN sd0 END AS sd FROM l2),
l4 AS (SELECT *, CASE WHEN rule = 'bollinger' THEN b / sd ELSE (b - mu) / sd END AS z, CASE WHEN b IS NULL THEN NULL WHEN value > hi THEN 1 WHEN value < lo THEN -1 ELSE 0 END AS beyond FROM l3),
sig AS (SELECT *, CAST(CASE rule WHEN 'centered_oscillator' THEN sign(value) WHEN 'extreme_zone_oscillator' THEN CASE WHEN value IS NULL THEN NULL WHEN b > 0 THEN 1 ELSE -1 END WHEN 'trend_filter' THEN sign(z) WHEN 'volume_confirmation' THEN sign(b) ELSE beyond END AS DOUBLE) AS signal_direction,
  CASE WHEN coalesce(CASE rule WHEN 'extreme_zone_oscillator' THEN value BETWEEN lo AND hi WHEN 'bollinger' THEN beyond <> 0 AND abs(z) > 2 ELSE abs(z) > 2 END, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal_active,
  CASE WHEN rule = 'extreme_zone_oscillator' THEN abs(b) ELSE abs(z) END AS signal_strength, CASE WHEN rule = 'bollinger' THEN beyond * abs(z) ELSE z END AS signal_signed_value FROM l4)"""


def all_primary() -> tuple[dict[str, dict[str, str]], dict[str, tuple]]:
    """Every primary column of the catalogue by rule, as SIGNALS has some, and the natural limits by name."""
    from ..operators.signals import BOUNDS, signal_columns

    cat = catalogue()
    of = {n: k for k, names in cat.columns.items() for n in names}
    rules: dict[str, dict[str, str]] = {}
    for column, rule in signal_columns(cat.panel, list(of)).items():
        rules.setdefault(rule, {})[column] = of[column]
    return rules, {n: b for n in of for k, b in BOUNDS.items() if n.startswith(k)}


def target_rows(source: str = "sig", tau: float = 0) -> str:
    """CTE tgt: signals times horizons with the binary target."""
    parts = [f"SELECT *, '{x}' AS horizon, future_return_cs_scaled_{x} AS fr FROM {source}" for x in RETURNS]
    return f"tgt AS (SELECT *, CASE WHEN signal_active = 1 AND signal_direction IS NOT NULL AND fr IS NOT NULL THEN CASE WHEN signal_direction * fr > {tau} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS target FROM ({' UNION ALL '.join(parts)}))"
