"""The catalogue of technical indicators as expressions over one series.

A column is defined by an expression and the columns that it reads; those that a request needs are put
in order of depth, one select a level, all over the same partitioning. Recursive columns come from one
grouped map at the end, which finds its rows dealt and sorted already.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from ..config import INDICATOR_DEFAULTS, merged, token
from ..functions import windows as X
from ..functions.columns import first_columns, resolve_panel
from ..functions.windows import Panel, sdiv
from ..schema import BAR_COLUMNS
from ..sources.ohlcv import prepare
from .recursive import add_recursive


@dataclass
class Catalogue:
    """families: indicator to family; columns: indicator to its columns; native and after: column to (expression, needs); kernels: column to (kernel, needs)."""

    panel: Panel
    families: dict[str, str] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)
    native: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = field(default_factory=dict)
    kernels: dict[str, tuple[tuple, tuple[str, ...]]] = field(default_factory=dict)
    after: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = field(default_factory=dict)

    def add(self, key: str, family: str, **columns) -> None:
        """Each column: a kernel tuple, or (expression, needs); those that need a kernel's column come after it."""
        self.families[key] = family
        self.columns[key] = [c for c in columns if not c.startswith("_")]
        self.define(**columns)

    def define(self, **columns) -> None:
        for name, spec in columns.items():
            if isinstance(spec[0], str):
                self.kernels[name] = (spec, tuple(a for a in spec[1:] if isinstance(a, str)))
            else:
                make, *needs = spec
                late = any(n in self.kernels or n in self.after for n in needs)
                (self.after if late else self.native)[name] = (make, tuple(needs))


BASE = {"hlc_average", "median_price", "ohlc_average", "true_range", "simple_return_1", "log_return_1"}


def catalogue(panel: Panel = Panel(), config: dict | None = None, volume: bool = True, vix: bool = True) -> Catalogue:
    """All 69 indicators. Without volume or vix the columns that need them are null."""
    c, P = merged(INDICATOR_DEFAULTS, config), panel
    cat = Catalogue(panel)
    null = lambda: F.lit(None).cast("double")
    v = (lambda make, *needs: (make, *needs)) if volume else (lambda make, *needs: (null,))
    kv = (lambda *spec: spec) if volume else (lambda *spec: (null,))

    cat.define(
        hlc_average=(lambda: (col("high") + col("low") + col("close")) / 3,), median_price=(lambda: (col("high") + col("low")) / 2,), ohlc_average=(lambda: (col("open") + col("high") + col("low") + col("close")) / 4,),
        true_range=(lambda: F.greatest(col("high") - col("low"), F.abs(col("high") - P.lag("close")), F.abs(col("low") - P.lag("close"))),),
        simple_return_1=(lambda: P.change("close"),), log_return_1=(lambda: X.log_positive("close") - P.lag(X.log_positive("close")),),
        _position=(lambda: F.row_number().over(P.ordered()).cast("double"),), _delta=(lambda: P.diff("close"),),
        _up=(lambda: F.greatest("_delta", F.lit(0.0)) * F.when(F.col("_delta").isNotNull(), 1), "_delta"), _down=(lambda: F.greatest(-F.col("_delta"), F.lit(0.0)) * F.when(F.col("_delta").isNotNull(), 1), "_delta"),
        _rise=(lambda: P.diff("high"),), _fall=(lambda: -P.diff("low"),), _plus_dm=(lambda: F.when((F.col("_rise") > F.col("_fall")) & (F.col("_rise") > 0), F.col("_rise")).otherwise(0.0), "_rise", "_fall"),
        _minus_dm=(lambda: F.when((F.col("_fall") > F.col("_rise")) & (F.col("_fall") > 0), F.col("_fall")).otherwise(0.0), "_rise", "_fall"),
        _range=(lambda: col("high") - col("low"),), _mfv=v(lambda: sdiv((col("close") - col("low")) - (col("high") - col("close")), col("high") - col("low")) * col("volume")),
    )

    # bands and channels
    n, k = c["bollinger"]["window"], c["bollinger"]["std_multiplier"]
    s = f"{n}_{token(k)}"
    mid, up, down = f"bb_middle_{s}", f"bb_upper_{s}", f"bb_lower_{s}"
    cat.add("bollinger_bands", "band_channel_level", **{
        mid: (lambda: P.mean("close", n),), "_bb_std": (lambda: P.std("close", n),),
        up: (lambda: F.col(mid) + k * F.col("_bb_std"), mid, "_bb_std"), down: (lambda: F.col(mid) - k * F.col("_bb_std"), mid, "_bb_std"),
        f"bb_bandwidth_{s}": (lambda: sdiv(F.col(up) - F.col(down), mid), mid, up, down), f"bb_percent_b_{s}": (lambda: sdiv(col("close") - F.col(down), F.col(up) - F.col(down)), up, down),
    })
    dn = c["donchian"]["window"]
    cat.add("donchian_channel", "band_channel_level", **{
        f"donchian_upper_{dn}": (lambda: P.max("high", dn),), f"donchian_lower_{dn}": (lambda: P.min("low", dn),),
        f"donchian_middle_{dn}": (lambda: (F.col(f"donchian_upper_{dn}") + F.col(f"donchian_lower_{dn}")) / 2, f"donchian_upper_{dn}", f"donchian_lower_{dn}"),
        f"donchian_width_{dn}": (lambda: sdiv(F.col(f"donchian_upper_{dn}") - F.col(f"donchian_lower_{dn}"), f"donchian_middle_{dn}"), f"donchian_upper_{dn}", f"donchian_lower_{dn}", f"donchian_middle_{dn}"),
    })
    ke, ka, km = (c["keltner"][x] for x in ("ema_window", "atr_window", "multiplier"))
    ks, kmid = f"{ke}_{ka}_{token(km)}", f"keltner_middle_{ke}"
    cat.define(_keltner_atr=("atr", ka))
    cat.add("keltner_channel", "band_channel_level", **{
        kmid: ("ema", "close", ke), f"keltner_upper_{ks}": (lambda: F.col(kmid) + km * F.col("_keltner_atr"), kmid, "_keltner_atr"), f"keltner_lower_{ks}": (lambda: F.col(kmid) - km * F.col("_keltner_atr"), kmid, "_keltner_atr"),
        f"keltner_width_{ks}": (lambda: sdiv(F.col(f"keltner_upper_{ks}") - F.col(f"keltner_lower_{ks}"), kmid), f"keltner_upper_{ks}", f"keltner_lower_{ks}", kmid),
    })
    an = c["acceleration_bands"]["window"]
    au, al = f"accbands_upper_{an}", f"accbands_lower_{an}"
    cat.define(_acc=(lambda: 4 * sdiv(col("high") - col("low"), col("high") + col("low")),), _acc_up=(lambda: col("high") * (1 + F.col("_acc")), "_acc"), _acc_down=(lambda: col("low") * (1 - F.col("_acc")), "_acc"))
    cat.add("acceleration_bands", "band_channel_level", **{
        f"accbands_middle_{an}": (lambda: P.mean("close", an),), au: (lambda: P.mean("_acc_up", an), "_acc_up"), al: (lambda: P.mean("_acc_down", an), "_acc_down"),
        f"accbands_width_{an}": (lambda: sdiv(F.col(au) - F.col(al), f"accbands_middle_{an}"), au, al, f"accbands_middle_{an}"), f"accbands_percent_b_{an}": (lambda: sdiv(col("close") - F.col(al), F.col(au) - F.col(al)), au, al),
    })

    # centred oscillators
    centred = "centered_oscillator"
    f, sl = c["apo"]["fast"], c["apo"]["slow"]
    cat.define(_apo_fast=("ema", "close", f), _apo_slow=("ema", "close", sl))
    cat.add("absolute_price_oscillator", centred, **{f"apo_{f}_{sl}": (lambda: F.col("_apo_fast") - F.col("_apo_slow"), "_apo_fast", "_apo_slow")})
    f2, s2 = c["ado"]["fast"], c["ado"]["slow"]
    cat.define(_ad=v(lambda: P.running_sum("_mfv"), "_mfv"))
    cat.define(_ado_fast=kv("ema", "_ad", f2), _ado_slow=kv("ema", "_ad", s2))
    cat.add("accumulation_distribution_oscillator", centred, **{f"ado_{f2}_{s2}": (lambda: F.col("_ado_fast") - F.col("_ado_slow"), "_ado_fast", "_ado_slow")})
    af, as_ = c["awesome"]["fast"], c["awesome"]["slow"]
    cat.add("awesome_oscillator", centred, **{f"awesome_oscillator_{af}_{as_}": (lambda: P.mean("median_price", af) - P.mean("median_price", as_), "median_price")})
    cat.add("balance_of_power", centred, bop=(lambda: sdiv(col("close") - col("open"), col("high") - col("low")),))
    bn = c["bias"]["window"]
    cat.add("bias_indicator", centred, **{f"bias_{bn}": (lambda: sdiv(col("close") - P.mean("close", bn), P.mean("close", bn)),)})
    cn = c["cfo"]["window"]
    cat.add("chande_forecast_oscillator", centred, **{f"cfo_{cn}": (lambda: 100 * sdiv(col("close") - F.col(f"cfo_fitted_{cn}"), f"cfo_fitted_{cn}"), f"cfo_fitted_{cn}"), f"cfo_fitted_{cn}": (lambda: P.trend("close", cn, "_position")[2], "_position")})
    mn = c["cmo"]["window"]
    cat.add("chande_momentum_oscillator", centred, **{f"cmo_{mn}": (lambda: 100 * sdiv(P.sum("_up", mn) - P.sum("_down", mn), P.sum("_up", mn) + P.sum("_down", mn)), "_up", "_down")})
    cl, cs, cw = (c["coppock"][x] for x in ("long_window", "short_window", "wma_window"))
    cat.define(_coppock=(lambda: 100 * P.change("close", cl) + 100 * P.change("close", cs),))
    cat.add("coppock_curve", centred, **{f"coppock_{cl}_{cs}_{cw}": (lambda: P.weighted("_coppock", list(range(1, cw + 1))), "_coppock")})
    dp = c["dpo"]["window"]
    cat.add("detrended_price_oscillator", centred, **{f"dpo_{dp}": (lambda: P.lag("close", dp // 2 + 1) - P.mean("close", dp),)})
    en, es = c["eom"]["window"], c["eom"]["smoothing_window"]
    cat.add("ease_of_movement", centred, **{f"eom_{en}": v(lambda: sdiv(P.diff("median_price"), sdiv(col("volume"), col("high") - col("low"))), "median_price"), f"eom_sma_{es}": v(lambda: P.mean(f"eom_{en}", es), f"eom_{en}")})
    fn = c["efi"]["window"]
    cat.add("elders_force_index", centred, **{"efi_raw": v(lambda: F.col("_delta") * col("volume"), "_delta"), f"efi_ema_{fn}": kv("ema", "efi_raw", fn)})
    kr, ksm, kw, kg = (c["kst"][x] for x in ("roc_windows", "sma_windows", "weights", "signal_window"))
    kst = "kst_" + "_".join(map(str, kr))
    for i, r in enumerate(kr):
        cat.define(**{f"_roc_{r}": (lambda r=r: 100 * P.change("close", r),)})
    cat.add("know_sure_thing", centred, **{
        kst: (lambda: sum((w * P.mean(f"_roc_{r}", m) for r, m, w in zip(kr, ksm, kw)), F.lit(0.0)), *[f"_roc_{r}" for r in kr]),
        f"kst_signal_{'_'.join(map(str, kr))}_{kg}": (lambda: P.mean(kst, kg), kst),
    })
    for name, key, source, gate in (("macd", "macd", "close", True), ("percentage_price_oscillator", "ppo", "close", True), ("percentage_volume_oscillator", "pvo", "volume", volume)):
        a, b, g = c[key]["fast"], c[key]["slow"], c[key]["signal_window"]
        line = f"macd_line_{a}_{b}" if key == "macd" else f"{key}_{a}_{b}"
        signal, hist = f"{key}_signal_{a}_{b}_{g}", f"{key}_hist_{a}_{b}_{g}"
        if gate:
            cat.define(**{f"_{key}_fast": ("ema", source, a), f"_{key}_slow": ("ema", source, b)})
            cat.add(name, centred, **{line: ("difference" if key == "macd" else "spread", f"_{key}_fast", f"_{key}_slow"), signal: ("ema", line, g), hist: (lambda line=line, signal=signal: F.col(line) - F.col(signal), line, signal)})
        else:
            cat.add(name, centred, **{x: (null,) for x in (line, signal, hist)})
    mo = c["momentum"]["window"]
    cat.add("momentum_indicator", centred, **{f"momentum_{mo}": (lambda: P.diff("close", mo),)})
    qn = c["qstick"]["window"]
    cat.add("qstick_indicator", centred, **{f"qstick_{qn}": (lambda: P.mean(col("close") - col("open"), qn),)})
    rn = c["roc"]["window"]
    cat.add("rate_of_change", centred, **{f"roc_{rn}": (lambda: 100 * P.change("close", rn),)})
    vn, vg = c["rvi"]["window"], c["rvi"]["signal_window"]
    cat.add("relative_vigor_index", centred, **{f"rvi_{vn}": (lambda: sdiv(P.mean(col("close") - col("open"), vn), P.mean(col("high") - col("low"), vn)),), f"rvi_signal_{vn}_{vg}": (lambda: P.mean(f"rvi_{vn}", vg), f"rvi_{vn}")})

    # context
    context = "context_filter"
    for key, name in (("high_low_close_average", "hlc_average"), ("median_price", "median_price"), ("open_high_low_close_average", "ohlc_average")):
        cat.families[key], cat.columns[key] = context, [name]
    tn = c["atr"]["window"]
    cat.add("atr", context, **{f"atr_{tn}": ("atr", tn)})
    cat.add("normalized_atr", context, **{f"natr_{tn}": (lambda: sdiv(f"atr_{tn}", "close"), f"atr_{tn}")})
    xn = c["adx"]["window"]
    plus, minus = f"plus_di_{xn}", f"minus_di_{xn}"
    cat.define(_adx_range=("wilder", "true_range", xn), _plus_mean=("wilder", "_plus_dm", xn), _minus_mean=("wilder", "_minus_dm", xn))
    cat.add("adx", context, **{f"adx_{xn}": ("wilder", f"dx_{xn}", xn), plus: ("percent", "_plus_mean", "_adx_range"), minus: ("percent", "_minus_mean", "_adx_range"), f"dx_{xn}": ("imbalance", plus, minus)})
    hn = c["choppiness"]["window"]
    cat.add("choppiness_index", context, **{f"choppiness_{hn}": (lambda: 100 * F.log10(F.nullif(sdiv(P.sum("true_range", hn), P.max("high", hn) - P.min("low", hn)), F.lit(0.0))) / math.log10(hn), "true_range")})
    yn, bins = c["entropy"]["window"], c["entropy"]["bins"]
    if c["entropy"]["mode"] == "bins":
        cat.define(_log_returns=(lambda: P.gathered("log_return_1", yn), "log_return_1"))
        cat.add("entropy_indicator", context, **{f"entropy_{yn}": (lambda: X.bin_entropy(F.col("_log_returns"), bins), "_log_returns")})
    else:
        cat.add("entropy_indicator", context, **{f"entropy_{yn}": (lambda: P.sign_entropy("log_return_1", yn), "log_return_1")})
    un = c["kurtosis"]["window"]
    cat.add("kurtosis", context, **{f"kurtosis_{un}": (lambda: P.kurtosis("simple_return_1", un), "simple_return_1")})
    me, ms = c["mass_index"]["ema_window"], c["mass_index"]["sum_window"]
    cat.add("mass_index", context, **{f"mass_index_{me}_{ms}": ("mass", me, ms)})
    dn2, src = c["mad"]["window"], c["mad"]["source"]
    source = {"close": "close", "typical_price": "hlc_average", "median_price": "median_price"}[src]
    cat.define(_mad_values=(lambda: P.gathered(source, dn2), source), _mad_mean=(lambda: P.mean(source, dn2), source))
    cat.add("mean_absolute_deviation", context, **{f"mad_{src}_{dn2}": (lambda: X.mean_abs_deviation(F.col("_mad_values"), F.col("_mad_mean"), dn2), "_mad_values", "_mad_mean")})
    m1, m2 = c["midpoint"]["window"], c["midprice"]["window"]
    cat.add("midpoint_indicator", context, **{f"midpoint_{m1}": (lambda: (P.max("close", m1) + P.min("close", m1)) / 2,)})
    cat.add("midprice_indicator", context, **{f"midprice_{m2}": (lambda: (P.max("high", m2) + P.min("low", m2)) / 2,)})
    pn, ref = c["price_distance"]["window"], "ema" if c["price_distance"]["reference"] == "ema" else "sma"
    r = f"price_distance_ref_{ref}_{pn}"
    cat.add("price_distance", context, **{r: ("ema", "close", pn) if ref == "ema" else (lambda: P.mean("close", pn),), f"price_distance_{ref}_{pn}": (lambda: sdiv(col("close") - F.col(r), r), r)})
    qn2 = c["quantile"]["window"]
    cat.define(_closes=(lambda: P.gathered("close", qn2),))
    cat.add("quantile_indicator", context, **{f"quantile_rank_{qn2}": (lambda: X.percent_rank(F.col("_closes"), col("close"), qn2), "_closes")})
    vr, vs, vz = (c["vix"][x] for x in ("roc_window", "sma_window", "zscore_window"))
    x_ = (lambda make: (make,)) if vix else (lambda make: (null,))
    cat.add("vix", context, **{**({} if vix else {"vix": (null,)}), f"vix_roc_{vr}": x_(lambda: 100 * P.change("vix", vr)), f"vix_sma_{vs}": x_(lambda: P.mean("vix", vs)), f"vix_zscore_{vz}": x_(lambda: sdiv(F.col("vix") - P.mean("vix", vz), P.std("vix", vz)))})
    cat.columns["vix"] = ["vix", f"vix_roc_{vr}", f"vix_sma_{vs}", f"vix_zscore_{vz}"]

    # extreme zones
    extreme = "extreme_zone_oscillator"
    gn = c["center_of_gravity"]["window"]
    weighted = lambda: sum((P.lag("close", i - 1) * i for i in range(2, gn + 1)), col("close") * 1)
    cat.add("center_of_gravity", extreme, **{f"cog_{gn}": (lambda: P.full("close", gn, -sdiv(weighted(), F.sum("close").over(P.last(gn)))),)})
    in_ = c["cci"]["window"]
    cat.define(_typical=(lambda: P.gathered("hlc_average", in_), "hlc_average"), _typical_mean=(lambda: P.mean("hlc_average", in_), "hlc_average"))
    cat.add("commodity_channel_index", extreme, **{f"cci_{in_}": (lambda: sdiv(F.col("hlc_average") - F.col("_typical_mean"), 0.015 * X.mean_abs_deviation(F.col("_typical"), F.col("_typical_mean"), in_)), "hlc_average", "_typical", "_typical_mean")})
    wn = c["emotion_willingness"]["window"]
    cat.add("emotion_index_willingness_index", extreme, **{f"emotion_index_{wn}": ("emotion", tn, wn), f"willingness_index_{wn}": (lambda: 100 * sdiv(col("close") - P.min("low", wn), P.max("high", wn) - P.min("low", wn)),)})
    fl = c["mfi"]["window"]
    cat.define(_typical_move=(lambda: P.diff("hlc_average"), "hlc_average"), _flow=v(lambda: F.col("hlc_average") * col("volume"), "hlc_average"))
    cat.define(_flow_up=v(lambda: F.when(F.col("_typical_move") > 0, F.col("_flow")).otherwise(0.0), "_typical_move", "_flow"), _flow_down=v(lambda: F.when(F.col("_typical_move") < 0, F.col("_flow")).otherwise(0.0), "_typical_move", "_flow"))
    cat.add("money_flow_index", extreme, **{f"mfi_{fl}": v(lambda: 100 - 100 / (1 + sdiv(P.sum("_flow_up", fl), P.sum("_flow_down", fl))), "_flow_up", "_flow_down")})
    gp = c["pgo"]["window"]
    cat.define(_pgo_atr=("atr", gp), _pgo_mean=(lambda: P.mean("close", gp),))
    cat.add("pretty_good_oscillator", extreme, **{f"pgo_{gp}": (lambda: sdiv(col("close") - F.col("_pgo_mean"), "_pgo_atr"), "_pgo_mean", "_pgo_atr")})
    cat.add("rsi", extreme, **{f"rsi_{c['rsi']['window']}": ("rsi", c["rsi"]["window"])})
    cat.add("rsx", extreme, **{f"rsx_{c['rsx']['window']}": ("rsx", c["rsx"]["window"], c["rsx"]["smoothing_window"])})
    on, og = c["stochastic"]["window"], c["stochastic"]["signal_window"]
    kd = f"stochastic_k_{on}_{og}"
    cat.add("stochastic_oscillator", extreme, **{kd: (lambda: 100 * sdiv(col("close") - P.min("low", on), P.max("high", on) - P.min("low", on)),), f"stochastic_d_{on}_{og}": (lambda: P.mean(kd, og), kd)})

    # trend
    trend = "trend_filter"
    smas, emas = c["ma"]["sma_windows"], c["ma"]["ema_windows"]
    spread = lambda a, b: (lambda: sdiv(F.col(a) - F.col(b), b), a, b)
    cat.add("moving_averages", trend, **{
        **{f"sma_{m}": (lambda m=m: P.mean("close", m),) for m in smas}, **{f"ema_{m}": ("ema", "close", m) for m in emas},
    })
    for kind, spans in (("sma", smas), ("ema", emas)):
        for a, b in zip(spans, spans[1:]):
            cat.define(**{f"{kind}_spread_{a}_{b}": spread(f"{kind}_{a}", f"{kind}_{b}")})
            cat.columns["moving_averages"].append(f"{kind}_spread_{a}_{b}")
    ln, lo, lsg = (c["alma"][x] for x in ("window", "offset", "sigma"))
    cat.add("alma", trend, **{f"alma_{ln}_{token(lo)}_{token(lsg)}": (lambda: P.weighted("close", X.gaussian_weights(ln, lo, lsg)),)})
    ar = c["aroon"]["window"]
    cat.define(_highs=(lambda: P.gathered("high", ar),), _lows=(lambda: P.gathered("low", ar),))
    cat.add("aroon_indicator", trend, **{
        f"aroon_up_{ar}": (lambda: 100 * X.first_position(F.col("_highs"), F.array_max("_highs")) / ar, "_highs"), f"aroon_down_{ar}": (lambda: 100 * X.first_position(F.col("_lows"), F.array_min("_lows")) / ar, "_lows"),
        f"aroon_oscillator_{ar}": (lambda: F.col(f"aroon_up_{ar}") - F.col(f"aroon_down_{ar}"), f"aroon_up_{ar}", f"aroon_down_{ar}"),
    })
    ct = c["cti"]["window"]
    cat.add("correlation_trend_indicator", trend, **{f"cti_{ct}": (lambda: P.time_correlation("close", ct, "_position"), "_position")})
    er = c["efficiency_ratio"]["window"]
    cat.add("efficiency_ratio", trend, **{f"efficiency_ratio_{er}": (lambda: sdiv(F.abs(P.diff("close", er)), P.sum(F.abs("_delta"), er)), "_delta")})
    cat.add("ehlers_super_smoother_filter", trend, **{f"super_smoother_{c['super_smoother']['period']}": ("smoother", c["super_smoother"]["period"])})
    ep, eg = c["even_better_sinewave"]["period"], c["even_better_sinewave"]["signal_window"]
    cat.add("even_better_sinewave", trend, **{f"even_better_sinewave_{ep}": ("sinewave", ep), f"even_better_sinewave_signal_{ep}_{eg}": ("ema", f"even_better_sinewave_{ep}", eg)})
    cat.add("fibonacci_weighted_moving_average", trend, **{f"fib_wma_{c['fibonacci_wma']['window']}": (lambda: P.weighted("close", X.fibonacci_weights(c["fibonacci_wma"]["window"])),)})
    it, ik, ib = (c["ichimoku"][x] for x in ("tenkan_window", "kijun_window", "span_b_window"))
    middle = lambda m: (lambda: (P.max("high", m) + P.min("low", m)) / 2,)
    tenkan, kijun, span_a, span_b = f"ichimoku_tenkan_{it}", f"ichimoku_kijun_{ik}", f"ichimoku_span_a_{it}_{ik}", f"ichimoku_span_b_{ib}"
    cat.add("ichimoku", trend, **{tenkan: middle(it), kijun: middle(ik), span_a: (lambda: (F.col(tenkan) + F.col(kijun)) / 2, tenkan, kijun), span_b: middle(ib), f"ichimoku_cloud_delta_{it}_{ik}_{ib}": (lambda: F.col(span_a) - F.col(span_b), span_a, span_b)})
    ir = c["inertia"]["window"]
    cat.add("inertia_indicator", trend, **{f"inertia_{ir}": (lambda: 100 * sdiv(P.trend("close", ir, "_position")[0], P.mean("close", ir)) * F.pow(P.time_correlation("close", ir, "_position"), 2), "_position"), f"inertia_fitted_{ir}": (lambda: P.trend("close", ir, "_position")[2], "_position")})
    kn, kf, ksl = (c["kama"][x] for x in ("er_window", "fast", "slow"))
    cat.add("kaufman_adaptive_moving_average", trend, **{f"kama_{kn}_{kf}_{ksl}": ("kama", kn, kf, ksl)})
    ld = c["linear_decay"]["window"]
    cat.add("linear_decay", trend, **{f"linear_decay_{ld}": (lambda: P.weighted("close", list(range(1, ld + 1))),)})
    lr = c["linear_regression"]["window"]
    cat.add("linear_regression", trend, **{f"linreg_{x}_{lr}": (lambda i=i: P.trend("close", lr, "_position")[i], "_position") for i, x in enumerate(("slope", "intercept", "fitted"))})
    st, mx = c["psar"]["step"], c["psar"]["max_step"]
    ps = f"{token(st)}_{token(mx)}"
    cat.add("parabolic_sar", trend, **{f"psar_{ps}": ("parabolic", st, mx, 0), f"psar_trend_{ps}": ("parabolic", st, mx, 1), f"psar_af_{ps}": ("parabolic", st, mx, 2), f"psar_distance_{ps}": (lambda: sdiv(col("close") - F.col(f"psar_{ps}"), f"psar_{ps}"), f"psar_{ps}")})

    # volume
    confirm = "volume_confirmation"
    cat.add("accumulation_distribution_line", confirm, ad_line=v(lambda: P.running_sum("_mfv"), "_mfv"))
    mf = c["cmf"]["window"]
    cat.add("chaikin_money_flow", confirm, **{f"cmf_{mf}": v(lambda: sdiv(P.sum("_mfv", mf), P.sum("volume", mf)), "_mfv")})
    ey = c["elder_ray"]["window"]
    cat.define(_elder_ema=("ema", "close", ey))
    cat.add("elder_ray_index", confirm, **{f"elder_ray_bull_{ey}": v(lambda: col("high") - F.col("_elder_ema"), "_elder_ema"), f"elder_ray_bear_{ey}": v(lambda: col("low") - F.col("_elder_ema"), "_elder_ema")})
    cat.define(_signed_volume=v(lambda: F.coalesce(F.signum("_delta"), F.lit(0.0)) * col("volume"), "_delta"), _pvt=v(lambda: F.coalesce(col("volume") * P.change("close"), F.lit(0.0))))
    cat.add("on_balance_volume", confirm, obv=v(lambda: P.running_sum("_signed_volume"), "_signed_volume"))
    cat.add("price_volume_trend", confirm, pvt=v(lambda: P.running_sum("_pvt"), "_pvt"))
    for key, name, sign in (("negative_volume_index", "nvi", -1), ("positive_volume_index", "pvi", 1)):
        moved = lambda sign=sign: F.when(sign * (col("volume") - P.lag("volume")) > 0, F.coalesce(1 + P.change("close"), F.lit(1.0))).otherwise(1.0)
        cat.define(**{f"_{name}": v(moved)})
        cat.add(key, confirm, **{name: v(lambda name=name: P.running_product(f"_{name}") * c[name]["start_value"], f"_{name}")})
    pr = c["price_volume_rank"]["window"]
    cat.define(_returns=(lambda: P.gathered("simple_return_1", pr), "simple_return_1"), _volumes=v(lambda: P.gathered("volume", pr)))
    cat.add("price_volume_rank", confirm, **{f"price_volume_rank_{pr}": v(lambda: (2 * X.percent_rank(F.col("_returns"), F.col("simple_return_1"), pr) - 1) * X.percent_rank(F.col("_volumes"), col("volume"), pr), "_returns", "_volumes", "simple_return_1")})
    return cat


def compute_indicators(df: DataFrame, keys: list[str] | None = None, panel: Panel = Panel(), config: dict | None = None, base: bool | None = None) -> DataFrame:
    """Keys, OHLCV and the columns of the indicators asked for (all, if none are named), in one shuffle by series."""
    cat = catalogue(panel, config, "volume" in df.columns, "vix" in df.columns)
    general = merged(INDICATOR_DEFAULTS, config)["general"]
    keys = list(cat.columns) if keys is None else keys
    wanted = [x for k in keys for x in cat.columns[k]]
    if base or base is None and len(keys) == len(cat.columns) and general["include_base_features"]:
        wanted = list(dict.fromkeys([*sorted(BASE), *wanted]))
    levels, seen = {}, set(df.columns)
    kernels: dict[str, tuple] = {}

    def visit(name: str) -> int:
        if name in seen:
            return 0
        if name in levels:
            return levels[name]
        if name in cat.kernels:
            spec, needs = cat.kernels[name]
            for n in needs:
                visit(n)
            kernels[name] = spec
            levels[name] = -1
            return -1
        table = cat.after if name in cat.after else cat.native
        depth = max([visit(n) for n in table[name][1]], default=0)
        levels[name] = (max(depth, 0) + 1) if table is cat.native else max(depth, 100) + 1
        return levels[name]

    for name in wanted:
        visit(name)
    out = df
    for level in sorted({x for x in levels.values() if 0 < x <= 100}):
        out = out.withColumns({n: cat.native[n][0]() for n, x in levels.items() if x == level})
    out = add_recursive(out, panel, kernels)
    for level in sorted({x for x in levels.values() if x > 100}):
        out = out.withColumns({n: cat.after[n][0]() for n, x in levels.items() if x == level})
    first = [x for x in ("open", "high", "low", "close", "buy_volume", "sell_volume", "volume") if x in df.columns]
    if general["include_all_original_columns"]:
        first = [x for x in df.columns if x not in panel.keys]
    if general["print_summary"]:
        print(f"{len(keys)} indicators, {len(wanted)} columns")
    return out.select(*panel.keys, *first, *[n for n in dict.fromkeys(wanted) if n not in panel.keys and n not in first])


def features_of(df: DataFrame, keys: list[str] | None = None, config: dict | None = None, asset: str | None = None, date: str | None = None, context: list[str] | None = None) -> DataFrame:
    """compute_indicators of a table as it comes: names in any case, repeated columns, prices as text, repeated dates; keys are found by name."""
    named = first_columns(df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns]))
    panel = resolve_panel(named.drop(*BAR_COLUMNS, "vix"), asset, date, context)  # prices may be text, which is no context
    return compute_indicators(prepare(named, panel), keys, panel, config)
