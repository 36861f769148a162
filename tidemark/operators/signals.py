"""Signals of indicator columns: direction, activity, strength and signed value, in long form.

Columns become rows (one a key and indicator column) in one projection, differences over the series are
taken before that, and the leave-one-out statistics across assets are windows over date and indicator:
two shuffles, whatever the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import merged
from ..functions.windows import Panel, sdiv
from .indicators import catalogue

# fixed values: natural bounds of oscillators, by the start of a column's name
BOUNDS = {"rsi": (0, 100), "rsx": (0, 100), "stochastic_k": (0, 100), "stochastic_d": (0, 100), "mfi": (0, 100), "emotion_index": (0, 100), "willingness_index": (0, 100), "cci": (-200, 200), "pgo": (-3, 3), "cog": (-10, 10)}
# fixed values: starts of the names of an indicator's columns that carry its signal, and a word that bars one; other indicators use all columns
PRIMARY = {
    "acceleration_bands": (("accbands_percent_b_",), None),
    "bollinger_bands": (("bb_percent_b_",), None),
    "donchian_channel": (("donchian_width_",), None),
    "keltner_channel": (("keltner_width_",), None),
    "chande_forecast_oscillator": (("cfo_",), "fitted"),
    "ease_of_movement": (("eom_",), "sma"),
    "elders_force_index": (("efi_ema_",), None),
    "know_sure_thing": (("kst_",), "signal"),
    "macd": (("macd_line_", "macd_hist_"), None),
    "percentage_price_oscillator": (("ppo_",), "signal"),
    "percentage_volume_oscillator": (("pvo_",), "signal"),
    "relative_vigor_index": (("rvi_",), "signal"),
    "ichimoku": (("ichimoku_cloud_delta_",), None),
    "inertia_indicator": (("inertia_",), "fitted"),
    "linear_regression": (("linreg_slope_",), None),
    "moving_averages": (("sma_spread_", "ema_spread_"), None),
    "parabolic_sar": (("psar_distance_",), None),
}
SIGNAL_DEFAULTS = {"threshold": 2.0, "lag": 1, "ddof": 1, "min_std": 1e-12, "small_std": "nan", "clip": True, "bounds": BOUNDS, "unimplemented_bands": "skip", "context_placeholders": False}
#: Families without a rule: their rows, if asked for, have no direction, activity, strength or value.
PLACEHOLDERS = ("band_channel_level", "context_filter")
SIGNED = ("centered_oscillator", "extreme_zone_oscillator", "trend_filter", "volume_confirmation", "bollinger")
LONG = ("signal_direction", "signal_active", "signal_strength", "signal_signed_value", "cs_mean_loo", "cs_std_loo", "cs_zscore_loo")


def leave_one_out(x, over, ddof: int = 1, min_std: float = 1e-12, small_std: str = "nan") -> tuple[Column, Column, Column]:
    """Mean and deviation of the others of a group, and x standardised by them; a row whose x is null still gets the first two."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.count(x).over(over) - F.when(x.isNotNull(), 1).otherwise(0)
    total = F.coalesce(F.sum(x).over(over), F.lit(0.0)) - F.coalesce(x, F.lit(0.0))
    squares = F.coalesce(F.sum(x * x).over(over), F.lit(0.0)) - F.coalesce(x * x, F.lit(0.0))
    mean = F.when(n > 0, total / F.nullif(n, F.lit(0)))
    var = F.when(n > ddof, F.greatest((squares - total * total / F.nullif(n, F.lit(0))) / F.nullif(n - ddof, F.lit(0)), F.lit(0.0)))
    std = F.sqrt(var)
    std = F.greatest(std, F.lit(min_std)) * F.when(std.isNotNull(), 1) if small_std == "epsilon" else F.when(std >= min_std, std)
    return mean, std, sdiv(x - mean, std)


def bounds_of(column: str, bounds: dict) -> tuple[float, float] | None:
    """A column's own bounds, else those of the first prefix that fits; None is unknown."""
    found = bounds.get(column) or next((v for k, v in bounds.items() if column.startswith(k)), None)
    if found and found[0] >= found[1]:
        raise ValueError(f"bounds of {column} are not in order: {found}")
    return found


def signal_columns(panel: Panel, columns: list[str], config: dict | None = None, primary: bool = True, bands: bool = False, context: bool = False) -> dict[str, str]:
    """Which columns carry a signal, and their rule: families, with the Bollinger bands on their own.

    primary: only the columns that carry an indicator's signal. Other bands and context filters have no rule; those that
    are asked for get rows without a signal.
    """
    cat, out = catalogue(panel, config), {}
    for key, names in cat.columns.items():
        family = cat.families[key]
        if family == "context_filter" and not context or family == "band_channel_level" and key != "bollinger_bands" and not bands:
            continue
        starts, barred = PRIMARY.get(key, (("",), None)) if primary else (("",), None)
        rule = "bollinger" if key == "bollinger_bands" else family
        out |= {n: rule for n in names if n in columns and n.startswith(starts) and not (barred and barred in n)}
    return out


def families_of(panel: Panel, columns: list[str], primary: bool = True, context: bool = True, bands: bool = False) -> dict[str, str]:
    """Feature to family of the catalogue's columns that are there."""
    chosen = signal_columns(panel, columns, None, primary, bands, context)
    return {n: "band_channel_level" if r == "bollinger" else r for n, r in chosen.items()}


def family_counts(families: dict[str, str]) -> dict[str, int]:
    """How many features each family has."""
    return {f: list(families.values()).count(f) for f in sorted(set(families.values()))}


def add_signals(features: DataFrame, panel: Panel = Panel(), config: dict | None = None, columns: dict[str, str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Long signals: keys, carried columns, indicator_name, signal_family, value and the columns of LONG."""
    c = merged(SIGNAL_DEFAULTS, config)
    if columns is None:
        columns = signal_columns(panel, features.columns, bands=c["unimplemented_bands"] == "nan", context=c["context_placeholders"])
    chosen = columns
    if not chosen:
        raise ValueError("no signal column")
    carry = carry or []
    moved = features.withColumns({f"__d_{n}": panel.diff(n, c["lag"]) for n, rule in chosen.items() if rule in ("trend_filter", "volume_confirmation")})

    def entry(name: str, rule: str) -> Column:
        x, low, high, middle = F.col(name), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")
        base = x
        if rule in ("trend_filter", "volume_confirmation"):
            base = F.col(f"__d_{name}")
        elif rule == "extreme_zone_oscillator":
            found = bounds_of(name, c["bounds"])
            if found is None:
                return None
            low, high = (F.lit(float(b)) for b in found)
            middle = (low + high) / 2
            clipped = F.when(x.isNotNull(), F.least(F.greatest(x, low), high)) if c["clip"] else x
            base = middle - clipped
        elif rule in PLACEHOLDERS:
            base = F.lit(None)
        elif rule == "bollinger":
            low, high = F.col(name.replace("percent_b", "lower")), F.col(name.replace("percent_b", "upper"))
            x = F.col("close")
            base = F.when(low.isNotNull() & high.isNotNull() & x.isNotNull(), F.greatest(x - high, low - x, F.lit(0.0)))
        family = "band_channel_level" if rule == "bollinger" else rule
        return F.struct(F.lit(name).alias("indicator_name"), F.lit(family).alias("signal_family"), F.lit(rule).alias("__rule"), x.cast("double").alias("value"), base.cast("double").alias("__base"), low.cast("double").alias("__low"), high.cast("double").alias("__high"), middle.alias("__middle"))

    entries = [e for e in (entry(n, r) for n, r in chosen.items()) if e is not None]
    long = moved.select(*panel.keys, *carry, F.inline(F.array(*entries)))
    over = panel.across("indicator_name")
    mean, std, z = leave_one_out("__base", over, c["ddof"], c["min_std"], c["small_std"])
    long = long.withColumns({"cs_mean_loo": mean, "cs_std_loo": std})
    long = long.withColumn("cs_zscore_loo", F.when(F.col("__rule") == "bollinger", sdiv("__base", "cs_std_loo")).otherwise(sdiv(F.col("__base") - F.col("cs_mean_loo"), "cs_std_loo")))
    rule, x, base, z, t = F.col("__rule"), F.col("value"), F.col("__base"), F.col("cs_zscore_loo"), c["threshold"]
    flag = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0)
    outside = F.when(base.isNotNull(), F.when(x > F.col("__high"), 1.0).when(x < F.col("__low"), -1.0).otherwise(0.0))
    zone = F.when(x.isNotNull(), F.when(base > 0, 1.0).otherwise(-1.0))
    direction = F.when(rule == "centered_oscillator", F.signum(x)).when(rule == "extreme_zone_oscillator", zone).when(rule == "trend_filter", F.signum(z)).when(rule == "volume_confirmation", F.signum(base)).otherwise(outside)
    active = F.when(rule == "extreme_zone_oscillator", flag(x.between(F.col("__low"), F.col("__high")))).when(rule == "bollinger", flag((outside != 0) & (F.abs(z) > t))).otherwise(flag(F.abs(z) > t))
    active = F.when(~rule.isin(*PLACEHOLDERS), active)
    strength = F.when(rule == "extreme_zone_oscillator", F.abs(base)).otherwise(F.abs(z))
    signed = F.when(rule == "bollinger", outside * F.abs(z)).otherwise(z)
    out = long.withColumns({"signal_direction": direction, "signal_active": active, "signal_strength": strength, "signal_signed_value": signed})
    return out.select(*panel.keys, *carry, "indicator_name", "signal_family", "value", *LONG)


def wide_signals(long: DataFrame, panel: Panel = Panel(), carry: list[str] | None = None) -> DataFrame:
    """One row a key with the carried columns (the same in all rows of a key); columns <indicator>__signal_<part>."""
    names = [r[0] for r in long.select("indicator_name").distinct().orderBy("indicator_name").collect()]  # as many as columns
    parts = ("signal_direction", "signal_active", "signal_strength", "signal_signed_value")
    return long.groupBy(*panel.keys, *(carry or [])).pivot("indicator_name", names).agg(*[F.first(p, ignorenulls=True).alias(f"_{p}") for p in parts])


def default_families() -> dict[str, str]:
    """Every column of the catalogue to its family."""
    return {c: f for k, f in catalogue().families.items() for c in catalogue().columns[k]}
