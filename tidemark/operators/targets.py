"""Forward returns over horizons counted in rows, their scalings, and binary targets of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Panel, sdiv

HORIZONS = {"1d": 1, "4d": 4, "24d": 24}


def normalize_horizons(horizons) -> dict[str, int]:
    """A number or list gives h<k>; a mapping keeps its labels, blanks turned to underscores."""
    if isinstance(horizons, int):
        horizons = [horizons]
    out = {str(k).replace(" ", "_"): int(v) for k, v in horizons.items()} if isinstance(horizons, dict) else {f"h{int(h)}": int(h) for h in horizons}
    if not out or min(out.values()) <= 0:
        raise ValueError("horizons must be positive")
    return out


def small(x: Column, least: float, policy: str) -> Column:
    """Values under the least are null, or raised to it."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least))) if policy == "epsilon" else F.when(x >= least, x)


def future_returns(df: DataFrame, horizons=HORIZONS, panel: Panel = Panel(), price: str = "close", log: bool = True) -> DataFrame:
    out = {}
    for label, h in normalize_horizons(horizons).items():
        ahead = panel.lead(price, h)
        out[f"future_return_{label}"] = sdiv(ahead, price) - 1
        if log:
            out[f"future_log_return_{label}"] = F.when((ahead > 0) & (F.col(price) > 0), F.ln(F.when(ahead > 0, ahead)) - F.ln(F.when(F.col(price) > 0, F.col(price))))
    return df.withColumns(out)


def past_returns(panel: Panel, price: str = "close", kind: str = "simple") -> Column:
    before = panel.lag(price)
    if kind == "log":
        return F.when((before > 0) & (F.col(price) > 0), F.ln(F.when(F.col(price) > 0, F.col(price))) - F.ln(F.when(before > 0, before)))
    return sdiv(price, before) - 1


def vol_scaled_returns(df: DataFrame, horizons=HORIZONS, panel: Panel = Panel(), window: int = 20, kind: str = "simple", ddof: int = 1, min_periods: int | None = None, min_vol: float = 1e-12, policy: str = "nan", log: bool = False, keep_vol: bool = True) -> DataFrame:
    """Forward returns over the trailing deviation of one-step returns."""
    vol = f"past_vol_{kind}_{window}"
    out = future_returns(df, horizons, panel, log=log).withColumn("__r", past_returns(panel, kind=kind))
    out = out.withColumn(vol, small(panel.std("__r", window, ddof, min_periods), min_vol, policy)).drop("__r")
    labels = normalize_horizons(horizons)
    out = out.withColumns({f"future_return_scaled_{x}": sdiv(f"future_return_{x}", vol) for x in labels} | ({f"future_log_return_scaled_{x}": sdiv(f"future_log_return_{x}", vol) for x in labels} if log else {}))
    return out if keep_vol else out.drop(vol)


def spread(x: str, over, ddof: int = 1) -> Column:
    """Deviation over a window, with n - ddof in the divisor; null with no more than ddof values."""
    n = F.count(x).over(over)
    return F.stddev_samp(x).over(over) if ddof == 1 else F.when(n > ddof, F.sqrt(F.var_pop(x).over(over) * n / F.nullif(n - ddof, F.lit(0))))


def cross_scaled_returns(df: DataFrame, horizons=HORIZONS, panel: Panel = Panel(), ddof: int = 1, min_assets: int = 3, min_std: float = 1e-12, policy: str = "nan") -> DataFrame:
    """Forward returns over their deviation across assets at the same date."""
    labels, over = normalize_horizons(horizons), panel.across()
    out = future_returns(df, horizons, panel, log=False)
    out = out.withColumns({f"future_return_cs_std_{x}": small(F.when(F.count(f"future_return_{x}").over(over) >= min_assets, spread(f"future_return_{x}", over, ddof)), min_std, policy) for x in labels})
    return out.withColumns({f"future_return_cs_scaled_{x}": sdiv(f"future_return_{x}", f"future_return_cs_std_{x}") for x in labels})


def binary_target(direction, active, future, tau: float = 0.1, inactive: str = "nan") -> Column:
    """1 if the move in the signal's direction exceeds tau, else 0; null where a part is. Inactive signals: nan, zero or drop_later."""
    d, a, r = (F.col(x) if isinstance(x, str) else x for x in (direction, active, future))
    hit = F.when(d.isNotNull() & r.isNotNull() & a.isNotNull(), F.when(d * r > tau, 1.0).otherwise(0.0))
    if inactive == "drop_later":
        return hit
    idle = F.lit(0.0) if inactive == "zero" else F.lit(None).cast("double")
    return F.when(a == 1, hit).when(a.isNotNull(), F.when(hit.isNotNull(), idle))


RETURN_COLUMNS = {"cross_sectional_future_return": "future_return_cs_scaled_{}", "past_vol": "future_return_scaled_{}", "raw": "future_return_{}"}


def targets_long(signals: DataFrame, horizons=HORIZONS, tau: float = 0.0, inactive: str = "nan", scaling: str = "cross_sectional_future_return") -> DataFrame:
    """Long signals that carry the returns, times horizons, with target; no join and no shuffle."""
    rows = [F.struct(F.lit(x).alias("horizon"), F.col(RETURN_COLUMNS[scaling].format(x)).alias("future_return")) for x in normalize_horizons(horizons)]
    out = signals.select("*", F.inline(F.array(*rows)))
    return out.withColumn("target", binary_target("signal_direction", "signal_active", "future_return", tau, inactive))


def target_report(long: DataFrame) -> DataFrame:
    """Rows, active rows, targets and their rates, by horizon."""
    return long.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("signal_active") == 1).alias("n_active"), F.count("target").alias("n_targets"), F.count_if(F.col("target") == 1).alias("n_positive"),
        F.count_if(F.col("target") == 0).alias("n_zero"), F.count_if(F.col("target").isNull()).alias("n_null"), F.avg("target").alias("target_rate"),
    )


def alignment_report(given: DataFrame, again: DataFrame, keys: list[str], columns: list[str], atol: float = 1e-10, rtol: float = 1e-8) -> DataFrame:
    """By column: rows, largest difference, and whether all agree (null equals null)."""
    b = again.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    rows = given.select(*keys, *columns).join(b, keys).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("a"), F.col(f"__{c}").cast("double").alias("b")) for c in columns])))
    close = (F.col("a").isNull() & F.col("b").isNull()) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs("b"), F.lit(False))
    return rows.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"), F.bool_and(close).alias("aligned"))


def cross_section_report(df: DataFrame, horizons=HORIZONS, panel: Panel = Panel(), ddof: int = 1, min_assets: int = 3, min_std: float = 1e-12) -> DataFrame:
    """By horizon: how many dates (groups) there are, and in how many the deviation is missing, under-filled or too small. df has the forward returns."""
    labels = list(normalize_horizons(horizons))
    n = {x: F.count(f"future_return_{x}") for x in labels}
    std = {x: F.when(n[x] > ddof, F.sqrt(F.var_pop(f"future_return_{x}") * n[x] / F.nullif(n[x] - ddof, F.lit(0)))) for x in labels}
    groups = df.groupBy(*panel.section).agg(*[F.struct(n[x].alias("n"), std[x].alias("s")).alias(f"g_{x}") for x in labels])
    rows = groups.select(F.inline(F.array(*[F.struct(F.lit(x).alias("horizon"), F.col(f"g_{x}.n").alias("n"), F.col(f"g_{x}.s").alias("s")) for x in labels])))
    return rows.groupBy("horizon").agg(F.count(F.lit(1)).alias("cs_group_count"), F.count_if(F.col("s").isNull()).alias("cs_group_nan_std_count"), F.count_if(F.col("n") < min_assets).alias("cs_group_insufficient_assets_count"), F.count_if(F.col("s") < min_std).alias("cs_group_small_std_count"))


def validate_alignment(wide: DataFrame, horizons=HORIZONS, panel: Panel = Panel(), features: list[str] | None = None, scaling: str = "cross_sectional_future_return", min_assets: int = 3, min_std: float = 1e-12, policy: str = "nan", window: int = 20, kind: str = "simple", atol: float = 1e-10, rtol: float = 1e-8) -> DataFrame:
    """A row a horizon and feature of a wide table: its returns against returns computed again from prices, and counts of its targets.

    What is computed again stands beside the given columns on the same rows, so nothing is joined; horizons whose return
    column isn't there are left out, and features without a target column of the horizon too.
    """
    labels = {x: k for x, k in normalize_horizons(horizons).items() if RETURN_COLUMNS[scaling].format(x) in wide.columns}
    found = [(c, *c.rsplit("__target_", 1)) for c in wide.columns if "__target_" in c]
    wanted = [(c, f, h) for c, f, h in found if h in labels and (features is None or f in features)]
    given = wide.select(*panel.keys, "close", *[F.col(c).alias(f"__given_{c}") for c in wide.columns if c not in (*panel.keys, "close")])
    if scaling == "past_vol":
        again = vol_scaled_returns(given, labels, panel, window, kind, min_vol=min_std, policy=policy)
    else:
        again = cross_scaled_returns(given, labels, panel, min_assets=min_assets, min_std=min_std, policy=policy)
    again = again.withColumn("__same_key", F.count(F.lit(1)).over(Window.partitionBy(*panel.keys)))

    def agreed(a: Column, b: Column) -> list[Column]:
        close = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))
        return [F.coalesce(F.bool_and(close), F.lit(True)), F.max(F.abs(a - b))]

    totals = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("__same_key") > 1).alias("repeated")]
    for h in labels:
        column = RETURN_COLUMNS[scaling].format(h)
        totals += [x.alias(f"{n}_{h}") for x, n in zip(agreed(F.col(f"__given_{column}"), F.col(column)), ("ok", "diff"))]
        totals.append(F.count_if(F.col(f"__given_{column}").isNull()).alias(f"nan_{h}"))
        std = f"future_return_cs_std_{h}"
        if scaling == "cross_sectional_future_return" and std in wide.columns:
            totals += [x.alias(f"{n}_{h}") for x, n in zip(agreed(F.col(f"__given_{std}"), F.col(std)), ("std_ok", "std_diff"))]
        else:
            totals += [F.lit(None).cast("boolean").alias(f"std_ok_{h}"), F.lit(None).cast("double").alias(f"std_diff_{h}")]
    for i, (c, f, h) in enumerate(wanted):
        target, known = F.col(f"__given_{c}"), F.col(f"__given_{RETURN_COLUMNS[scaling].format(h)}").isNotNull()
        active = F.col(f"__given_{f}__signal_active") if f"{f}__signal_active" in wide.columns else F.lit(None).cast("double")
        totals.append(F.struct(F.count_if(target.isNull()).alias("target_nan_count"), F.count_if(target == 1).alias("target_positive_count"), F.count_if(target == 0).alias("target_zero_count"), F.avg(F.when(known, active)).alias("active_rate_on_available_returns")).alias(f"t_{i}"))
    one = again.agg(*totals)
    rows = [
        F.struct(
            F.lit(h).alias("horizon"), F.lit(labels[h]).alias("horizon_steps"), F.lit(f).alias("feature"), F.lit(RETURN_COLUMNS[scaling].format(h)).alias("future_return_col"), F.lit(c).alias("target_col"), F.col("n").alias("num_rows"), F.col("repeated").alias("num_duplicate_asset_datetime"),
            F.col(f"nan_{h}").alias("future_return_nan_count"), *[F.col(f"t_{i}.{x}").alias(x) for x in ("target_nan_count", "target_positive_count", "target_zero_count", "active_rate_on_available_returns")], F.lit(scaling).alias("target_scaling"),
            F.col(f"std_ok_{h}").alias("future_return_cs_std_alignment_ok"), F.col(f"std_diff_{h}").alias("future_return_cs_std_alignment_max_abs_diff"), F.col(f"ok_{h}").alias("future_return_alignment_ok"), F.col(f"diff_{h}").alias("future_return_alignment_max_abs_diff"),
        )
        for i, (c, f, h) in enumerate(wanted)
    ]
    out = one.select(F.inline(F.array(*rows)))
    if scaling != "cross_sectional_future_return":
        return out
    return out.join(F.broadcast(cross_section_report(future_returns(wide.select(*panel.keys, "close"), labels, panel, log=False), labels, panel, 1, min_assets, min_std)), "horizon")
