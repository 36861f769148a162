"""The regression dataset: one row a date, asset, indicator and horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import Panel
from .indicators import catalogue
from .signals import add_signals
from .targets import HORIZONS, cross_scaled_returns, normalize_horizons, targets_long


def context_features(panel: Panel, columns: list[str], exclude_vix: bool = True) -> list[str]:
    cat = catalogue(panel)
    names = [n for k, f in cat.families.items() if f == "context_filter" for n in cat.columns[k] if n in columns]
    return list(dict.fromkeys(n for n in names if not (exclude_vix and "vix" in n.lower())))


def infer_context(df: DataFrame, reserved: set[str]) -> list[str]:
    """Numeric columns of a long table that are neither keys, signals, targets nor predictions."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    bad = ("__signal_", "__target_", "future_return")
    return [n for n, t in df.dtypes if t in kinds and n not in reserved and not n.startswith(("pred_", "rank_", "__")) and not any(b in n for b in bad)]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def regression_dataset(features: DataFrame, panel: Panel = Panel(), horizons=HORIZONS, tau: float = 0.0, include_inactive: bool = False, drop_missing: bool = True, exclude_vix: bool = True, signal_config: dict | None = None, check: bool | DataFrame = True) -> DataFrame:
    """Returns, signals, targets and context features in one pass: everything travels on the feature row. check may be the panel that features were computed from: its keys are looked through instead, which costs less."""
    if check is not False and not duplicate_keys(features if check is True else check, panel.keys).isEmpty():
        raise ValueError("repeated keys")
    labels = normalize_horizons(horizons)
    context = context_features(panel, features.columns, exclude_vix)
    scaled = cross_scaled_returns(features, horizons, panel)
    returns = [f"future_return_cs_scaled_{x}" for x in labels]
    long = targets_long(add_signals(scaled, panel, signal_config, carry=[*returns, *context]), horizons, tau)
    if not include_inactive:
        long = long.where("signal_active = 1")
    if drop_missing:
        long = long.where("target IS NOT NULL")
    parts = ["signal_direction", "signal_active", "signal_strength", "signal_signed_value"]
    return long.select(panel.date, panel.asset, *panel.context, "indicator_name", "signal_family", "horizon", *parts, "target", *context)


def dataset_summary(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """One row of counts, as the validator reports them."""
    keys = [panel.date, panel.asset, "indicator_name", "horizon"]
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("signal_active") == 1).alias("active"), F.count_if(F.col("target").isNull()).alias("missing"), F.sum("target").alias("hits"), F.count("target").alias("known"))
    return each.agg(
        F.sum("n").alias("n_rows"), F.countDistinct(panel.date).alias("n_dates"), F.countDistinct(panel.asset).alias("n_assets"), F.countDistinct("indicator_name").alias("n_indicators"), F.countDistinct("horizon").alias("n_horizons"),
        F.sum("active").alias("n_active"), F.sum("missing").alias("n_missing_target"), (F.sum("hits") / F.nullif(F.sum("known"), F.lit(0))).alias("target_rate"), F.count_if(F.col("n") > 1).alias("n_duplicate_keys"),
    )


def validate_dataset(df: DataFrame, panel: Panel = Panel()) -> dict:
    out = dataset_summary(df, panel).first().asDict()
    if out["n_duplicate_keys"]:
        raise ValueError(f"{out['n_duplicate_keys']} repeated keys")
    return out
