"""Wide tables of signals and targets: single targets, long rows, and the regression dataset from a wide table.

A feature's signal columns are <feature>__signal_direction and so on, its targets <feature>__target_<horizon>. Columns
become rows in one projection; nothing is joined.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SIGNAL_PARTS, family_map, first_columns, horizon_order, only_present, resolve_panel, signal_features, target_features
from ..functions.windows import Panel
from .dataset import context_features, duplicate_keys, infer_context
from .signals import default_families
from .targets import HORIZONS, RETURN_COLUMNS, binary_target, normalize_horizons

log = logging.getLogger(__name__)


def add_target(wide: DataFrame, feature: str, horizon: str, name: str | None = None, tau: float = 0.1, inactive: str = "nan", scaling: str = "cross_sectional_future_return") -> DataFrame:
    """wide with the binary target of one signal and horizon, by default as <feature>__target_<horizon>."""
    target = binary_target(f"{feature}__signal_direction", f"{feature}__signal_active", RETURN_COLUMNS[scaling].format(horizon), tau, inactive)
    return wide.withColumn(name or f"{feature}__target_{horizon}", target)


def add_targets(wide: DataFrame, horizons=HORIZONS, features: list[str] | None = None, tau: float = 0.1, inactive: str = "nan", scaling: str = "cross_sectional_future_return") -> DataFrame:
    """wide with the targets of all its signals, or of those named, and horizons."""
    found = signal_features(wide.columns)
    chosen = [f for f in found if {"signal_direction", "signal_active"} <= set(found[f])] if features is None else features
    returns = RETURN_COLUMNS[scaling]
    made = {f"{f}__target_{h}": binary_target(f"{f}__signal_direction", f"{f}__signal_active", returns.format(h), tau, inactive) for f in chosen for h in normalize_horizons(horizons)}
    return wide.withColumns(made)


def _parts(feature: str, columns: list[str]) -> list:
    return [(F.col(f"`{feature}__{p}`") if f"{feature}__{p}" in columns else F.lit(None)).cast("double").alias(p) for p in SIGNAL_PARTS]


def signals_to_long(wide: DataFrame, panel: Panel = Panel(), features: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Keys, carried columns, indicator_name and the four parts of each feature's signal; a part that isn't there is null."""
    features = list(signal_features(wide.columns)) if features is None else features
    if not features:
        raise ValueError("no signal column")
    rows = [F.struct(F.lit(f).alias("indicator_name"), *_parts(f, wide.columns)) for f in features]
    return wide.select(*panel.keys, *(carry or []), F.inline(F.array(*rows)))


def targets_to_long(wide: DataFrame, panel: Panel = Panel(), horizons: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Keys, carried columns, indicator_name, horizon and target of each target column."""
    found = target_features(wide.columns)
    order = horizon_order([h for _, h in found.values()], horizons)
    rows = [F.struct(F.lit(f).alias("indicator_name"), F.lit(h).alias("horizon"), F.col(f"`{c}`").cast("double").alias("target")) for h in order for c, (f, own) in found.items() if own == h]
    if not rows:
        raise ValueError("no target column")
    return wide.select(*panel.keys, *(carry or []), F.inline(F.array(*rows)))


def dataset_order(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Sorted for presentation: date, asset, context, indicator, horizon."""
    return df.orderBy(panel.date, panel.asset, *panel.context, "indicator_name", "horizon")


def wide_dataset(wide: DataFrame, families=None, horizons: list[str] | None = None, panel: Panel | None = None, context: list[str] | None = None, include_inactive: bool = False, drop_missing: bool = True, check: bool = True) -> DataFrame:
    """The regression dataset of a wide table: a row a key, feature and horizon that has a target.

    Repeated keys, no signals, no targets, a missing horizon or a feature without family are errors; features without
    targets are left out with a warning. Keys are found by name where panel isn't given, context features by the catalogue
    where context isn't; of columns with one name the first counts.
    """
    wide = first_columns(wide)
    panel = resolve_panel(wide) if panel is None else panel
    if check and not duplicate_keys(wide.select(*panel.keys), panel.keys).isEmpty():
        raise ValueError("repeated keys")
    found = target_features(wide.columns)
    order = horizon_order([h for _, h in found.values()], horizons)
    aimed = {f for f, h in found.values() if h in order}
    features = list(signal_features(wide.columns))
    if not features or not found:
        raise ValueError("no signal column" if not features else "no target column")
    idle = [f for f in features if f not in aimed]
    if idle:
        log.warning("signals without targets are left out: %s", ", ".join(idle))
    features = [f for f in features if f in aimed]
    of = family_map(families, features, default_families())
    if missing := [f for f in features if f not in of]:
        raise ValueError(f"no family for {', '.join(missing)}")
    context = context_features(panel, wide.columns) if context is None else context
    each = [
        F.struct(F.lit(f).alias("indicator_name"), F.lit(of[f]).alias("signal_family"), F.lit(h).alias("horizon"), *_parts(f, wide.columns), F.col(f"`{f}__target_{h}`").cast("double").alias("target"))
        for h in order for f in features if f"{f}__target_{h}" in found
    ]
    long = wide.select(*panel.keys, *context, F.inline(F.array(*each)))
    if not include_inactive:
        long = long.where("signal_active = 1")
    if drop_missing:
        long = long.where("target IS NOT NULL")
    return only_present(long, [panel.date, panel.asset, *panel.context, "indicator_name", "signal_family", "horizon", *SIGNAL_PARTS, "target", *context])


def dataset_context(df: DataFrame, panel: Panel = Panel()) -> list[str]:
    """Context features of a long dataset: its other numbers."""
    return infer_context(df, {*panel.keys, "indicator_name", "signal_family", "horizon", "target", *SIGNAL_PARTS})


def write_dataset(df: DataFrame, path: str, by: tuple[str, ...] = ("horizon",), mode: str = "errorifexists") -> None:
    """Parquet with one folder a value of by (horizon, timeframe), so that readers of one horizon read only that."""
    df.write.mode(mode).partitionBy(*[c for c in by if c in df.columns]).parquet(path)
