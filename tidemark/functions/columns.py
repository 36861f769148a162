"""Which columns of a table play which part, from its names and types; nothing here reads rows, but for tables of families."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import Panel

log = logging.getLogger(__name__)

# fixed values: names by which keys are known
ASSET_NAMES = ("asset", "symbol", "ticker", "instrument")
DATE_NAMES = ("date", "datetime", "timestamp", "time")
FEATURE_NAMES = ("feature_name", "feature", "feature_col", "column", "indicator_name")
FAMILY_NAMES = ("signal_family", "family")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
SIGNAL_PARTS = ("signal_direction", "signal_active", "signal_strength", "signal_signed_value")


def first_of(names, wanted: str | None, candidates, what: str) -> str:
    """The wanted name if it is there, else the first candidate, whatever its case."""
    by_lower = {n.lower(): n for n in reversed(list(names))}
    if wanted is not None:
        if wanted not in names:
            raise ValueError(f"no column {wanted} for the {what}")
        return wanted
    found = next((by_lower[c] for c in candidates if c in by_lower), None)
    if found is None:
        raise ValueError(f"no column for the {what}; one of {', '.join(candidates)} is looked for")
    return found


def resolve_panel(df: DataFrame, asset: str | None = None, date: str | None = None, context: list[str] | None = None) -> Panel:
    """Keys of a table: asset and date by name, context from all other columns that are neither numbers nor times."""
    asset, date = first_of(df.columns, asset, ASSET_NAMES, "asset"), first_of(df.columns, date, DATE_NAMES, "date")
    if context is None:
        context = [n for n, t in df.dtypes if n not in (asset, date) and not n.startswith("__") and t not in NUMERIC and not t.startswith(("timestamp", "date", "decimal"))]
    missing = set(context) - set(df.columns)
    if missing:
        raise ValueError(f"no context columns {sorted(missing)}")
    return Panel(asset, date, tuple(context))


def signal_features(columns: list[str]) -> dict[str, list[str]]:
    """Features of a wide table that have signal columns, and which parts they have."""
    out: dict[str, list[str]] = {}
    for c in columns:
        for part in SIGNAL_PARTS:
            if c.endswith(f"__{part}"):
                out.setdefault(c[: -len(part) - 2], []).append(part)
    return out


def target_features(columns: list[str]) -> dict[str, tuple[str, str]]:
    """Target columns of a wide table: name to feature and horizon; the last separator counts."""
    return {c: (c.rpartition("__target_")[0], c.rpartition("__target_")[2]) for c in columns if "__target_" in c}


def horizon_order(found: list[str], asked=None) -> list[str]:
    """Horizons in the order asked for, else as found; one that is asked for but not there is an error."""
    if asked is None:
        return list(dict.fromkeys(found))
    missing = [h for h in asked if h not in found]
    if missing:
        raise ValueError(f"no targets for horizons {missing}")
    return list(asked)


def unknown_horizons(found: list[str], known: dict[str, int], strict: bool = False) -> list[str]:
    """Labels without a number of steps: told, or an error."""
    out = [h for h in dict.fromkeys(found) if h not in known]
    if out and strict:
        raise ValueError(f"no steps for horizons {out}")
    return out


def family_pairs(given, names: list[str]) -> list[tuple[str, str]]:
    """(feature, family) from a mapping, from pairs, or from a table (of Spark or pandas) whose columns are found by name; of a feature that it has more than once the last row counts."""
    columns = getattr(given, "columns", None)
    if columns is None:
        return list(given.items() if hasattr(given, "items") else given)
    feature, family = first_of(list(columns), None, FEATURE_NAMES, "feature"), first_of(list(columns), None, FAMILY_NAMES, "family")
    if isinstance(given, DataFrame):
        known = given.where(F.col(f"`{feature}`").isin(*names) & F.col(f"`{family}`").isNotNull())  # as many as columns at most, but for repeats
        placed = known.select(F.col(f"`{feature}`").alias("f"), F.col(f"`{family}`").alias("g"), F.monotonically_increasing_id().alias("at"))
        last = placed.groupBy("f").agg(F.max_by("g", "at").alias("g"))
        return [(r.f, r.g) for r in last.collect()]
    rows = given[[feature, family]].dropna()
    return list(zip(rows[feature].astype(str), rows[family].astype(str)))


def family_map(given, names: list[str], default: dict[str, str]) -> dict[str, str]:
    """Feature to family from a mapping, from rows (feature, family), from a table, or the default; what fits no column falls back to the default."""
    pairs = default if given is None else dict(family_pairs(given, names))
    out = {n: f for n, f in pairs.items() if n in names}
    if not out and given is not None:
        log.warning("the families given fit no column; those of the catalogue are taken")
    return out or {n: f for n, f in default.items() if n in names}


def first_columns(df: DataFrame) -> DataFrame:
    """df without repeated column names: the first of each stays."""
    seen, keep = set(), []
    for i, n in enumerate(df.columns):
        if n not in seen:
            keep.append(i)
        seen.add(n)
    named = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    return named.selectExpr(*[f"__{i} AS `{df.columns[i]}`" for i in keep])


def only_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])
