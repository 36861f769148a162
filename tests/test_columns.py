import pytest

from tidemark.config import INDICATOR_DEFAULTS, merged, token
from tidemark.functions import columns as C


def test_names_and_types(spark):
    df = spark.createDataFrame([], "Symbol string, date timestamp_ntz, timeframe string, close double, __x string")
    p = C.resolve_panel(df)
    assert (p.asset, p.date, p.context) == ("Symbol", "date", ("timeframe",))
    with pytest.raises(ValueError):
        C.resolve_panel(df, asset="nope")
    with pytest.raises(ValueError):
        C.resolve_panel(df.drop("date"))
    both = df.selectExpr("close", "timeframe", "1.0D AS close")
    assert C.first_columns(both).columns == ["close", "timeframe"]
    assert C.only_present(df, ["b", "close"]).columns == ["close"]


def test_discovery():
    names = ["a__signal_direction", "a__signal_active", "a__target_1d", "b__target_x__target_4d", "c"]
    assert C.signal_features(names) == {"a": ["signal_direction", "signal_active"]}
    assert C.target_features(names) == {"a__target_1d": ("a", "1d"), "b__target_x__target_4d": ("b__target_x", "4d")}
    assert C.horizon_order(["4d", "1d", "4d"]) == ["4d", "1d"]
    assert C.unknown_horizons(["1d", "9d"], {"1d": 1}) == ["9d"]
    for bad in (lambda: C.horizon_order(["1d"], ["2d"]), lambda: C.unknown_horizons(["9d"], {}, strict=True)):
        with pytest.raises(ValueError):
            bad()
    assert C.family_map([("a", "f")], ["a"], {}) == {"a": "f"}
    assert C.family_map({"z": "f"}, ["a"], {"a": "d"}) == {"a": "d"}


def test_config():
    c = merged(INDICATOR_DEFAULTS, {"roc": {"window": 3}})
    assert c["roc"] == {"window": 3} and INDICATOR_DEFAULTS["roc"] == {"window": 10}
    assert [token(x) for x in (2.0, 0.85, -1)] == ["2", "0p85", "neg1"]


def test_families_as_tables(spark):
    import pandas as pd

    rows = [("a", "f"), ("b", None), ("a", "g"), ("elsewhere", "h")]
    table = spark.createDataFrame(rows, "`Indicator_Name` string, signal_family string").coalesce(1)
    assert C.family_map(table, ["a", "b"], {"b": "d"}) == {"a": "g"}
    assert C.family_map(pd.DataFrame(rows, columns=["feature", "family"]), ["a", "b"], {}) == {"a": "g"}
    assert C.family_map(table, ["z"], {"z": "d"}) == {"z": "d"}
    try:
        C.family_map(table.select("signal_family"), ["a"], {})
    except ValueError:
        return
    raise AssertionError("a table without features")
