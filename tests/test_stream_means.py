"""Means over a stream against those of the whole table; restarts, late ticks and forgotten series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.recursive import ema, wilder
from tidemark.streaming.means import run_to_end, stream_means

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
WANTED = {"e": ("ema", 5), "w": ("wilder", 3)}
SCHEMA = "asset string, date timestamp, price double"


def ticks(asset, first, n, seed=0, every=60):
    r = np.random.default_rng(seed)
    return [(asset, START + dt.timedelta(seconds=every * (first + i)), None if r.random() < 0.2 else float(r.normal(100))) for i in range(n)]


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return stream_means(spark.readStream.schema(SCHEMA).parquet(f"{folder}/*"), WANTED, "10 minutes", 3_600_000)


def whole(rows):
    p = pd.DataFrame(rows, columns=["asset", "date", "price"]).sort_values(["asset", "date"])
    out = []
    for _, own in p.groupby("asset"):
        x = own["price"].astype(float).reset_index(drop=True)
        out.append(own.reset_index(drop=True).assign(e=ema(x, 5), w=wilder(x, 3)))
    return pd.concat(out)


def check(got, want):
    got = got.toPandas().sort_values(["asset", "date"]).reset_index(drop=True)
    want = want.sort_values(["asset", "date"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in ("e", "w"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12, atol=1e-12)


def test_batches_and_restarts_equal_the_whole(spark, tmp_path):
    source, place, rows = str(tmp_path / "in"), str(tmp_path / "out"), []
    for k in range(3):  # a new query each time, from the checkpoint of the last
        more = ticks("A", 40 * k, 40, k) + ticks("B", 40 * k, 40, 10 + k)
        put(spark, source, f"batch{k}", more)
        rows += more
        got = run_to_end(stream(spark, source), place)
    check(got, whole(rows))


def test_late_ticks_change_nothing(spark, tmp_path):
    source, place, rows = str(tmp_path / "in"), str(tmp_path / "out"), ticks("A", 0, 30)
    put(spark, source, "first", rows)
    run_to_end(stream(spark, source), place)
    put(spark, source, "late", [("A", START + dt.timedelta(seconds=60 * 28, milliseconds=1), 1e6)])
    run_to_end(stream(spark, source), place)
    more = ticks("A", 30, 20, 5)
    put(spark, source, "more", more)
    check(run_to_end(stream(spark, source), place), whole(rows + more))


def test_idle_series_begin_anew(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, "first", ticks("A", 0, 10) + ticks("B", 0, 10))
    run_to_end(stream(spark, source), place)
    for k in (1, 2):  # the watermark goes on with B, far beyond A
        put(spark, source, f"b{k}", ticks("B", 1000 * k, 10, k))
        run_to_end(stream(spark, source), place)
    again = ticks("A", 3000, 10, 9)
    put(spark, source, "again", again)
    got = run_to_end(stream(spark, source), place).where("asset = 'A'").orderBy("date").toPandas()
    want = whole(again)
    np.testing.assert_allclose(got["e"].iloc[10:].astype(float), want["e"].astype(float))
    assert pd.isna(got["e"].iloc[10])


def test_a_series_is_held_as_numbers_and_given_out_in_parts():
    """A batch that holds a whole series takes less than 100 bytes a tick; repeated and late times go."""
    import tracemalloc

    from tidemark.streaming.means import in_order

    n, size = 300_000, 10_000
    at = np.datetime64("2024-01-01", "us") + np.random.default_rng(3).permutation(n)

    def batches():
        for i in range(0, n, size):
            yield pd.DataFrame({"asset": [f"a{k}" for k in range(size)], "date": at[i : i + size], "price": np.arange(i, i + size, dtype=float)})

    tracemalloc.start()
    dates, prices = in_order(batches(), None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * n and (np.diff(dates) > np.timedelta64(0)).all() and (at[prices.astype(int)] == dates).all()
    twice = [pd.DataFrame({"asset": "A", "date": pd.to_datetime(["2024-01-02", "2024-01-01"]), "price": [1.0, 2.0]}), pd.DataFrame({"asset": "A", "date": pd.to_datetime(["2024-01-02", "2023-01-01"]), "price": [3.0, 4.0]})]
    dates, prices = in_order(iter(twice), pd.Timestamp("2023-06-01"))
    assert list(prices) == [2.0, 3.0] and len(in_order(iter([]), None)[0]) == 0
