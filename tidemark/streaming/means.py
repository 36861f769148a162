"""Recursive means over a stream of ticks, with the state of each series between batches.

The state of a series is, for each mean, its value, how many ticks it has seen and how long ago the last price came (a tick
without a price carries the mean on, as in recursive.py), and the time of the last tick. Ticks of a batch are taken in
order of time; one that is not later than the last tick of its series comes too late and has no effect (its row is not
given out). A series that has had no tick until the watermark has passed its last one by ``idle`` is forgotten, and begins
anew if it comes back. What is given out for a stream up to its end are the means of the whole table.

Of a batch's ticks a task holds the times and prices of one series, as numbers (some 40 bytes a tick while they are put in
order); tables are made of CHUNK of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Ticks of a series that are given out as one table.
CHUNK = 65_536


def in_order(batches: Iterator[pd.DataFrame], after) -> tuple[np.ndarray, np.ndarray]:
    """Times and prices of ticks later than a time (None: all), by time; of a repeated time the last."""
    dates, prices = [], []
    for b in batches:
        if after is not None:
            b = b[b["date"] > after]
        if len(b):
            dates.append(b["date"].to_numpy("datetime64[us]"))
            prices.append(b["price"].to_numpy(float))
    if not dates:
        return np.empty(0, "datetime64[us]"), np.empty(0)
    date = np.concatenate(dates)
    dates.clear()
    price = np.concatenate(prices)
    prices.clear()
    order = np.argsort(date, kind="stable")
    date, price = date[order], price[order]
    del order
    last = np.append(date[1:] != date[:-1], True)
    return (date, price) if last.all() else (date[last], price[last])


def carried(prices: np.ndarray, share: float, least: int, mean: float, seen: int, gap: int) -> tuple[np.ndarray, float, int, int]:
    """The means after each price, and the state after the last; a mean is shown once as many prices as it spans have been seen."""
    out = np.full(len(prices), np.nan)
    for i, x in enumerate(prices):
        if x == x:
            old = (1 - share) ** (gap + 1)
            mean = x if not seen else (old * mean + share * x) / (old + share)
            seen, gap = seen + 1, 0
        else:
            gap += 1
        if seen >= least:
            out[i] = mean
    return out, mean, seen, gap


def stream_means(ticks: DataFrame, wanted: dict[str, tuple[str, int]], late: str = "1 hour", idle_ms: int = 24 * 3_600_000, asset: str = "asset", date: str = "date", price: str = "price") -> DataFrame:
    """asset, date, price and a column for each mean wanted: name to ("ema" or "wilder", span). date is a timestamp."""
    kinds = {n: (2 / (m + 1) if kind == "ema" else 1 / m, m) for n, (kind, m) in wanted.items()}
    rows = ticks.select(F.col(asset).alias("asset"), F.col(date).alias("date"), F.col(price).cast("double").alias("price")).withWatermark("date", late)
    shown = "asset string, date timestamp, price double, " + ", ".join(f"{n} double" for n in kinds)
    held = "last timestamp, " + ", ".join(f"m{i} double, s{i} long, g{i} long" for i in range(len(kinds)))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, *own = state.get if state.exists else (None, *[0.0, 0, 0] * len(kinds))
        dates, prices = in_order(batches, None if last is None else pd.Timestamp(last))
        for at in range(0, len(dates), CHUNK):
            x, p = prices[at : at + CHUNK], {}
            for i, (name, (share, least)) in enumerate(kinds.items()):
                p[name], *own[3 * i : 3 * i + 3] = carried(x, share, least, *own[3 * i : 3 * i + 3])
            yield pd.DataFrame({"asset": key[0], "date": dates[at : at + CHUNK], "price": x} | p)
        if len(dates):
            last = pd.Timestamp(dates[-1]).to_pydatetime()
            state.update((last, *[f(x) for x, f in zip(own, [float, int, int] * len(kinds))]))
        if last is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)

    return rows.groupBy("asset").applyInPandasWithState(step, shown, held, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Run an appending stream over what there is, its rows below path; to be called again with the same path when more has come."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
