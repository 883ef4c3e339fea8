"""Bars and trading from streams of ticks.

Ticks become bars by windows with a watermark, the same aggregates as in
``sources.bars``. Paper trading keeps, for each run, its account as state, and
answers each bar with the target that a mean of recent closes gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EQUITY = "run_id string, ts timestamp, symbol string, close double, quantity double, cash double, equity double"
STATE = "closes array<double>, quantity double, cash double, target int"


def bars(ticks: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of a stream of (``symbol``, ``ts``, ``price``, ``size``, ``seq``); later ticks than ``late`` are left out."""
    at = F.struct("ts", "seq")
    done = ticks.withWatermark("ts", late).groupBy(F.window("ts", every), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"),
    )
    return done.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def paper(bars_: DataFrame, n: int = 5, cash: float = 1_000_000.0) -> DataFrame:
    """A symbol's account over a stream of bars: long while the close is above the mean of the last ``n``, trading at the next open."""

    def step(key, frames, state):
        import pandas as pd

        closes, quantity, money, target = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0.0, cash, 0)
        out = []
        for frame in frames:
            for b in frame.sort_values("ts").itertuples(index=False):
                if target == 1 and quantity == 0:
                    quantity, money = money / b.open, 0.0
                elif target == 0 and quantity:
                    quantity, money = 0.0, money + quantity * b.open
                closes = [*closes, b.close][-n:]
                target = int(len(closes) == n and b.close > sum(closes) / n)
                out.append((key[0], b.ts, key[0], b.close, quantity, money, money + quantity * b.close))
        state.update((closes, quantity, money, target))
        yield pd.DataFrame(out, columns=["run_id", "ts", "symbol", "close", "quantity", "cash", "equity"])

    return bars_.groupBy("symbol").applyInPandasWithState(step, EQUITY, STATE, "append", "NoTimeout")


def ticks_of(events: DataFrame) -> DataFrame:
    """Ticks of the ``events`` table."""
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))
