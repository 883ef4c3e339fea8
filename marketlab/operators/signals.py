"""Strategies as plans: from a panel to target weights.

``desired`` weights are (``pos``, ``ts``, ``sym_idx``, ``symbol``, ``w``) with
null where there is no signal yet. ``scheduled`` keeps the rows at which a
rebalance is due. All windows are by symbol or by time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .allocation import allocated

YEAR = 252.0


def _by_symbol(*more: str):
    return W.partitionBy(*more, "symbol").orderBy("pos")


def rolling(column: Column, n: int, how, keys: tuple[str, ...] = ()) -> Column:
    """``how`` over the last ``n`` rows of a symbol; null until there are ``n`` values."""
    frame = _by_symbol(*keys).rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, how(column).over(frame))


def _weights(panel: DataFrame, w: Column) -> DataFrame:
    return panel.select("pos", "ts", "sym_idx", "symbol", w.cast("double").alias("w"))


def _size() -> Column:
    """How many symbols there are at a row's time: the panel is dense."""
    return F.count("*").over(W.partitionBy("pos"))


def sma_crossover(panel: DataFrame, fast: int = 50, slow: int = 200, allow_short: bool = False) -> DataFrame:
    """1/N long while the fast mean is above the slow one, short (or flat) below; flat until both are full."""
    close = F.col("last_close")
    known = panel.withColumns({"fast": rolling(close, fast, F.avg), "slow": rolling(close, slow, F.avg), "n": _size()})
    up, down = F.coalesce(F.col("fast") > F.col("slow"), F.lit(False)), F.coalesce(F.col("fast") < F.col("slow"), F.lit(False))
    side = F.when(up, 1.0).when(down & F.lit(allow_short), -1.0).otherwise(0.0)
    started = F.col("pos") >= max(fast, slow) - 1
    return _weights(known, F.when(started, side / F.col("n")))


def time_series_momentum(panel: DataFrame, lookback: int = 252, vol_lookback: int = 63, target_vol: float = 0.15, max_weight: float = 1.0, max_gross: float = 2.0, allow_short: bool = True) -> DataFrame:
    """The sign of the past return, at a size that brings a symbol to the target volatility; the sum is scaled to ``max_gross``."""
    past = F.lag("last_close", lookback).over(_by_symbol())
    step = panel.withColumns({"past": past, "log_return": F.log(F.col("last_close") / F.lag("last_close").over(_by_symbol())), "n": _size()})
    vol = step.withColumn("vol", rolling(F.col("log_return"), vol_lookback, F.stddev_samp) * math.sqrt(YEAR))
    side = F.signum(F.col("last_close") / F.col("past") - 1)
    side = side if allow_short else F.greatest(side, F.lit(0.0))
    raw = side * F.least(F.try_divide(F.lit(target_vol), F.col("vol")), F.col("n") * F.lit(max_weight)) / F.col("n")
    raw = F.when(F.col("vol").isNotNull(), raw)
    sized = vol.withColumn("raw", F.coalesce(raw, F.lit(0.0)))
    sized = sized.withColumn("gross", F.sum(F.abs("raw")).over(W.partitionBy("pos")))
    w = F.when(F.col("gross") > max_gross, F.col("raw") * max_gross / F.col("gross")).otherwise(F.col("raw"))
    return _weights(sized, F.when(F.col("pos") >= max(lookback, vol_lookback), w))


def cross_sectional_momentum(panel: DataFrame, lookback: int = 126, skip: int = 21, top_k: int = 2, long_short: bool = False) -> DataFrame:
    """Equal weights for the ``top_k`` symbols with the best past return (and short the worst), leaving out the last ``skip`` bars."""
    own = _by_symbol()
    score = panel.withColumn("score", F.lag("last_close", skip).over(own) / F.lag("last_close", lookback).over(own) - 1)
    day = W.partitionBy("pos")
    ranked = score.withColumns({
        "best": F.row_number().over(day.orderBy(F.desc_nulls_last("score"), "sym_idx")),
        "worst": F.row_number().over(day.orderBy(F.asc_nulls_last("score"), "sym_idx")),
        "valid": F.count("score").over(day),
    })
    k = F.least(F.lit(top_k), F.floor(F.col("valid") / 2) if long_short else F.col("valid"))
    long = F.col("score").isNotNull() & (F.col("best") <= k)
    short = F.col("score").isNotNull() & (F.col("worst") <= k) & F.lit(long_short)
    w = F.when(short, -1.0 / top_k).when(long, 1.0 / top_k).otherwise(0.0)
    return _weights(ranked, F.when(F.col("pos") >= lookback, w))


def bollinger_reversion(panel: DataFrame, window: int = 20, n_std: float = 2.0, allow_short: bool = True) -> DataFrame:
    """Long from a close below the lower band until the mean is reached; short likewise above. The last mark set is carried on."""
    close = F.col("last_close")
    bands = panel.withColumns({"mean": rolling(close, window, F.avg), "std": rolling(close, window, F.stddev_samp), "n": _size()})
    low, high = F.col("mean") - n_std * F.col("std"), F.col("mean") + n_std * F.col("std")
    marks = bands.withColumns({
        "long_mark": F.when(close < low, 1.0).when(close >= F.col("mean"), 0.0),
        "short_mark": F.when(close > high, -1.0).when(close <= F.col("mean"), 0.0),
    })
    back = _by_symbol().rowsBetween(W.unboundedPreceding, 0)
    held = lambda name: F.coalesce(F.last(name, ignorenulls=True).over(back), F.lit(0.0))
    side = held("long_mark") + (held("short_mark") if allow_short else F.lit(0.0))
    return _weights(marks, F.when(F.col("pos") >= window - 1, side / F.col("n")))


def inverse_volatility(panel: DataFrame, lookback: int = 252) -> DataFrame:
    """Weights in proportion to one over each symbol's volatility of the last ``lookback`` returns."""
    step = panel.withColumn("r", F.col("last_close") / F.lag("last_close").over(_by_symbol()) - 1)
    vol = step.withColumn("inverse", F.try_divide(F.lit(1.0), rolling(F.col("r"), lookback, F.stddev_samp)))
    total = F.sum("inverse").over(W.partitionBy("pos"))
    return _weights(vol, F.when(F.col("pos") >= lookback, F.coalesce(F.col("inverse") / total, F.lit(0.0))))


def equal_weight(panel: DataFrame, lookback: int = 1) -> DataFrame:
    """1/N for symbols that have a price throughout the last ``lookback`` bars."""
    whole = panel.withColumn("ready", F.coalesce(rolling(F.col("last_close"), lookback, F.count) > 0, F.lit(False)).cast("double"))
    total = F.sum("ready").over(W.partitionBy("pos"))
    return _weights(whole, F.when(F.col("pos") >= lookback - 1, F.coalesce(F.try_divide(F.col("ready"), total), F.lit(0.0))))


def scheduled(desired: DataFrame, rebalance: str) -> DataFrame:
    """The rows of ``desired`` at which a rebalance is due.

    A time is valid if all symbols have a weight. "daily" takes all valid times,
    "monthly" the first of each month, "change" those at which a weight differs
    from the time before; the first valid time is always due.
    """
    wide = desired.groupBy("pos", "ts").agg(F.array_sort(F.collect_list(F.struct("sym_idx", "w"))).alias("rows"), F.bool_and(F.col("w").isNotNull()).alias("valid"))
    line = W.orderBy("pos")  # one row a time: the calendar
    marked = wide.select(
        "pos", "ts", "valid", F.transform("rows", lambda r: r["w"]).alias("ws"), F.lag(F.transform("rows", lambda r: r["w"])).over(line).alias("before"), F.lag("ts").over(line).alias("ts_before"),
        F.min(F.when(F.col("valid"), F.col("pos"))).over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("first"),
    )
    first = F.col("pos") == F.col("first")
    if rebalance == "daily":
        due = F.lit(True)
    elif rebalance == "monthly":
        due = first | F.coalesce(F.trunc("ts", "MM") != F.trunc("ts_before", "MM"), F.lit(False))
    elif rebalance == "change":
        due = first | ~F.coalesce(F.col("ws") == F.col("before"), F.col("pos") == 0)
    else:
        raise ValueError(f"unknown schedule {rebalance!r}")
    times = marked.filter(F.col("valid") & due).select("pos")
    return desired.join(F.broadcast(times), "pos", "left_semi").select(*desired.columns)


def established(weights: DataFrame, start: int) -> DataFrame:
    """Scheduled weights from ``start`` on; if none is due at ``start``, the last ones due before are taken there."""
    latest = weights.filter(F.col("pos") <= start).agg(F.max("pos").alias("latest"))
    carried = weights.join(F.broadcast(latest), F.col("pos") == F.col("latest"), "left_semi").withColumn("pos", F.lit(start).cast("long"))
    return carried.unionByName(weights.filter(F.col("pos") > start))


#: name -> (plan, default schedule, bars of history that its parameters need)
STRATEGIES = {
    "sma_crossover": (sma_crossover, "change", lambda p: max(p.get("fast", 50), p.get("slow", 200))),
    "tsmom": (time_series_momentum, "monthly", lambda p: max(p.get("lookback", 252), p.get("vol_lookback", 63)) + 1),
    "xsmom": (cross_sectional_momentum, "monthly", lambda p: p.get("lookback", 126) + 1),
    "bollinger": (bollinger_reversion, "change", lambda p: p.get("window", 20)),
    "inverse_volatility": (inverse_volatility, "monthly", lambda p: p.get("lookback", 252) + 1),
    "allocation": (allocated, "monthly", lambda p: p.get("lookback", 252) + 1),
    "equal_weight": (equal_weight, "monthly", lambda p: p.get("lookback", 1)),
}


def strategy(name: str, panel: DataFrame, rebalance: str | None = None, **params) -> DataFrame:
    """The scheduled weights of a strategy by name."""
    plan, default, _ = STRATEGIES[name]
    return scheduled(plan(panel, **params), rebalance or default)
