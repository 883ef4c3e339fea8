"""Searches: parameter grids and walk-forward windows as tables of runs.

A grid is one plan: each configuration's weights are a branch of it, and all
of them are folded to equity, ranked and compared at once.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SettingError
from ..functions.trading import label
from ..operators import metrics, signals
from ..sources import bars as bars_
from .tables import written
from .vector import VectorSettings, equity


def expand(grid: dict[str, list]) -> list[dict]:
    """All combinations of a grid's values, the last key changing fastest."""
    if any(not v for v in grid.values()):
        raise SettingError("a parameter has no values")
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def grid_table(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """(``cfg_idx``, the parameters, ``label``) by cross joins of the parameters' values."""
    table = spark.range(1).select(F.lit(0).cast("long").alias("cfg_idx"))
    for key, values in grid.items():
        one = spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["_i", key])
        table = table.crossJoin(F.broadcast(one)).withColumn("cfg_idx", F.col("cfg_idx") * len(values) + F.col("_i")).drop("_i")
    return table.withColumn("label", F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in grid]) if grid else F.lit("default"))


def history(name: str, configs: list[dict]) -> int:
    """Bars that the hungriest configuration needs."""
    return max(signals.STRATEGIES[name][2](c) for c in configs)


def run_grid(panel: DataFrame, name: str, configs: list[dict], settings: VectorSettings = VectorSettings(), start: int = 0, rebalance: str | None = None) -> DataFrame:
    """Equity of every configuration, with its index as ``run_id``. Panel and weights are written once, not derived for each configuration and use."""
    panel = written(panel)
    parts = [signals.established(signals.strategy(name, panel, rebalance, **c), start).withColumn("run_id", F.lit(i).cast("long")) for i, c in enumerate(configs)]
    weights = parts[0]
    for p in parts[1:]:
        weights = weights.unionByName(p)
    return written(equity(panel, written(weights.select("run_id", "pos", "sym_idx", "w")), settings, start))


def objective(sharpe):
    """A Sharpe ratio as a score: what is undefined never wins."""
    return F.when(sharpe.isNull() | F.isnan(sharpe), float("-inf")).otherwise(sharpe)


def ranked(curves: DataFrame, configs: list[dict], periods: float = metrics.YEAR) -> DataFrame:
    """One row a configuration, from the best Sharpe ratio down; equals stay in the grid's order."""
    spark = curves.sparkSession
    names = spark.createDataFrame([(i, label(c)) for i, c in enumerate(configs)], "run_id long, label string")
    table = metrics.summary(curves, periods).join(F.broadcast(names), "run_id")
    trades = curves.groupBy("run_id").agg(F.sum((F.col("traded") > 0).cast("long")).alias("n_rebalances"))
    scored = table.join(trades, "run_id").withColumn("objective", objective(F.col("sharpe")))
    return scored.select(F.row_number().over(W.orderBy(F.desc("objective"), "run_id")).alias("rank"), F.col("run_id").alias("cfg_idx"), "label", "objective", "sharpe", "cagr", "total_return", "max_drawdown", "n_rebalances")


def performance(curves: DataFrame) -> DataFrame:
    """(``cfg_idx``, ``t``, ``ret``) for the validation operators."""
    return metrics.returns(curves).select(F.col("run_id").alias("cfg_idx"), F.col("pos").alias("t"), F.col("r").alias("ret"))


def windows(n: int, train: int, test: int, step: int | None = None, start: int = 0, gap: int = 0, anchored: bool = False, partial: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(window, train start and end, test start and end), inclusive; tests don't overlap."""
    step = test if step is None else step
    if train < 2 or test < 1 or step < test or gap < 0 or start < 0:
        raise SettingError("windows need a training and a test length, and steps no shorter than tests")
    out, k = [], 0
    while True:
        first = start + k * step
        lo, hi = start if anchored else first, first + train - 1
        test_lo = hi + 1 + gap
        test_hi = test_lo + test - 1
        if test_lo >= n or (test_hi >= n and not partial):
            return out
        out.append((k, lo, hi, test_lo, min(test_hi, n - 1)))
        k += 1


def windows_table(spark: SparkSession, n: int, train: int, test: int, step: int | None = None, start: int = 0, gap: int = 0, anchored: bool = False) -> DataFrame:
    """The same windows in closed form over a range."""
    step = test if step is None else step
    k = F.col("id")
    first = F.lit(start) + k * step
    lo = F.lit(start).cast("long") if anchored else first
    hi = first + (train - 1)
    test_lo = hi + (1 + gap)
    most = max(0, math.ceil((n - start - train - gap) / step))
    return spark.range(most).select(k.alias("window"), lo.alias("train_start"), hi.alias("train_end"), test_lo.alias("test_start"), F.least(test_lo + (test - 1), F.lit(n - 1)).alias("test_end")).filter(F.col("test_start") < n)


def walk_forward(bars: DataFrame, name: str, grid: dict[str, list], train: int, test: int, settings: VectorSettings = VectorSettings(), rebalance: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(windows, returns): in each window the configuration that was best in training, and its stitched test returns.

    What a window is fitted on is a slice of the bars up to its training end,
    so later bars can't be seen. Tests start flat.
    """
    spark, n, configs = bars.sparkSession, bars_.calendar(bars).count(), expand(grid)
    chosen, tests = [], []
    for k, lo, hi, test_lo, test_hi in windows(n, train, test, **how):
        fit = run_grid(bars_.panel(bars_.sliced(bars, 0, hi + 1)), name, configs, settings, lo, rebalance)
        best = ranked(fit, configs).filter("rank = 1").first()
        params = configs[best.cfg_idx]
        curve = run_grid(bars_.panel(bars_.sliced(bars, 0, test_hi + 1)), name, [params], settings, test_lo, rebalance)
        out = metrics.returns(curve, settings.cash).select(F.lit(k).cast("long").alias("run_id"), "pos", "ts", "r")
        tests.append(written(out))
        chosen.append((k, lo, hi, test_lo, test_hi, best.label, float(best.objective)))
    if not tests:
        raise SettingError("no window fits")
    stitched = tests[0]
    for part in tests[1:]:
        stitched = stitched.unionByName(part)
    table = spark.createDataFrame(chosen, "window long, train_start long, train_end long, test_start long, test_end long, label string, is_objective double")
    oos = stitched.groupBy(F.col("run_id").alias("window")).agg(metrics.sharpe(F.col("r")).alias("oos_sharpe"), (F.product(1 + F.col("r")) - 1).alias("oos_return"))
    return table.join(oos, "window", "left"), stitched


def stitched_equity(returns: DataFrame, cash: float) -> DataFrame:
    """Test returns compounded to one curve, in the order of positions."""
    back = W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)  # one row a bar: the calendar
    return returns.select("pos", "ts", (cash * F.product(1 + F.col("r")).over(back)).alias("equity"))


def efficiency(table: DataFrame, returns: DataFrame, periods: float = metrics.YEAR) -> DataFrame:
    """Out-of-sample Sharpe ratio, the mean one in training, and their quotient."""
    own = returns.agg(metrics.sharpe(F.col("r"), periods=periods).alias("oos_sharpe"))
    return table.agg(F.avg(F.when(F.abs("is_objective") < float("inf"), F.col("is_objective"))).alias("mean_is_sharpe")).crossJoin(own).withColumn("efficiency", F.try_divide("oos_sharpe", "mean_is_sharpe"))
