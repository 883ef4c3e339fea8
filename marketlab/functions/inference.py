"""Inference on Sharpe ratios: closed forms as columns, and the normal distribution on small results."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAMMA = 0.5772156649015329  # Euler's constant
NORMAL = NormalDist()


def moments(returns: DataFrame) -> DataFrame:
    """Per run: ``n``, per-period ``sr``, population ``skew`` and raw ``kurt``; null below three returns or without spread."""
    sd = F.stddev_samp("r")
    fine = (F.count("r") >= 3) & (sd > 0)
    return returns.groupBy("run_id").agg(
        F.count("r").alias("n"), F.when(fine, F.avg("r") / sd).alias("sr"), F.when(fine, F.skewness("r")).alias("skew"), F.when(fine, F.kurtosis("r") + 3).alias("kurt"),
    )


def _factor(sr: Column, skew: Column, kurt: Column) -> Column:
    return 1 - skew * sr + (kurt - 1) / 4 * sr * sr


def standard_error(sr: Column, n: Column, skew: Column, kurt: Column) -> Column:
    factor = _factor(sr, skew, kurt)
    return F.when((factor > 0) & (n > 1), F.sqrt(factor / (n - 1)))


def track_record(sr: Column, skew: Column, kurt: Column, target: float = 0.0, confidence: float = 0.95) -> Column:
    """The least number of returns at which ``sr`` is above ``target`` with ``confidence``; infinite if it isn't above."""
    z = NORMAL.inv_cdf(confidence)
    return F.when(sr <= target, float("inf")).otherwise(1 + _factor(sr, skew, kurt) * F.pow(z / (sr - target), 2))


def expected_maximum(n_trials: int, variance: float) -> float:
    """The expected best Sharpe ratio of ``n_trials`` without skill."""
    if n_trials <= 1 or not variance > 0:
        return 0.0
    return math.sqrt(variance) * ((1 - GAMMA) * NORMAL.inv_cdf(1 - 1 / n_trials) + GAMMA * NORMAL.inv_cdf(1 - 1 / (n_trials * math.e)))


def probability(sr: float, n: int, skew: float, kurt: float, target: float = 0.0) -> float:
    """The probability that the true Sharpe ratio is above ``target``."""
    factor = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    if not factor > 0 or n < 2:
        return math.nan
    return NORMAL.cdf((sr - target) / math.sqrt(factor / (n - 1)))


def probabilities(moments_: DataFrame, target: float = 0.0, trials: bool = True) -> DataFrame:
    """Moments with ``psr`` and, against the best expected of all rows, the deflated ``dsr``. One row a run, through Arrow."""
    spread = moments_.agg(F.count("sr").alias("n"), F.var_samp("sr").alias("v")).first() if trials else None
    best = expected_maximum(int(spread.n), float(spread.v or 0.0)) if spread else 0.0

    def run(batches):
        for pdf in batches:
            rows = list(pdf.itertuples(index=False))
            pdf = pdf.assign(
                psr=[probability(r.sr, r.n, r.skew, r.kurt, target) for r in rows],
                dsr=[probability(r.sr, r.n, r.skew, r.kurt, best) for r in rows],
            )
            yield pdf

    return moments_.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in moments_.schema)}, psr double, dsr double")
