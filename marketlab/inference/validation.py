"""How far to trust a backtest, or the best of a family of them.

Both compose the operators of this package. What is collected are results of
one row a run, statistic or path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SettingError
from ..functions import inference
from ..operators.metrics import YEAR, sharpe
from . import crossval, overfitting, resampling


@dataclass(frozen=True)
class StrategyValidation:
    """One run: Sharpe inference (of one trial or more) and bootstrap intervals by statistic."""

    n: int
    sharpe: float
    psr: float
    dsr: float
    track_record: float
    trials: int
    intervals: dict[str, tuple[float, float, float]]

    def format(self) -> str:
        lines = [f"{self.n} returns, Sharpe ratio {self.sharpe:.2f}", f"probability of skill {self.psr:.3f}, deflated for {self.trials} trials {self.dsr:.3f}", f"returns needed {self.track_record:.0f}"]
        return "\n".join(lines + [f"{k:<14}{e:>10.4f}  [{lo:.4f}, {hi:.4f}]" for k, (e, lo, hi) in sorted(self.intervals.items())])


@dataclass(frozen=True)
class FamilyValidation:
    """A family of configurations: its best one, and how much of that is selection."""

    best: int
    sharpe: float
    dsr: float
    splits: int
    pbo: float
    prob_loss: float
    spa: dict[str, float]
    path_sharpes: tuple[float, ...]

    def format(self) -> str:
        p = self.path_sharpes
        return "\n".join([
            f"best configuration {self.best}, Sharpe ratio {self.sharpe:.2f}, deflated probability of skill {self.dsr:.3f}",
            f"probability of overfitting {self.pbo:.3f} over {self.splits} blocks, of a loss {self.prob_loss:.3f}",
            f"reality check p {self.spa['rc_pvalue']:.3f}, SPA p {self.spa['p_consistent']:.3f} [{self.spa['p_lower']:.3f}, {self.spa['p_upper']:.3f}]",
            f"cross-validated Sharpe ratios of {len(p)} paths: mean {np.mean(p):.2f}, from {min(p):.2f} to {max(p):.2f}" if p else "too short for cross-validated paths",
        ])


def validate_returns(returns: DataFrame, trials: int = 1, trial_variance: float = 0.0, n_samples: int = 1000, level: float = 0.95, seed: int = 0, periods: float = YEAR) -> StrategyValidation:
    """Of one run's returns (``run_id``, ``pos``, ``r``). ``trial_variance`` is that of the trials' Sharpe ratios per period."""
    m = inference.moments(returns).select("*", inference.track_record(F.col("sr"), F.col("skew"), F.col("kurt")).alias("needed")).collect()
    if len(m) != 1 or m[0].sr is None:
        raise SettingError("one run of three returns or more that vary is needed")
    row = m[0]
    series = np.array([r.r for r in returns.orderBy("pos").select("r").collect()])  # one run: the calendar
    found = resampling.intervals(returns.sparkSession, series, level, n_samples=n_samples, seed=seed, periods=periods).collect()
    best = inference.expected_maximum(trials, trial_variance)
    chance = lambda target: inference.probability(row.sr, row.n, row.skew, row.kurt, target)
    return StrategyValidation(row.n, row.sr * periods**0.5, chance(0.0), chance(best), row.needed, trials, {r.statistic: (r.estimate, r.lower, r.upper) for r in found})


def validate_family(perf: DataFrame, splits: int = 16, lookback: int = 0, groups: int = 6, tested: int = 2, n_samples: int = 1000, seed: int = 0, periods: float = YEAR) -> FamilyValidation:
    """Of a family's returns (``cfg_idx``, ``t``, ``ret``) over common times, against holding nothing."""
    spark = perf.sparkSession
    runs = perf.select(F.col("cfg_idx").alias("run_id"), F.col("t").alias("pos"), F.col("ret").alias("r"))
    known = [r for r in inference.probabilities(inference.moments(runs)).collect() if r.sr is not None]
    if len(known) < 2:
        raise SettingError("a family has two configurations or more")
    best = max(known, key=lambda r: (r.sr, -r.run_id))
    times = [r.t for r in perf.select("t").distinct().orderBy("t").collect()]  # the calendar
    splits = min(splits, len(times) // 2 // 2 * 2)
    over = overfitting.pbo(perf, splits).first()
    names = sorted(r.run_id for r in known)
    wide = perf.groupBy("t").pivot("cfg_idx", names).agg(F.first("ret")).orderBy("t").toPandas().drop(columns="t")  # the calendar
    spa = resampling.superior_ability(spark, wide.to_numpy(), n_samples, seed=seed).first().asDict()
    paths: list[float] = []
    if len(times) // groups > lookback:
        dated = perf.withColumn("t", F.col("t") - times[0])
        _, stitched = crossval.cpcv(dated, len(times), groups, tested, lookback)
        paths = [r.s for r in stitched.groupBy("path").agg(sharpe(F.col("ret"), periods=periods).alias("s")).orderBy("path").collect() if r.s is not None]
    return FamilyValidation(best.run_id, best.sr * periods**0.5, best.dsr, splits, over.pbo, over.prob_loss, spa, tuple(paths))
