"""Validation of runs and families, and the command line."""

import numpy as np
import pytest

from marketlab import cli
from marketlab.errors import SettingError
from marketlab.inference import validation
from marketlab.operators import signals
from marketlab.plans import research
from marketlab.sources import bars, synthetic


def perf(spark, n=120, skill=0.0, m=5):
    x = np.random.default_rng(1).normal(size=(n, m)) * 0.01
    x[:, 2 % m] += skill
    return spark.createDataFrame([(j, t, float(x[t, j])) for t in range(n) for j in range(m)], "cfg_idx long, t long, ret double")


def test_family(spark):
    good = validation.validate_family(perf(spark, skill=0.006), 16, lookback=2, n_samples=200)
    assert good.best == 2 and good.pbo < 0.05 and good.spa["p_consistent"] < 0.05 and len(good.path_sharpes) == 5 and good.dsr > 0.9
    none = validation.validate_family(perf(spark, n=20), 16, n_samples=200)
    assert none.splits == 10
    assert none.spa["p_consistent"] > 0.05 and "paths" in none.format()
    with pytest.raises(SettingError):
        validation.validate_family(perf(spark, m=1))


def test_strategy(spark):
    r = np.random.default_rng(2).normal(0.001, 0.01, 300)
    frame = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(r)], "run_id long, pos long, r double")
    got = validation.validate_returns(frame, trials=10, trial_variance=0.004, n_samples=200)
    assert got.n == 300 and np.isclose(got.sharpe, r.mean() / r.std(ddof=1) * 252**0.5) and got.dsr < got.psr
    estimate, low, high = got.intervals["sharpe"]
    assert low < estimate < high and "Sharpe" in got.format()


def test_allocation_is_a_strategy(spark):
    panel = bars.panel(synthetic.ohlcv(spark, 1, symbols=3, seed=3))
    w = signals.strategy("allocation", panel, method="iv", lookback=60)
    days = w.groupBy("pos").sum("w").collect()
    assert 5 <= len(days) <= 12 and all(np.isclose(r[1], 1) for r in days) and min(r.pos for r in days) == 60
    curves = research.run_grid(panel, "allocation", [{"method": "ew", "lookback": 60}, {"method": "hrp", "lookback": 60}])
    assert curves.select("run_id").distinct().count() == 2


def test_command_line(spark, capsys, tmp_path):
    data = ["--symbols", "2", "--years", "1", "--seed", "1"]
    assert cli.main(["strategies"]) == 0 and "allocation" in capsys.readouterr().out
    assert cli.main(["run", *data, "--param", "fast=5", "--param", "slow=20"]) == 0 and "harpe" in capsys.readouterr().out
    assert cli.main(["validate", *data, "--grid", "fast=5,10", "--grid", "slow=20,30", "--splits", "6", "--samples", "50"]) == 0
    assert "overfitting" in capsys.readouterr().out
    assert cli.main(["run", *data, "--param", "fast"]) == 2 and "key=value" in capsys.readouterr().err
