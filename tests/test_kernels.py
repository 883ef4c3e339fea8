"""Kernels against hand-worked cases and brute force."""

from itertools import product

import numpy as np
import pytest

from marketlab.functions import inference
from marketlab.inference import crossval, resampling
from marketlab.operators import allocation as A
from marketlab.plans import research
from marketlab.sources.synthetic import MarketSpec, one_symbol


def covariance(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 3 * n))
    return x @ x.T / (3 * n) + np.diag(np.full(n, 0.1))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cap", [1.0, 0.4])
def test_qp_is_the_best_of_a_lattice(seed, cap):
    q, mu = covariance(4, seed), np.random.default_rng(seed).normal(size=4) * 0.2
    x = A.box_qp(q, mu, cap)
    assert np.isclose(x.sum(), 1) and (x >= -1e-12).all() and (x <= cap + 1e-12).all()
    value = lambda v: 0.5 * v @ q @ v - mu @ v
    grid = [np.array([*p, 20 - sum(p)]) / 20 for p in product(range(21), repeat=3) if 0 <= 20 - sum(p) <= 20]
    assert value(x) <= min(value(p) for p in grid if p.max() <= cap + 1e-12) + 1e-12


@pytest.mark.parametrize("seed", range(4))
def test_equal_risk(seed):
    c = covariance(5, seed)
    w = A.equal_risk(c)
    assert np.allclose(w * (c @ w) / (w @ c @ w), 0.2)


def test_hierarchical():
    vol = np.array([0.1, 0.2, 0.2, 0.1])
    corr = np.eye(4)
    corr[0, 2] = corr[2, 0] = 0.8
    corr[1, 3] = corr[3, 1] = 0.6
    assert np.allclose(A.hierarchical(corr * np.outer(vol, vol)), np.array([148, 41, 37, 164]) / 390)


def test_linkage():
    x = np.array([0.0, 1, 3, 7])
    merges = A.single_linkage(np.abs(x[:, None] - x))
    assert [m[:3] for m in merges] == [(0, 1, 1.0), (2, 4, 2.0), (3, 5, 4.0)]
    assert A.leaf_order(merges) == [3, 2, 0, 1]


def test_shrinkage_lies_between():
    x = np.random.default_rng(1).normal(size=(60, 5))
    cov, intensity = A.shrunk(x)
    assert 0 <= intensity <= 1 and np.allclose(np.diag(cov), np.diag(A.sample(x, 0)))
    assert np.allclose(A.shrunk(x, "identity", 0.0)[0], A.sample(x, 0))


def test_sharpe_inference():
    z = inference.NORMAL.inv_cdf(0.95)
    assert abs(1 + (1 + 0.5 * 0.01) * (z / 0.1) ** 2 - 273) < 1
    assert abs(inference.expected_maximum(1000, 1.0) - 3.25) < 0.02
    assert inference.expected_maximum(1, 1.0) == 0


def test_bootstrap_paths():
    got = resampling.paths(np.arange(200), 50, 5.0, 1)
    assert got.min() >= 0 and got.max() < 50
    stays = ((got[:, 1:] - got[:, :-1]) % 50 == 1).mean()
    assert abs(stays - 0.8) < 0.03
    assert (resampling.paths(np.array([7]), 50, 5.0, 1)[0] == got[7]).all()


def test_long_run_variance_of_all_lags():
    d, b = np.random.default_rng(2).normal(size=40), 4.0
    n, e = len(d), d - d.mean()
    want = e @ e / n + 2 * sum(((1 - i / n) * (1 - 1 / b) ** i + i / n * (1 - 1 / b) ** (n - i)) * (e[i:] @ e[: n - i]) / n for i in range(1, n))
    assert np.isclose(resampling.long_run_variance(d, b), want)


def plain_block_length(x):
    n, e = len(x), x - x.mean()
    k, cap = max(5, int(np.ceil(np.sqrt(np.log10(n))))), np.ceil(min(3 * np.sqrt(n), n / 3))
    top = int(np.ceil(np.sqrt(n))) + k
    cov = [sum(e[i] * e[i + j] for i in range(n - j)) / n if j < n else 0.0 for j in range(top + 1)]
    if cov[0] <= 0:
        return 1.0, 1.0, 0
    quiet = [abs(c / cov[0]) < 2 * np.sqrt(np.log10(n) / n) for c in cov]
    starts = [j for j in range(1, top + 1) if j + k - 1 <= top and all(quiet[j : j + k])]
    width = min(2 * starts[0], top) if starts else top
    flat = lambda j: max(0.0, min(1.0, 2 * (1 - abs(j) / width)))
    g0, g1 = (sum(flat(j) * abs(j) ** p * cov[abs(j)] for j in range(-width, width + 1)) for p in (0, 1))
    return *(float(np.clip((2 * g1**2 / (c * g0**2) * n) ** (1 / 3), 1, cap)) for c in (2, 4 / 3)), width


def test_block_lengths(spark):
    rng = np.random.default_rng(4)
    series = [rng.normal(size=n) for n in (12, 60, 250)] + [np.zeros(30)]
    for a in (0.5, -0.6):
        x = [0.0]
        for v in rng.normal(size=300):
            x.append(a * x[-1] + v)
        series.append(np.array(x))
    rows = [(i, k, float(v)) for i, x in enumerate(series) for k, v in enumerate(x)] + [(99, k, float(k)) for k in range(11)]
    got = {r.run_id: r for r in resampling.block_lengths(spark.createDataFrame(rows, "run_id long, pos long, r double")).collect()}
    assert sorted(got) == list(range(len(series)))
    for i, x in enumerate(series):
        want = plain_block_length(x)
        assert np.allclose((got[i].stationary, got[i].circular, got[i].bandwidth), want), i


def test_superior_ability(spark):
    rng = np.random.default_rng(6)
    d = rng.normal(size=(60, 4)) * 0.01
    d[:, 1] += 0.02
    d[:, 3] = 0.0
    row = resampling.superior_ability(spark, d, 200, 4.0, 3).first()
    draws = np.stack([d[p].mean(axis=0) for p in resampling.paths(np.arange(200), 60, 4.0, 3)])
    own, root = d.mean(axis=0), np.sqrt(60)
    omega = np.sqrt([resampling.long_run_variance(d[:, j], 4.0) for j in range(4)])
    t = [root * own[j] / omega[j] if omega[j] > 0 else 0.0 for j in range(4)]
    assert np.isclose(row.statistic, max(*t, 0)) and np.isclose(row.rc_statistic, (root * own).max())
    assert np.isclose(row.rc_pvalue, ((root * (draws - own)).max(axis=1) >= (root * own).max()).mean())
    for name, centre in (("lower", np.maximum(own, 0)), ("consistent", np.where(np.array(t) >= -np.sqrt(2 * np.log(np.log(60))), own, 0)), ("upper", own)):
        z = [[root * (r[j] - centre[j]) / omega[j] if omega[j] > 0 else 0.0 for j in range(4)] for r in draws]
        assert np.isclose(row[f"p_{name}"], np.mean([max(*x, 0) >= row.statistic for x in z]))
    assert row.p_lower <= row.p_consistent <= row.p_upper < 0.05
    noise = resampling.superior_ability(spark, rng.normal(size=(60, 4)), 200).first()
    assert noise.p_consistent > 0.05 and noise.block >= 1


def test_bounds_of_weights():
    q = covariance(6, 3)
    x = A.box_qp(q, upper=0.3, lower=0.1)
    assert np.isclose(x.sum(), 1) and x.min() >= 0.1 - 1e-12 and x.max() <= 0.3 + 1e-12
    assert A.misfit(q, np.zeros(6), x, 0.1, 0.3) <= 1e-9
    singular = np.ones((4, 4))
    assert np.isclose(A.box_qp(singular).sum(), 1)
    for bad in (dict(upper=0.1), dict(lower=0.2), dict(upper=1.5)):
        with pytest.raises(ValueError):
            A.box_qp(q, **bad)


def test_windows():
    got = research.windows(1000, 300, 100, start=50)
    assert got[0] == (0, 50, 349, 350, 449) and got[-1][4] == 999
    assert all(b[3] > a[4] for a, b in zip(got, got[1:], strict=False))


def test_combinatorial_counts():
    table = crossval.combination_table(6, 2)
    assert len({s for s, _ in table}) == 15 and crossval.n_paths(6, 2) == 5


def test_purge(spark):
    obs = crossval.spans(spark, 100, 0, 5)
    tests = spark.range(40, 60).selectExpr("0 as split", "id as obs")
    keep = lambda e: {r.obs for r in crossval.training(tests, obs, e).collect()}
    assert keep(0) == {*range(35), *range(65, 100)}
    assert keep(3) == {*range(35), *range(68, 100)}


def test_synthetic_bars_are_bars():
    f = one_symbol(MarketSpec(bars=500, drop=0.03), 2)
    assert (f.high >= f[["open", "close"]].max(axis=1)).all() and (f.low <= f[["open", "close"]].min(axis=1)).all()
    assert (f[["open", "high", "low", "close"]] > 0).all().all() and len(f) < 500
    assert one_symbol(MarketSpec(bars=500), 2).equals(one_symbol(MarketSpec(bars=500), 2))
