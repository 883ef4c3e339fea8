"""A data source of synthetic markets, partitioned by symbol.

Prices follow a geometric Brownian motion whose regime (drift, volatility,
jumps) is a Markov chain; highs and lows are the exact extremes of the
Brownian bridge between open and close. Each (seed, symbol) has a random
stream of its own, so partitions don't depend on each other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SettingError

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, regime int"


@dataclass(frozen=True)
class Regime:
    drift: float
    volatility: float
    stay: float


@dataclass(frozen=True)
class MarketSpec:
    symbols: int = 5
    bars: int = 2520
    seed: int = 0
    start: str = "2015-01-01"
    price: float = 100.0
    volume: float = 1e6
    prefix: str = "SYM"
    jump_rate: float = 2.0
    jump_size: float = 0.03
    drop: float = 0.0
    common: float = 0.4
    scale: float = 1.0
    regimes: tuple[Regime, ...] = field(default=(Regime(0.10, 0.12, 0.985), Regime(0.0, 0.18, 0.97), Regime(-0.15, 0.32, 0.95)))

    def __post_init__(self):
        if self.symbols < 1 or self.bars < 1 or not 0 <= self.drop < 1 or not 0 <= self.common <= 1:
            raise SettingError("a market has symbols and bars, and shares between 0 and 1")


def chain(rng: np.random.Generator, regimes: tuple[Regime, ...], n: int) -> np.ndarray:
    """A path of states: each is stayed in with its probability, and left for any other alike."""
    out, state, k = np.empty(n, np.int32), 0, len(regimes)
    for i, u in enumerate(rng.random(n)):
        if i and u > regimes[state].stay and k > 1:
            other = int((u - regimes[state].stay) / (1 - regimes[state].stay) * (k - 1))
            state = [s for s in range(k) if s != state][min(other, k - 2)]
        out[i] = state
    return out


def bridge(rng: np.random.Generator, start: np.ndarray, end: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(highest, lowest) logarithms on the way from start to end."""
    reach = lambda u: np.sqrt((end - start) ** 2 - 2 * sd**2 * np.log(u))
    up, down = rng.uniform(1e-300, 1, len(start)), rng.uniform(1e-300, 1, len(start))
    return (start + end + reach(up)) / 2, (start + end - reach(down)) / 2


def one_symbol(spec: MarketSpec, index: int):
    """The bars of symbol ``index`` as a pandas frame."""
    import pandas as pd

    n, day = spec.bars, 1 / 252
    market, own = np.random.default_rng([spec.seed, 0, 1]), np.random.default_rng([spec.seed, index + 1, 2])
    state = chain(market, spec.regimes, n)
    mu, sigma = (np.array([getattr(r, k) for r in spec.regimes])[state] * spec.scale for k in ("drift", "volatility"))
    shocks = math.sqrt(spec.common) * market.standard_normal(n) + math.sqrt(1 - spec.common) * own.standard_normal(n)
    jumps = (own.random(n) < spec.jump_rate * day) * own.normal(0, spec.jump_size, n)
    gap = own.normal(0, 0.2, n) * sigma * math.sqrt(day)
    step = (mu - sigma**2 / 2) * day + sigma * math.sqrt(day) * shocks + jumps
    closes = math.log(spec.price) + np.cumsum(step)
    opens = np.concatenate(([math.log(spec.price)], closes[:-1])) + gap
    high, low = bridge(own, opens, closes, sigma * math.sqrt(day))
    volume = np.floor(spec.volume * np.exp(own.normal(0, 0.3, n) + np.abs(step) * 10))
    frame = pd.DataFrame({"symbol": f"{spec.prefix}{index:02d}", "ts": pd.bdate_range(spec.start, periods=n), "open": np.exp(opens), "high": np.exp(high), "low": np.exp(low), "close": np.exp(closes), "volume": volume, "regime": state})
    frame["high"], frame["low"] = frame[["open", "high", "close"]].max(axis=1), frame[["open", "low", "close"]].min(axis=1)
    return frame[own.random(n) >= spec.drop]


def market(spark: SparkSession, spec: MarketSpec = MarketSpec()) -> DataFrame:
    """One task a symbol makes its bars."""

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                yield one_symbol(spec, int(i))

    return spark.range(0, spec.symbols, 1, spec.symbols).mapInPandas(run, SCHEMA)


def ohlcv(spark: SparkSession, years: float = 10, **changes) -> DataFrame:
    """``years`` of 252 bars; other settings of ``MarketSpec`` by name."""
    unknown = set(changes) - {f.name for f in fields(MarketSpec)}
    if unknown:
        raise SettingError(f"unknown settings: {', '.join(sorted(unknown))}")
    return market(spark, replace(MarketSpec(bars=int(years * 252)), **changes)).drop("regime")


def multi_asset(spark: SparkSession, bars: int = 2520, seed: int = 0) -> DataFrame:
    """Six equities, four bonds and four commodities, from seeds of their own."""
    classes = [("EQ", 6, 1.0, 0.5), ("BD", 4, 0.3, 0.6), ("CM", 4, 1.2, 0.2)]
    out = None
    for k, (prefix, n, scale, common) in enumerate(classes):
        part = market(spark, MarketSpec(symbols=n, bars=bars, seed=seed * 10 + k, prefix=prefix, scale=scale, common=common)).drop("regime")
        out = part if out is None else out.unionByName(part)
    return out.repartition("symbol")


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("market")`` known, with the settings as options."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, spec):
            self.spec = spec

        def partitions(self):
            return [InputPartition(i) for i in range(self.spec.symbols)]

        def read(self, partition):
            for row in one_symbol(self.spec, partition.value).itertuples(index=False):
                yield (row.symbol, row.ts.to_pydatetime(), *map(float, row[2:7]), int(row.regime))

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "market"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            known = {f.name.lower(): f for f in fields(MarketSpec) if f.name != "regimes"}
            given = {known[k.lower()].name: type(known[k.lower()].default)(v) for k, v in self.options.items() if k.lower() in known}
            return Reader(MarketSpec(**given))

    spark.dataSource.register(Source)


def partitions_by_symbol(bars: DataFrame) -> DataFrame:
    return bars.repartition(F.col("symbol"))
