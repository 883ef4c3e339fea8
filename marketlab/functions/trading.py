"""Scalar functions of trading as column expressions, each with a scalar twin for the order kernel."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SettingError

LOT_SLACK = 1e-9


def lots(quantity: Column, lot: float | None) -> Column:
    """``quantity`` rounded toward zero to whole lots."""
    if lot is None:
        return quantity
    if lot <= 0:
        raise SettingError("a lot must be positive")
    return F.signum(quantity) * F.floor(F.abs(quantity) / lot + LOT_SLACK) * lot


def lots_of(quantity: float, lot: float | None) -> float:
    if lot is None:
        return quantity
    if lot <= 0:
        raise SettingError("a lot must be positive")
    return math.copysign(math.floor(abs(quantity) / lot + LOT_SLACK) * lot, quantity)


def fraction_quantity(equity: Column, fraction: Column, price: Column, lot: float | None = 1.0) -> Column:
    """Lots that a fraction of the equity buys."""
    return lots(F.try_divide(equity * fraction, price), lot)


def risk_quantity(equity: Column, risk: Column, entry: Column, stop: Column, lot: float | None = 1.0) -> Column:
    """Lots that lose ``risk`` of the equity between entry and stop; short if the stop is above."""
    return lots(F.try_divide(equity * risk, entry - stop), lot)


@dataclass(frozen=True)
class Slippage:
    """No price impact; the base of the others."""

    def impact(self, quantity, o, h, lo, c, v):
        return F.lit(0.0)

    def impact_of(self, quantity: float, bar) -> float:
        return 0.0

    def price(self, reference: Column, sign: Column, quantity: Column, o=None, h=None, lo=None, c=None, v=None) -> Column:
        return reference * (1 + sign * self.impact(quantity, o, h, lo, c, v))

    def price_of(self, reference: float, sign: int, quantity: float, bar) -> float:
        return reference * (1 + sign * self.impact_of(quantity, bar))


@dataclass(frozen=True)
class FixedSlippage(Slippage):
    bps: float = 5.0

    def __post_init__(self):
        if self.bps < 0:
            raise SettingError("basis points must not be negative")

    def impact(self, quantity, o, h, lo, c, v):
        return F.lit(self.bps / 1e4)

    def impact_of(self, quantity, bar):
        return self.bps / 1e4


def range_volatility(high: Column, low: Column) -> Column:
    """Parkinson's estimate from one bar's range."""
    return F.log(high / low) / math.sqrt(4 * math.log(2))


@dataclass(frozen=True)
class RootImpact(Slippage):
    """Half a spread, and volatility times the root of the share of the volume; at most ``most``."""

    eta: float = 1.0
    volatility: float | None = None
    spread_bps: float = 0.0
    most: float = 0.1

    def impact(self, quantity, o, h, lo, c, v):
        sigma = F.lit(self.volatility) if self.volatility is not None else range_volatility(h, lo)
        return F.when(v <= 0, self.most).otherwise(F.least(self.spread_bps / 2e4 + self.eta * sigma * F.sqrt(F.try_divide(quantity, v)), F.lit(self.most)))

    def impact_of(self, quantity, bar):
        if bar.volume <= 0:
            return self.most
        sigma = self.volatility if self.volatility is not None else math.log(bar.high / bar.low) / math.sqrt(4 * math.log(2))
        return min(self.spread_bps / 2e4 + self.eta * sigma * math.sqrt(quantity / bar.volume), self.most)


@dataclass(frozen=True)
class Commission:
    """None; the base of the others."""

    def fee(self, quantity: Column, price: Column) -> Column:
        return F.lit(0.0)

    def fee_of(self, quantity: float, price: float) -> float:
        return 0.0


@dataclass(frozen=True)
class ShareCommission(Commission):
    rate: float = 0.005
    least: float = 1.0
    most_fraction: float = 0.01

    def fee(self, quantity, price):
        return F.when(quantity <= 0, 0.0).otherwise(F.least(F.greatest(self.rate * quantity, F.lit(self.least)), self.most_fraction * quantity * price))

    def fee_of(self, quantity, price):
        return 0.0 if quantity <= 0 else min(max(self.rate * quantity, self.least), self.most_fraction * quantity * price)


@dataclass(frozen=True)
class BpsCommission(Commission):
    bps: float = 1.0

    def __post_init__(self):
        if self.bps < 0:
            raise SettingError("basis points must not be negative")

    def fee(self, quantity, price):
        return self.bps / 1e4 * F.abs(quantity) * price

    def fee_of(self, quantity, price):
        return self.bps / 1e4 * abs(quantity) * price


# -- fill rules of independent orders on one bar


def limit_fill(buy: Column, limit: Column, o: Column, h: Column, lo: Column, strict: bool = False) -> Column:
    """The price at which a limit order fills on a bar, before costs; null if it doesn't."""
    down = lo < limit if strict else lo <= limit
    up = h > limit if strict else h >= limit
    return F.when(buy, F.when(o <= limit, o).when(down, limit)).otherwise(F.when(o >= limit, o).when(up, limit))


def stop_fill(buy: Column, stop: Column, o: Column, h: Column, lo: Column) -> Column:
    """The price at which a stop order fills on a bar, before costs; null if it doesn't."""
    return F.when(buy, F.when(o >= stop, o).when(h >= stop, stop)).otherwise(F.when(o <= stop, o).when(lo <= stop, stop))


def idle(kind: Column, buy: Column, level: Column, h: Column, lo: Column, armed: Column) -> Column:
    """Whether an order can't act on a bar: unarmed, or its price isn't reached."""
    limit = F.when(buy, lo > level).otherwise(h < level)
    stop = F.when(buy, h < level).otherwise(lo > level)
    return ~armed | F.when(kind == "limit", limit).when(kind == "stop", stop).otherwise(F.lit(False))


def trail_level(sell: Column, reference: Column, percent: Column, amount: Column) -> Column:
    """Where a trailing stop stands: below its best price for sells, above for buys."""
    return F.when(sell, F.when(percent.isNotNull(), reference * (1 - percent)).otherwise(reference - amount)).otherwise(F.when(percent.isNotNull(), reference * (1 + percent)).otherwise(reference + amount))


def order_faults(kind: Column, quantity: Column, limit: Column, stop: Column, amount: Column, percent: Column) -> Column:
    """What is wrong with an order's specification, as an array of texts."""
    wants_limit, wants_stop, trails = kind.isin("limit", "stop_limit"), kind.isin("stop", "stop_limit"), kind == "trailing_stop"
    bad = [
        ("quantity", quantity.isNull() | F.isnan(quantity) | (quantity <= 0) | (quantity == float("inf"))),
        ("limit price", F.when(wants_limit, limit.isNull() | (limit <= 0)).otherwise(limit.isNotNull())),
        ("stop price", F.when(wants_stop, stop.isNull() | (stop <= 0)).otherwise(stop.isNotNull())),
        ("trail", F.when(trails, (amount.isNull() == percent.isNull()) | (amount <= 0) | (percent <= 0) | (percent >= 1)).otherwise(amount.isNotNull() | percent.isNotNull())),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(n)) for n, b in bad]))


def participation(volume: Column, share: float) -> Column:
    """How much of a bar's volume may be traded."""
    return F.floor(share * volume).cast("double")


def month_changed(ts: Column, before: Column) -> Column:
    return F.coalesce(F.trunc(ts, "MM") != F.trunc(before, "MM"), F.lit(True))


def label(params: dict) -> str:
    """``a=1, b=2``, or ``default`` without parameters."""
    return ", ".join(f"{k}={v}" for k, v in params.items()) or "default"
