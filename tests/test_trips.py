"""Round trips by hand-worked cases (fixed values) and against a fill-by-fill account."""

import random

import numpy as np
import pytest

from marketlab.operators import ledger, metrics
from marketlab.operators.orderbook import Holding


def trips(spark, fills, last=None):
    rows = [(0, "A", i, f"2024-01-0{1 + day}", float(q), float(p), float(c)) for i, (day, q, p, c) in enumerate(fills)]
    frame = spark.createDataFrame(rows, "run_id long, symbol string, seq long, ts string, quantity double, price double, commission double")
    days = spark.createDataFrame([(i, f"2024-01-0{1 + i}") for i in range(6)], "pos long, ts string")
    prices = spark.createDataFrame([("A", last)], "symbol string, last_close double")
    stamped = lambda df: df.withColumn("ts", df.ts.cast("timestamp_ntz"))
    return ledger.round_trips(stamped(frame), stamped(days), prices).orderBy("entry_time", "status")


def test_scaling(spark):
    (t,) = trips(spark, [(0, 10, 100, 1), (1, 10, 110, 1), (2, -5, 120, 1), (4, -15, 90, 1)]).collect()
    assert (t.direction, t.status, t.quantity, t.entry_price, t.exit_price, t.pnl, t.net_pnl, t.bars_held) == ("long", "closed", 20, 105, 97.5, -150, -154, 4)
    assert np.isclose(t["return"], -154 / 2100)


def test_flip(spark):
    long, short = trips(spark, [(0, 10, 100, 0), (1, -30, 110, 3), (2, 20, 100, 2)]).collect()
    assert (long.direction, long.pnl, long.commission, short.direction, short.quantity, short.pnl, short.commission) == ("long", 100, 1, "short", 20, 200, 4)


def test_open_trades_are_marked(spark):
    (t,) = trips(spark, [(0, 10, 100, 0), (1, -4, 130, 0)], 90.0).collect()
    assert (t.status, t.exit_time, t.pnl, t.bars_held, t.exit_price) == ("open", None, 4 * 30 - 6 * 10, 5, 130)
    assert trips(spark, []).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_random_fills_against_an_account(spark, seed):
    rng = random.Random(seed)
    fills = [(min(i // 6, 5), rng.choice([-7, -3, -2, 1, 2, 5, 4]), rng.uniform(50, 150), 0.5) for i in range(36)]
    got = trips(spark, fills, 77.0).collect()
    h = Holding()
    for _, q, p, _ in fills:
        h.take(q, p)
    h.mark = 77.0
    assert np.isclose(sum(t.pnl for t in got), h.realized + h.unrealized)
    assert np.isclose(sum(t.commission for t in got), 18) and sum(t.status == "open" for t in got) == (h.quantity != 0)


def test_statistics_of_trades(spark):
    rows = [(0, "closed", n, b) for n, b in zip((100.0, -50.0, 30.0, -20.0), (1, 2, 3, 4), strict=True)] + [(0, "open", 999.0, 9)]
    t = metrics.trade_stats(spark.createDataFrame(rows, "run_id long, status string, net_pnl double, bars_held long")).first()
    assert (t.n_trades, t.hit_rate, t.avg_win, t.avg_loss, t.avg_trade, t.avg_bars) == (4, 0.5, 65, -35, 15, 2.5) and np.isclose(t.profit_factor, 130 / 70)
