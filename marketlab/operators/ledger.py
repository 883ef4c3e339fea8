"""Fills to positions, cash and round trips.

Fills have ``run_id``, ``seq`` (their order), ``ts``, ``symbol``, signed
``quantity``, ``price`` and ``commission``. What depends on the order of a
symbol's fills is a fold over them, keyed by run and symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLAT = 1e-9

_POSITION = """
aggregate(fills, named_struct('q', 0D, 'cost', 0D, 'realized', 0D),
  (s, f) -> CASE
    WHEN s.q = 0D OR signum(s.q) = signum(f.quantity)
      THEN named_struct('q', s.q + f.quantity, 'cost', (abs(s.q) * s.cost + abs(f.quantity) * f.price) / (abs(s.q) + abs(f.quantity)), 'realized', s.realized)
    WHEN abs(abs(f.quantity) - abs(s.q)) <= {flat}D
      THEN named_struct('q', 0D, 'cost', 0D, 'realized', s.realized + signum(s.q) * abs(s.q) * (f.price - s.cost))
    WHEN abs(f.quantity) < abs(s.q)
      THEN named_struct('q', s.q + f.quantity, 'cost', s.cost, 'realized', s.realized + signum(s.q) * abs(f.quantity) * (f.price - s.cost))
    ELSE named_struct('q', s.q + f.quantity, 'cost', f.price, 'realized', s.realized + signum(s.q) * abs(s.q) * (f.price - s.cost))
  END)
"""


def _gathered(fills: DataFrame) -> DataFrame:
    return fills.groupBy("run_id", "symbol").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "quantity", "price", "commission"))).alias("fills"))


def positions(fills: DataFrame) -> DataFrame:
    """Final ``quantity``, average ``cost`` and ``realized`` profit by run and symbol."""
    state = _gathered(fills).withColumn("s", F.expr(_POSITION.format(flat=FLAT)))
    return state.select("run_id", "symbol", F.col("s.q").alias("quantity"), F.col("s.cost").alias("cost"), F.col("s.realized").alias("realized"))


def cash(fills: DataFrame, start: float) -> DataFrame:
    """Running ``cash`` after each fill."""
    flow = -(F.col("quantity") * F.col("price") + F.col("commission"))
    return fills.withColumn("cash", start + F.sum(flow).over(W.partitionBy("run_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


def held(fills: DataFrame, panel: DataFrame) -> DataFrame:
    """Quantity and market value of each run's symbols at each time: fills summed, prices carried."""
    moves = fills.groupBy("run_id", "symbol", "ts").agg(F.sum("quantity").alias("moved"))
    grid = fills.select("run_id").distinct().crossJoin(panel.select("pos", "ts", "symbol", "last_close"))
    back = W.partitionBy("run_id", "symbol").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    q = F.sum(F.coalesce("moved", F.lit(0.0))).over(back)
    return grid.join(moves, ["run_id", "symbol", "ts"], "left").select("run_id", "pos", "ts", "symbol", q.alias("quantity"), (q * F.col("last_close")).alias("value"))


def exposures(held_: DataFrame) -> DataFrame:
    """Market value, gross, net and short value by run and time."""
    v = F.coalesce("value", F.lit(0.0))
    return held_.groupBy("run_id", "pos", "ts").agg(F.sum(v).alias("net"), F.sum(F.abs(v)).alias("gross"), F.sum(F.least(v, F.lit(0.0))).alias("short"))


def borrow_fees(exposures_: DataFrame, rate: float, periods: float = 252.0) -> DataFrame:
    """What short positions cost at each bar."""
    return exposures_.withColumn("fee", -F.col("short") * rate / periods)


def unbalanced(equity: DataFrame, exposures_: DataFrame, start: float) -> DataFrame:
    """Rows whose equity isn't cash plus market value, within 1e-7 of the starting cash."""
    both = equity.join(exposures_.select("run_id", "pos", "net"), ["run_id", "pos"])
    return both.filter(F.abs(F.col("equity") - F.col("cash") - F.col("net")) > 1e-7 * max(abs(start), 1.0))


def round_trips(fills: DataFrame, calendar: DataFrame, last_prices: DataFrame) -> DataFrame:
    """Trades from flat to flat; a fill through zero ends one and begins another, sharing its commission by quantity.

    Open trades are marked at ``last_prices`` (``symbol``, ``last_close``); bars
    are counted on ``calendar``. What a trade earns is what left it, and what it
    still holds at the last price, less what entered it, so no cost is carried
    from fill to fill: windows number the trades, and a sum by trade is all.
    """
    line = W.partitionBy("run_id", "symbol").orderBy("seq")
    own = fills.select("run_id", "symbol", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "quantity", "price", "commission").filter("quantity <> 0")
    total = F.sum("quantity").over(line.rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("after", F.when(F.abs(total) > FLAT, total).otherwise(0.0))
    own = own.withColumn("before", F.coalesce(F.lag("after").over(line), F.lit(0.0)))
    piece = lambda k, q, start: F.struct(F.lit(k).alias("k"), q.alias("q"), start.alias("start"))
    through = F.col("before") * F.col("after") < 0
    whole = F.array(piece(0, F.col("quantity"), F.col("before") == 0))
    split = F.array(piece(0, -F.col("before"), F.lit(False)), piece(1, F.col("after"), F.lit(True)))
    pieces = own.select("*", F.explode(F.when(through, split).otherwise(whole)).alias("p")).select(
        "run_id", "symbol", "seq", "ts", "price", "p.*", (F.col("commission") * F.abs(F.col("p.q") / F.col("quantity"))).alias("commission"),
        F.when(through & (F.col("p.k") == 0), 0.0).otherwise(F.col("after")).alias("held"),
    )
    order = W.partitionBy("run_id", "symbol").orderBy("seq", "k").rowsBetween(W.unboundedPreceding, 0)
    numbered = pieces.withColumn("trip", F.sum(F.col("start").cast("long")).over(order))
    side = F.signum(F.min_by("q", F.struct("seq", "k")))
    numbered = numbered.withColumn("enters", F.signum("q") == F.signum(F.first("q").over(W.partitionBy("run_id", "symbol", "trip").orderBy("seq", "k"))))
    size, value = F.abs("q"), F.abs("q") * F.col("price")
    raw = numbered.groupBy("run_id", "symbol", "trip").agg(
        side.cast("int").alias("side"), F.min("ts").alias("entry_time"), F.max_by(F.struct("ts", "held"), F.struct("seq", "k")).alias("end"), F.max(F.abs("held")).alias("quantity"),
        F.sum(F.when(F.col("enters"), size)).alias("in_qty"), F.sum(F.when(F.col("enters"), value)).alias("in_value"), F.sum(F.when(~F.col("enters"), size)).alias("out_qty"),
        F.coalesce(F.sum(F.when(~F.col("enters"), value)), F.lit(0.0)).alias("out_value"), F.sum("commission").alias("commission"),
    )
    held = F.abs("end.held")
    raw = raw.select("run_id", "symbol", "side", "entry_time", F.when(held == 0, F.col("end.ts")).alias("exit_time"), "quantity", (F.col("in_value") / F.col("in_qty")).alias("entry_price"), F.try_divide("out_value", "out_qty").alias("exit_price"), "commission", held.alias("held"), "in_value", "out_value")
    end = calendar.agg(F.max("pos").alias("last_pos"))
    at = calendar.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "pos")
    dated = raw.join(at.withColumnsRenamed({"ts": "entry_time", "pos": "entry_pos"}), "entry_time", "left").join(at.withColumnsRenamed({"ts": "exit_time", "pos": "exit_pos"}), "exit_time", "left").join(last_prices.select("symbol", "last_close"), "symbol", "left").crossJoin(F.broadcast(end))
    is_open = F.col("exit_time").isNull()
    pnl = F.col("side") * (F.col("out_value") + F.col("held") * F.coalesce("last_close", F.col("entry_price")) - F.col("in_value"))
    net = pnl - F.col("commission")
    return dated.select(
        "run_id", "symbol", F.when(F.col("side") > 0, "long").otherwise("short").alias("direction"), F.when(is_open, "open").otherwise("closed").alias("status"), "entry_time", "exit_time", "quantity", "entry_price", "exit_price",
        pnl.alias("pnl"), "commission", net.alias("net_pnl"), F.when(F.col("in_value") != 0, net / F.col("in_value")).alias("return"), (F.coalesce("exit_pos", "last_pos") - F.col("entry_pos")).alias("bars_held"),
    )


def rebalance_orders(targets: DataFrame, holdings: DataFrame, prices: DataFrame, equity: float, lot: float | None = 1.0, band: float = 0.0, least: float = 0.0) -> DataFrame:
    """Signed ``quantity`` by symbol that moves ``holdings`` (``q``) to ``targets`` (``w``) at ``prices`` (``price``).

    Symbols without a price above zero are left alone. Within ``band`` of the
    target nothing is traded, unless a position is opened or closed; closing
    trades are exact, others in lots; trades below ``least`` in value are left out.
    """
    from ..functions.trading import lots

    both = targets.join(holdings.filter("q <> 0"), "symbol", "full").join(prices, "symbol", "left").filter((F.col("price") > 0) & (F.col("price") < float("inf")))
    w, q = F.coalesce("w", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    now = q * F.col("price") / equity if equity > 0 else F.lit(0.0)
    closing, opening = (w == 0) & (q != 0), (q == 0) & (w != 0)
    delta = F.when(closing, -q).otherwise(lots(w * equity / F.col("price"), lot) - q)
    moved = both.withColumn("quantity", F.when(closing | opening | (F.abs(w - now) > band), delta).otherwise(0.0))
    return moved.filter((F.col("quantity") != 0) & (F.abs(F.col("quantity")) * F.col("price") >= least)).select("symbol", "quantity")


def constrained(targets: DataFrame, cap: float | None = None, gross: float | None = None, allow_short: bool = True) -> DataFrame:
    """Weights within limits: no NaN, no shorts if they aren't allowed, each clipped to ``cap``, all scaled to ``gross``."""
    w = F.when(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf")), 0.0).otherwise(F.col("w"))
    w = w if allow_short else F.greatest(w, F.lit(0.0))
    w = w if cap is None else F.least(F.greatest(w, F.lit(-cap)), F.lit(cap))
    keys = [c for c in ("run_id", "pos") if c in targets.columns]
    clipped = targets.withColumn("w", w)
    if gross is None:
        return clipped
    total = clipped.withColumn("_gross", F.sum(F.abs("w")).over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))))
    return total.withColumn("w", F.when(F.col("_gross") > gross, F.col("w") * gross / F.col("_gross")).otherwise(F.col("w"))).drop("_gross")


def kill_switch(equity: DataFrame, limit: float) -> DataFrame:
    """The first ``pos`` and ``ts`` of each run at which the drawdown from the peak reaches ``limit``."""
    peak = F.max("equity").over(W.partitionBy("run_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    hit = equity.withColumn("peak", peak).filter((F.col("peak") > 0) & (1 - F.col("equity") / F.col("peak") >= limit))
    return hit.groupBy("run_id").agg(F.min("pos").alias("pos"), F.min("ts").alias("ts"))
