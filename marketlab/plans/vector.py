"""Target weights to equity without leaving the JVM.

The recursion of cash and shares runs over a run's rebalances only, as a fold
of an array of decisions; the equity between them is a join. All runs of a grid
are folded in one plan, keyed by ``run_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SettingError

_HISTORY = "array<struct<pos:bigint,cash:double,shares:array<double>,traded:double,cost:double>>"
_FOLD = """
aggregate(decisions,
  named_struct('cash', {cash}D, 'shares', transform(decisions[0].w, x -> 0D), 'history', cast(array() as {history})),
  (s, d) -> transform(array(s.cash + aggregate(zip_with(d.close, s.shares, (c, q) -> c * q), 0D, (a, x) -> a + x)), equity ->
    transform(array(zip_with(d.w, d.close, (w, c) -> coalesce(w, 0D) * equity / c)), target ->
      transform(array(zip_with(target, s.shares, (t, q) -> t - q)), delta ->
        transform(array(zip_with(delta, d.fill, (x, f) -> f * (1D + signum(x) * {slip}D))), price ->
          transform(array(named_struct(
              'traded', aggregate(zip_with(delta, price, (x, p) -> abs(x) * p), 0D, (a, x) -> a + x),
              'paid', aggregate(zip_with(delta, price, (x, p) -> x * p), 0D, (a, x) -> a + x),
              'slipped', aggregate(zip_with(delta, d.fill, (x, f) -> abs(x) * f * {slip}D), 0D, (a, x) -> a + x))), t ->
            named_struct('cash', s.cash - (t.paid + t.traded * {fee}D), 'shares', target, 'history',
              concat(s.history, array(named_struct('pos', d.pos + 1, 'cash', s.cash - (t.paid + t.traded * {fee}D), 'shares', target, 'traded', t.traded, 'cost', t.traded * {fee}D + t.slipped)))))[0])[0])[0])[0])[0],
  s -> s.history)
"""


@dataclass(frozen=True)
class VectorSettings:
    cash: float = 1_000_000.0
    slippage_bps: float = 0.0
    commission_bps: float = 0.0
    execution: str = "open"

    def __post_init__(self):
        if self.cash <= 0 or self.slippage_bps < 0 or self.commission_bps < 0:
            raise SettingError("cash must be positive, and costs not negative")
        if self.execution not in ("open", "close"):
            raise SettingError("execution is at the next open or close")


def equity(panel: DataFrame, weights: DataFrame, settings: VectorSettings = VectorSettings(), start: int = 0) -> DataFrame:
    """(``run_id``, ``pos``, ``ts``, ``equity``, ``cash``, ``shares``, ``gross``, ``traded``, ``cost``) of scheduled weights.

    ``weights`` have ``run_id``, ``pos``, ``sym_idx`` and ``w``. A decision at a
    close is sized on it and filled at the next bar, so the last bar decides
    nothing. The panel must have no holes from ``start`` on.
    """
    run = ["run_id"] if "run_id" in weights.columns else []
    if not run:
        weights = weights.withColumn("run_id", F.lit(0))
    rows = F.array_sort(F.collect_list(F.struct("sym_idx", "close", settings.execution if settings.execution != "close" else "has_bar")))
    pick = lambda name: F.transform(rows, lambda r: r[name])
    fills = pick("close") if settings.execution == "close" else pick("open")
    times = panel.filter(F.col("pos") >= start).groupBy("pos", "ts").agg(pick("close").alias("close"), fills.alias("fill"))
    after = times.select((F.col("pos") - 1).alias("pos"), F.col("fill").alias("next_fill"))
    wide = weights.filter(F.col("pos") >= start).groupBy("run_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("sym_idx", "w"))), lambda r: r["w"]).alias("w"))
    decided = wide.join(times.select("pos", "close").join(after, "pos"), "pos").select("run_id", F.struct("pos", "w", "close", F.col("next_fill").alias("fill")).alias("d"))
    runs = decided.groupBy("run_id").agg(F.array_sort(F.collect_list("d")).alias("decisions"))
    fold = _FOLD.format(cash=float(settings.cash), slip=settings.slippage_bps / 1e4, fee=settings.commission_bps / 1e4, history=_HISTORY)
    states = runs.select("run_id", F.expr(f"inline({fold})"))
    grid = weights.select("run_id").distinct().crossJoin(times.select("pos", "ts", F.col("close").alias("closes")))
    joined = grid.join(states, ["run_id", "pos"], "left")
    back = W.partitionBy("run_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    state = F.last(F.when(F.col("cash").isNotNull(), F.struct("cash", "shares")), ignorenulls=True).over(back)
    held = joined.withColumn("state", state).select(
        "run_id", "pos", "ts", "closes", F.coalesce("state.cash", F.lit(float(settings.cash))).alias("cash"), F.coalesce("state.shares", F.transform("closes", lambda c: F.lit(0.0))).alias("shares"),
        F.coalesce("traded", F.lit(0.0)).alias("traded"), F.coalesce("cost", F.lit(0.0)).alias("cost"),
    )
    value = F.aggregate(F.zip_with("closes", "shares", lambda c, q: c * q), F.lit(0.0), lambda a, x: a + x)
    gross = F.aggregate(F.zip_with("closes", "shares", lambda c, q: F.abs(c * q)), F.lit(0.0), lambda a, x: a + x)
    return held.select("run_id", "pos", "ts", (F.col("cash") + value).alias("equity"), "cash", "shares", gross.alias("gross"), "traded", "cost")
