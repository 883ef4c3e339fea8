"""Order-level runs in Spark: one group of bars for each run.

``runs`` has ``run_id`` and columns that the rule's factory takes. A group
holds one run's panel, never several; its outcome comes back as rows of one
table, told apart by ``record``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.orderbook import Panel, Rule, Rules, Run, TargetRule
from ..sources.bars import FIELDS

OUTCOME = (
    "run_id long, record string, pos long, ts timestamp_ntz, symbol string, order_id long, side int, quantity double, price double, commission double, slippage double, "
    "equity double, cash double, gross double, net double, traded double, kind string, status string, tag string, parent_id long, oco_group long, detail string"
)
_NAMES = [c.split()[0] for c in OUTCOME.split(", ")]


def outcome_rows(run_id: int, panel: Panel, out) -> object:
    """One run's outcome as a pandas frame of ``OUTCOME``."""
    import pandas as pd

    at = lambda pos: pd.Timestamp(panel.times[pos]) if pos is not None and pos >= 0 else pd.NaT
    rows = [{"record": "equity", "pos": p, "ts": at(p), "equity": e, "cash": c, "gross": g, "net": n, "traded": t} for p, e, c, g, n, t in out.equity]
    rows += [{"record": "fill", "pos": f.bar, "ts": at(f.bar), "symbol": f.symbol, "order_id": f.ticket, "side": 1 if f.quantity > 0 else -1, "quantity": abs(f.quantity), "price": f.price, "commission": f.commission, "slippage": f.slippage, "net": f.at} for f in out.fills]
    rows += [{"record": "position", "pos": p, "ts": at(p), "symbol": s, "quantity": q, "net": v} for p, s, q, v in out.positions]
    rows += [{"record": "order", "pos": t.placed, "ts": at(t.placed), "symbol": t.symbol, "order_id": t.id, "side": t.side, "quantity": t.quantity, "price": t.price, "traded": t.filled, "kind": t.kind, "status": t.status, "tag": t.tag, "parent_id": t.parent, "oco_group": t.group} for t in out.orders]
    rows += [{"record": "risk", "pos": p, "ts": at(p), "kind": k, "symbol": s, "detail": d} for p, k, s, d in out.log]
    frame = pd.DataFrame(rows, columns=[n for n in _NAMES if n != "run_id"])
    frame.insert(0, "run_id", run_id)
    frame["ts"] = pd.to_datetime(frame["ts"])
    whole = {"pos", "order_id", "side", "parent_id", "oco_group"}
    texts = {"record", "symbol", "kind", "status", "tag", "detail"}
    for name in whole | texts:
        known = [None if v is None or v != v else int(v) if name in whole else str(v) for v in frame[name]]
        frame[name] = pd.Series(known, dtype=object)
    return frame[_NAMES]


def panel_of(frame) -> Panel:
    """Long bars of one run as arrays on their common calendar."""
    wide = frame.pivot(index="ts", columns="symbol", values=FIELDS).sort_index()
    symbols = sorted(frame["symbol"].unique())
    return Panel(wide.index.to_numpy(), symbols, {f: wide[f][symbols].to_numpy() for f in FIELDS})


def simulate(bars: DataFrame, runs: DataFrame, rule: Callable[[dict], Rule], rules: Callable[[dict], Rules] | Rules = Rules(), start: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """All runs over ``bars``. With ``weights`` (``run_id``, ``pos``, ``symbol``, ``w``), the rule is to follow them."""
    params = [c for c in runs.columns if c != "run_id"]

    def one(key, frame, target=None):
        panel, row = panel_of(frame), {c: frame[c].iloc[0] for c in params}
        how = rules(row) if callable(rules) else rules
        made = rule(row) if target is None else TargetRule({int(p): dict(zip(g["symbol"], g["w"], strict=True)) for p, g in target.groupby("pos")})
        return outcome_rows(int(key[0]), panel, Run(panel, made, how, start).go())

    rows = runs.crossJoin(bars.select("symbol", "ts", *FIELDS))
    if weights is None:
        return rows.groupBy("run_id").applyInPandas(lambda key, frame: one(key, frame), OUTCOME)
    return rows.groupBy("run_id").cogroup(weights.select("run_id", "pos", "symbol", "w").groupBy("run_id")).applyInPandas(lambda key, frame, target: one(key, frame, target), OUTCOME)


def equity(outcome: DataFrame) -> DataFrame:
    return outcome.filter("record = 'equity'").select("run_id", "pos", "ts", "equity", "cash", "gross", "net", "traded")


def fills(outcome: DataFrame) -> DataFrame:
    """Fills with a signed quantity and their order ``seq``."""
    from pyspark.sql import Window as W

    own = outcome.filter("record = 'fill'")
    seq = F.row_number().over(W.partitionBy("run_id").orderBy("pos", "net", "order_id"))
    return own.select("run_id", seq.cast("long").alias("seq"), "pos", "ts", "order_id", "symbol", (F.col("side") * F.col("quantity")).alias("quantity"), "price", "commission", "slippage")


def orders(outcome: DataFrame) -> DataFrame:
    return outcome.filter("record = 'order'").select("run_id", F.col("pos").alias("placed"), "order_id", "symbol", "side", "quantity", F.col("traded").alias("filled"), F.col("price").alias("average_price"), "kind", "status", "tag", "parent_id", "oco_group")


def risk_log(outcome: DataFrame) -> DataFrame:
    return outcome.filter("record = 'risk'").select("run_id", "pos", "ts", "kind", "symbol", "detail")


def inconsistent(orders_: DataFrame) -> DataFrame:
    """Brackets whose exits closed more than was opened, and groups with more than one filled order."""
    kids = orders_.filter("parent_id is not null").groupBy("run_id", F.col("parent_id").alias("order_id")).agg(F.sum("filled").alias("closed"))
    over = orders_.join(kids, ["run_id", "order_id"]).filter(F.col("closed") > F.col("filled") + 1e-9).select("run_id", "order_id", F.lit("exits exceed entry").alias("fault"))
    twice = orders_.filter("oco_group is not null and filled > 0").groupBy("run_id", "oco_group").count().filter("count > 1").select("run_id", F.col("oco_group").alias("order_id"), F.lit("several filled").alias("fault"))
    return over.unionByName(twice)
