"""The library's queries over the driver tables, and the DuckDB SQL that they are held against.

Bars are made of ``events`` and ``lineitem``; doubles are rounded to six places
on both sides, because the engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import inference, trading
from .inference import crossval, overfitting, resampling, validation
from .operators import allocation, ledger, metrics, orderbook, signals
from .plans import research, simulate, vector
from .sources import bars as B
from .sources import synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _read(s: SparkSession, d: str, t: str) -> DataFrame:
    return s.read.parquet(f"{d}/{t}.parquet")


# -- fixtures


def events_bars(s: SparkSession, d: str, every: str = "day") -> DataFrame:
    """Bounded bars of the events, one symbol for each type."""
    return B.bounded(B.from_ticks(_read(s, d, "events"), F.col("event_type"), F.col("ts"), F.col("value"), None, every, "event_id"))


def lineitem_bars(s: SparkSession, d: str, key: Column | None = None) -> DataFrame:
    rows = _read(s, d, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    key = F.concat("l_returnflag", "l_linestatus") if key is None else key
    return B.from_ticks(rows, key, F.col("l_shipdate"), F.col("price"), F.col("l_quantity"), "day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def orders_bars(s: SparkSession, d: str) -> DataFrame:
    return B.from_ticks(_read(s, d, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), None, "week", "o_orderkey")


def events_panel(s: SparkSession, d: str) -> DataFrame:
    return B.panel(events_bars(s, d))


def holes_panel(s: SparkSession, d: str) -> DataFrame:
    return B.panel(lineitem_bars(s, d, F.col("l_returnflag")))


_EVENT_BARS = """raw as (select event_type symbol, date_trunc('{every}', ts)::timestamp ts, ts seen, event_id, value from events),
rb as (select symbol, ts, first(value order by seen, event_id) o, max(value) h, min(value) l, last(value order by seen, event_id) c, count(*)::double volume from raw group by 1, 2),
b as (select symbol, ts, 50+50*o/(o+50) as open, 50+50*h/(h+50) as high, 50+50*l/(l+50) as low, 50+50*c/(c+50) as close, volume from rb)"""
_ITEM_BARS = """raw as (select {key} symbol, date_trunc('day', l_shipdate)::timestamp ts, l_shipdate seen, l_orderkey k1, l_linenumber k2, l_partkey k3, l_suppkey k4, l_extendedprice k5, l_extendedprice/l_quantity as value, l_quantity q from lineitem),
b as (select symbol, ts, first(value order by seen,k1,k2,k3,k4,k5) as open, max(value) as high, min(value) as low, last(value order by seen,k1,k2,k3,k4,k5) as close, sum(q) as volume from raw group by 1, 2)"""
_PANEL = """cal as (select ts, row_number() over (order by ts)-1 as pos from (select distinct ts from b)), uni as (select symbol, row_number() over (order by symbol)-1 as sym_idx from (select distinct symbol from b)),
p as (select c.pos, c.ts, u.sym_idx, u.symbol, b.open, b.high, b.low, b.close, b.volume, b.close is not null as has_bar,
  last_value(b.close ignore nulls) over (partition by u.symbol order by c.pos rows between unbounded preceding and current row) as last_close
  from cal c cross join uni u left join b on b.ts = c.ts and b.symbol = u.symbol)"""
E_DAY = "with recursive " + _EVENT_BARS.format(every="day")
E_HOUR = "with recursive " + _EVENT_BARS.format(every="hour")
ITEM = "with recursive " + _ITEM_BARS.format(key="l_returnflag || l_linestatus")
FLAG = "with recursive " + _ITEM_BARS.format(key="l_returnflag")
E_PANEL, H_PANEL = f"{E_DAY}, {_PANEL}", f"{FLAG}, {_PANEL}"
_BAR_COLUMNS = "symbol, ts, round(open,6) as open, round(high,6) as high, round(low,6) as low, round(close,6) as close, round(volume,6) as volume"


def _bars(df: DataFrame) -> DataFrame:
    return df.select("symbol", "ts", *[r6(f).alias(f) for f in B.FIELDS])


# -- sources and panels


@query(f"{E_DAY} select {_BAR_COLUMNS} from b")
def bars_events_daily(s, d):
    return _bars(events_bars(s, d))


@query(f"{E_HOUR} select {_BAR_COLUMNS} from b")
def bars_events_hourly(s, d):
    return _bars(events_bars(s, d, "hour"))


@query(f"{ITEM} select symbol, ts, open, high, low, close, volume from b")
def bars_lineitem_daily(s, d):
    return lineitem_bars(s, d).select("symbol", "ts", *B.FIELDS)


@query(f"with b as (select o_orderpriority symbol, date_trunc('week', o_orderdate)::timestamp ts, first(o_totalprice order by o_orderdate, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low, last(o_totalprice order by o_orderdate, o_orderkey) as close, count(*)::double as volume from orders group by 1, 2) select {_BAR_COLUMNS} from b")
def bars_orders_weekly(s, d):
    return _bars(orders_bars(s, d))


@query(f"{E_HOUR}, {_PANEL} select pos, ts from cal")
def calendar_union(s, d):
    return B.calendar(events_bars(s, d, "hour")).select("pos", "ts")


@query(f"{E_HOUR}, {_PANEL} select pos, symbol, sym_idx, has_bar, round(open,6) as open, round(close,6) as close, round(volume,6) as volume from p")
def panel_dense(s, d):
    return B.panel(events_bars(s, d, "hour")).select("pos", "symbol", F.col("sym_idx").cast("long"), "has_bar", r6("open").alias("open"), r6("close").alias("close"), r6("volume").alias("volume"))


@query(f"{H_PANEL} select pos, symbol, last_close from p")
def panel_locf(s, d):
    return holes_panel(s, d).select("pos", "symbol", "last_close")


@query("""with b as (select event_type symbol, date_trunc('hour', ts)::timestamp ts, value as o, value*0.5 as h, value*0.7 as l, value as c, (event_id % 50) - 1 as v from events),
one as (select symbol, ts, unnest([case when o*0.7 <= 0 or h <= 0 then 'price not positive' end, case when v < 0 then 'negative volume' end, case when h < o*(1-1e-9) then 'high too low' end]) as rule from b),
dup as (select symbol, 'duplicate time' as rule, min(ts) as first_ts from (select symbol, ts from b group by 1,2 having count(*)>1) group by 1)
select symbol, rule, min(ts) as first_ts from one where rule is not null group by 1,2 union all select symbol, rule, first_ts from dup""")
def bars_invalid_rules(s, d):
    e = _read(s, d, "events")
    bad = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("open"), (F.col("value") * 0.5).alias("high"), (F.col("value") * 0.7).alias("low"), F.col("value").alias("close"), (F.col("event_id") % 50 - 1).cast("double").alias("volume"))
    return B.violations(bad.withColumn("low", F.least("low", "open")))


@query(f"{FLAG} select symbol, ts, round(avg(close) over w / 7, 6) as mean5, count(*) over w as n from b window w as (partition by symbol order by ts rows between 4 preceding and current row)")
def last_n_actual_bars(s, d):
    got = B.last_bars(lineitem_bars(s, d, F.col("l_returnflag")), "close", 5)
    return got.select("symbol", "ts", r6(F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / F.size("window") / 7).alias("mean5"), F.size("window").cast("long").alias("n"))


@query(f"{H_PANEL} select pos, symbol, count(close) over w as n_bars, count(*) over w as n_rows, round(avg(close) over w,6) as mean5 from p window w as (partition by symbol order by pos rows between 4 preceding and current row)")
def window_lookback(s, d):
    got = B.lookback(holes_panel(s, d), "close", 5)
    known = F.filter("window", lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    pos = B.calendar(lineitem_bars(s, d, F.col("l_returnflag")))
    return got.join(F.broadcast(pos.select("ts")), "ts").select("pos", "symbol", F.size(known).cast("long").alias("n_bars"), F.size("window").cast("long").alias("n_rows"), r6(mean).alias("mean5"))


@query(f"{E_HOUR}, {_PANEL}, q as (select distinct event_type symbol, date_trunc('minute', ts)::timestamp asked_ts from events where event_id % 20 = 0) select q.symbol, q.asked_ts, m.ts as cal_ts, round(b.close,6) as close from q asof join cal m on q.asked_ts >= m.ts left join b on b.symbol = q.symbol and b.ts = m.ts")
def asof_bar_lookup(s, d):
    asked = _read(s, d, "events").filter("event_id % 20 = 0").select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("asked_ts")).distinct()
    return B.as_of(events_bars(s, d, "hour"), asked).select("symbol", "asked_ts", "cal_ts", r6("close").alias("close"))


@query(f"{FLAG}, {_PANEL}, sl as (select b.* from b join cal using (ts) where pos between 100 and 299) select symbol, count(*) as n, round(sum(close),4) as total from sl group by 1")
def slice_universe(s, d):
    return B.sliced(lineitem_bars(s, d, F.col("l_returnflag")), 100, 300).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query(f"{H_PANEL} select pos, max(close) filter (symbol='A') as a, max(close) filter (symbol='N') as n, max(close) filter (symbol='R') as r from p group by 1")
def pivot_close(s, d):
    return B.pivoted(holes_panel(s, d), "close", ["A", "N", "R"]).select("pos", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query(f"{E_PANEL} select (select min(pos) from cal where ts >= (select min(ts) + interval 36 hour from cal)) as first_pos, (select max(pos) from cal where ts <= (select max(ts) - interval 36 hour from cal)) as last_pos")
def window_bounds(s, d):
    cal = B.calendar(events_bars(s, d))
    ends = cal.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    hours = F.expr("INTERVAL 36 HOURS")
    return cal.crossJoin(F.broadcast(ends)).agg(F.min(F.when(F.col("ts") >= F.col("lo") + hours, F.col("pos"))).alias("first_pos"), F.max(F.when(F.col("ts") <= F.col("hi") - hours, F.col("pos"))).alias("last_pos"))


# -- signals


@query(f"{E_PANEL}, x as (select pos, symbol, avg(last_close) over f as fast, avg(last_close) over s as slow, count(*) over (partition by pos) as n from p window f as (partition by symbol order by pos rows between 2 preceding and current row), s as (partition by symbol order by pos rows between 6 preceding and current row)) select pos, symbol, round(case when pos >= 6 then case when fast > slow then 1.0/n else 0 end end,6) as w from x")
def sma_signal(s, d):
    return signals.sma_crossover(events_panel(s, d), 3, 7).select("pos", "symbol", r6("w").alias("w"))


@query(f"{H_PANEL}, x as (select pos, symbol, ln(last_close/lag(last_close) over (partition by symbol order by pos)) as g from p) select pos, symbol, round(case when count(g) over w = 20 then stddev_samp(g) over w * sqrt(252) end,6) as vol from x window w as (partition by symbol order by pos rows between 19 preceding and current row)")
def rolling_vol(s, d):
    own = W.partitionBy("symbol").orderBy("pos")
    moved = holes_panel(s, d).withColumn("g", F.log(F.col("last_close") / F.lag("last_close").over(own)))
    return moved.select("pos", "symbol", r6(signals.rolling(F.col("g"), 20, F.stddev_samp) * 252**0.5).alias("vol"))


@query(f"""{H_PANEL}, x as (select pos, symbol, last_close, lag(last_close,20) over w as past, ln(last_close/lag(last_close) over w) as g, count(*) over (partition by pos) as n from p window w as (partition by symbol order by pos)),
v as (select *, case when count(g) over f = 10 then stddev_samp(g) over f * sqrt(252) end as vol from x window f as (partition by symbol order by pos rows between 9 preceding and current row)),
r as (select pos, symbol, coalesce(sign(last_close/past-1)*least(0.15/vol, n*1.0)/n, 0) as raw from v), g as (select *, sum(abs(raw)) over (partition by pos) as gross from r)
select pos, symbol, round(case when pos >= 20 then case when gross > 2 then raw*2/gross else raw end end,6) as w from g""")
def tsmom_weights(s, d):
    return signals.time_series_momentum(holes_panel(s, d), 20, 10).select("pos", "symbol", r6("w").alias("w"))


@query(f"""{H_PANEL}, x as (select pos, symbol, sym_idx, lag(last_close,5) over w/lag(last_close,20) over w - 1 as score from p window w as (partition by symbol order by pos)),
k as (select *, row_number() over (partition by pos order by score desc nulls last, sym_idx) as best, row_number() over (partition by pos order by score asc nulls last, sym_idx) as worst, least(1, floor(count(score) over (partition by pos)/2)) as k from x)
select pos, symbol, round(case when pos >= 20 then case when score is not null and worst <= k then -1.0 when score is not null and best <= k then 1.0 else 0 end end,6) as w from k""")
def xsmom_weights(s, d):
    return signals.cross_sectional_momentum(holes_panel(s, d), 20, 5, 1, True).select("pos", "symbol", r6("w").alias("w"))


@query(f"""{H_PANEL}, x as (select pos, symbol, last_close as c, case when count(last_close) over f = 10 then avg(last_close) over f end as m, case when count(last_close) over f = 10 then stddev_samp(last_close) over f end as sd, count(*) over (partition by pos) as n from p window f as (partition by symbol order by pos rows between 9 preceding and current row)),
k as (select *, case when c < m-1.5*sd then 1.0 when c >= m then 0.0 end as lm, case when c > m+1.5*sd then -1.0 when c <= m then 0.0 end as sm from x)
select pos, symbol, round(case when pos >= 9 then (coalesce(last_value(lm ignore nulls) over b,0)+coalesce(last_value(sm ignore nulls) over b,0))/n end,6) as w from k window b as (partition by symbol order by pos rows between unbounded preceding and current row)""")
def bollinger_state(s, d):
    return signals.bollinger_reversion(holes_panel(s, d), 10, 1.5).select("pos", "symbol", r6("w").alias("w"))


_SMA_DUE = f"""{E_PANEL}, x as (select pos, ts, sym_idx, symbol, avg(last_close) over f as fast, avg(last_close) over s as slow, count(*) over (partition by pos) as n from p window f as (partition by symbol order by pos rows between 2 preceding and current row), s as (partition by symbol order by pos rows between 6 preceding and current row)),
w as (select pos, ts, sym_idx, symbol, case when pos >= 6 then case when fast > slow then 1.0/n else 0.0 end end as w from x),
a as (select pos, any_value(ts) as ts, list(w order by sym_idx) as ws, bool_and(w is not null) as valid from w group by pos),
l as (select *, lag(ws) over (order by pos) as before, min(pos) filter (valid) over () as first_valid, lag(ts) over (order by pos) as ts_before from a),
due as (select pos, ts, ws from l where valid and (pos = first_valid or ws <> before))"""


@query(f"{_SMA_DUE} select w.pos, w.symbol, round(w.w,6) as w from w join due using (pos)")
def schedule_change(s, d):
    return signals.scheduled(signals.sma_crossover(events_panel(s, d), 3, 7), "change").select("pos", "symbol", r6("w").alias("w"))


@query(f"""{H_PANEL}, iv as (select pos, ts, symbol, last_close/lag(last_close) over (partition by symbol order by pos)-1 as r from p),
v as (select pos, ts, symbol, case when count(r) over f = 20 then 1/stddev_samp(r) over f end as i from iv window f as (partition by symbol order by pos rows between 19 preceding and current row)),
w as (select pos, ts, symbol, case when pos >= 20 then coalesce(i/sum(i) over (partition by pos),0) end as w from v),
a as (select pos, any_value(ts) as ts, bool_and(w is not null) as valid from w group by pos), l as (select *, lag(ts) over (order by pos) as before, min(pos) filter (valid) over () as first_valid from a)
select w.pos, w.symbol, round(w.w,6) as w from w join l using (pos) where valid and (pos = first_valid or date_trunc('month', l.ts) <> date_trunc('month', l.before))""")
def schedule_monthly(s, d):
    return signals.scheduled(signals.inverse_volatility(holes_panel(s, d), 20), "monthly").select("pos", "symbol", r6("w").alias("w"))


@query(f"{_SMA_DUE}, latest as (select max(pos) as pos from due where pos <= 12) select 12::bigint as pos, w.symbol, round(w.w,6) as w from w join latest using (pos) union all select w.pos, w.symbol, round(w.w,6) from w join due using (pos) where w.pos > 12")
def warmup_targets(s, d):
    due = signals.scheduled(signals.sma_crossover(events_panel(s, d), 3, 7), "change")
    return signals.established(due, 12).select("pos", "symbol", r6("w").alias("w"))


@query(f"{H_PANEL}, iv as (select pos, symbol, last_close/lag(last_close) over (partition by symbol order by pos)-1 as r from p), v as (select pos, symbol, case when count(r) over f = 20 then 1/stddev_samp(r) over f end as i from iv window f as (partition by symbol order by pos rows between 19 preceding and current row)) select pos, symbol, round(case when pos >= 20 then coalesce(i/sum(i) over (partition by pos),0) end,6) as w from v")
def inverse_vol_weights(s, d):
    return signals.inverse_volatility(holes_panel(s, d), 20).select("pos", "symbol", r6("w").alias("w"))


# -- scalar functions


@query("select event_id, sign(value-50)*floor(abs(value-50)/5+1e-9)*5 as q, floor(100000*0.1/value/1+1e-9)*1 as fixed_fraction, round(sign(100000*0.01/(value-60))*floor(abs(100000*0.01/(value-60))+1e-9),6) as fixed_risk from events where value > 0 and value <> 60")
def lot_sizing(s, d):
    v, money = F.col("value"), F.lit(100000.0)
    rows = _read(s, d, "events").filter("value > 0 and value <> 60")
    return rows.select("event_id", trading.lots(v - 50, 5.0).alias("q"), trading.fraction_quantity(money, F.lit(0.1), v).alias("fixed_fraction"), r6(trading.risk_quantity(money, F.lit(0.01), v, F.lit(60.0))).alias("fixed_risk"))


@query(f"{E_DAY} select symbol, ts, round(open*(1+5/1e4),6) as buy, round(open*(1-5/1e4),6) as sell from b")
def slippage_fixed(s, d):
    m, b = trading.FixedSlippage(5.0), events_bars(s, d)
    return b.select("symbol", "ts", r6(m.price(F.col("open"), F.lit(1), F.lit(1.0))).alias("buy"), r6(m.price(F.col("open"), F.lit(-1), F.lit(1.0))).alias("sell"))


@query(f"{E_DAY} select symbol, ts, round(ln(high/low)/sqrt(4*ln(2)),6) as sigma, round(open*(1+case when volume<=0 then 0.1 else least(4/2e4+0.5*ln(high/low)/sqrt(4*ln(2))*sqrt(10/volume),0.1) end),6) as price from b")
def slippage_sqrt_impact(s, d):
    m = trading.RootImpact(0.5, None, 4.0)
    b = events_bars(s, d)
    return b.select("symbol", "ts", r6(trading.range_volatility(F.col("high"), F.col("low"))).alias("sigma"), r6(m.price(F.col("open"), F.lit(1), F.lit(10.0), *[F.col(f) for f in B.FIELDS])).alias("price"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(least(greatest(0.005*l_quantity,1),0.01*l_quantity*l_extendedprice),6) as per_share, round(1/1e4*l_quantity*l_extendedprice,6) as bps from lineitem")
def commission_models(s, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", r6(trading.ShareCommission().fee(q, p)).alias("per_share"), r6(trading.BpsCommission().fee(q, p)).alias("bps"))


_ORDERS_ON_BARS = f"{E_DAY}, o as (select *, (open+low)/2 as lv, (open+high)/2 as hv from b)"


@query(f"{_ORDERS_ON_BARS} select symbol, ts, round(case when open<=lv then open when low<=lv then lv end,6) as buy, round(case when open>=hv then open when high>=hv then hv end,6) as sell, round(case when open<=low then open when low<low then low end,6) as strict_buy from o")
def limit_fill_rule(s, d):
    o, h, lo = F.col("open"), F.col("high"), F.col("low")
    yes, no = F.lit(True), F.lit(False)
    return events_bars(s, d).select("symbol", "ts", r6(trading.limit_fill(yes, (o + lo) / 2, o, h, lo)).alias("buy"), r6(trading.limit_fill(no, (o + h) / 2, o, h, lo)).alias("sell"), r6(trading.limit_fill(yes, lo, o, h, lo, strict=True)).alias("strict_buy"))


@query(f"{_ORDERS_ON_BARS} select symbol, ts, round(case when open>=hv then open when high>=hv then hv end,6) as buy, round(case when open<=lv then open when low<=lv then lv end,6) as sell from o")
def stop_fill_rule(s, d):
    o, h, lo = F.col("open"), F.col("high"), F.col("low")
    return events_bars(s, d).select("symbol", "ts", r6(trading.stop_fill(F.lit(True), (o + h) / 2, o, h, lo)).alias("buy"), r6(trading.stop_fill(F.lit(False), (o + lo) / 2, o, h, lo)).alias("sell"))


@query(f"{E_DAY} select symbol, ts, low > 60 as limit_buy, high < 60 as stop_buy, high < 60 as limit_sell, low > 60 as stop_sell from b")
def idle_orders(s, d):
    h, lo, t = F.col("high"), F.col("low"), F.lit(True)
    on = lambda kind, buy: trading.idle(F.lit(kind), F.lit(buy), F.lit(60.0), h, lo, t)
    return events_bars(s, d).select("symbol", "ts", on("limit", True).alias("limit_buy"), on("stop", True).alias("stop_buy"), on("limit", False).alias("limit_sell"), on("stop", False).alias("stop_sell"))


@query(f"{E_DAY} select symbol, ts, floor(0.1*volume) as cap, round(high-least(0.05*high,3),6) as unused, round(high*(1-0.05),6) as sell_trail, round(low+2,6) as buy_trail from b".replace("round(high-least(0.05*high,3),6) as unused, ", ""))
def participation_cap(s, d):
    none = F.lit(None).cast("double")
    return events_bars(s, d).select("symbol", "ts", trading.participation(F.col("volume"), 0.1).alias("cap"), r6(trading.trail_level(F.lit(True), F.col("high"), F.lit(0.05), none)).alias("sell_trail"), r6(trading.trail_level(F.lit(False), F.col("low"), none, F.lit(2.0))).alias("buy_trail"))


@query("select event_id, case when event_id % 5 = 0 then 'quantity' when event_id % 3 = 0 then 'limit price' end as fault from events")
def order_spec_rules(s, d):
    e = _read(s, d, "events")
    none = F.lit(None).cast("double")
    q = F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(1.0)
    found = trading.order_faults(F.lit("limit"), q, F.when(F.col("event_id") % 3 != 0, F.lit(10.0)), none, none, none)
    return e.select("event_id", F.get(found, F.lit(0)).alias("fault"))


# -- vector path and ledger

_EQUITY = f"""{_SMA_DUE}, wide as (select pos, list(close order by sym_idx) as c, list(open order by sym_idx) as o from p group by pos),
run as (select 0::bigint as pos, 1e6::double as cash, list_transform((select c from wide where pos=0), lambda x: 0.0::double) as q, 1e6::double as equity, 0.0::double as traded, null::double[] as target
 union all
 select n.pos, cash2, q2, cash2 + list_dot_product(n.c, q2), traded2, null from (
  select r.pos, case when t is null then r.cash else r.cash - (list_dot_product(dl, px) + fee) end as cash2, case when t is null then r.q else t end as q2, case when t is null then 0 else tr end as traded2 from (
   select *, tr*1e-4 as fee from (
    select *, case when t is null then 0 else list_sum(list_transform(list_zip(dl, px), lambda z: abs(z[1])*z[2])) end as tr from (
     select *, case when t is not null then list_transform(list_zip(dl, o2), lambda z: z[2]*(1+sign(z[1])*2e-4)) end as px from (
      select *, case when t is not null then list_transform(list_zip(t, q), lambda z: z[1]-z[2]) end as dl from (
       select r.pos, r.cash, r.q, x.o as o2, case when due.ws is not null then list_transform(list_zip(due.ws, w0.c), lambda z: z[1]*r.equity/z[2]) end as t from run r join wide w0 on w0.pos = r.pos join wide x on x.pos = r.pos+1 left join due on due.pos = r.pos))))) r) s join wide n on n.pos = s.pos+1)"""
_EQUITY = _EQUITY.replace("as q, 1e6::double as equity, 0.0::double as traded, null::double[] as target", "as q, 1e6::double as equity, 0.0::double as traded").replace("traded2, null from", "traded2 from")
COSTS = vector.VectorSettings(1e6, 2.0, 1.0)


def sma_weights(s: SparkSession, d: str) -> DataFrame:
    return signals.scheduled(signals.sma_crossover(events_panel(s, d), 3, 7), "change")


def sma_equity(s: SparkSession, d: str) -> DataFrame:
    return vector.equity(events_panel(s, d), sma_weights(s, d), COSTS)


@query(f"{_EQUITY} select pos, round(equity,4) as equity, round(cash,4) as cash, round(traded,4) as traded from run")
def vector_equity(s, d):
    return sma_equity(s, d).select("pos", F.round("equity", 4).alias("equity"), F.round("cash", 4).alias("cash"), F.round("traded", 4).alias("traded"))


@query(f"{_EQUITY}, r as (select pos, equity/lag(equity) over (order by pos)-1 as r from run) select pos, round(r,8) as r from r where r is not null")
def returns_simple(s, d):
    return metrics.returns(sma_equity(s, d)).select("pos", F.round("r", 8).alias("r"))


_CURVE = f"""{E_PANEL}, run as (select symbol as run_id, pos, ts, last_close as equity, last_close*(pos%3)/2.0 as gross from p)"""


def curves(s: SparkSession, d: str) -> DataFrame:
    """Each symbol's closes as the curve of a run: the metrics' input."""
    return events_panel(s, d).select(F.col("symbol").alias("run_id"), "pos", "ts", F.col("last_close").alias("equity"), (F.col("last_close") * (F.col("pos") % 3) / 2.0).alias("gross"), F.lit(1.0).alias("traded"))


_RETURNS = f"{_CURVE}, m as (select run_id, pos, ts, equity/lag(equity) over (partition by run_id order by pos)-1 as r from run), ret as (select * from m where r is not null)"
_DRAW = "dd as (select run_id, pos, equity, max(equity) over (partition by run_id order by pos rows between unbounded preceding and current row) as peak from run)"
_ISLAND = "isl as (select run_id, pos, equity < peak as under, sum((equity >= peak)::int) over (partition by run_id order by pos) as island from dd), dur as (select run_id, max(n) as duration from (select run_id, island, sum(under::int) as n from isl group by 1,2) group by 1)"


@query(f"{_CURVE}, {_DRAW} select run_id, pos, round(1-equity/peak,6) as drawdown from dd")
def drawdown_series(s, d):
    return metrics.drawdowns(curves(s, d)).select("run_id", "pos", r6("drawdown").alias("drawdown"))


@query(f"{_CURVE}, {_DRAW}, {_ISLAND} select run_id, duration::bigint as duration from dur")
def dd_duration(s, d):
    return metrics.longest_drawdown(curves(s, d)).select("run_id", "duration")


@query(f"""{_RETURNS}, {_DRAW}, {_ISLAND}, e as (select run_id, first(equity order by pos) as f, last(equity order by pos) as l, count(*) as n, avg(equity) as me, avg(gross/equity) as ex, avg((gross>0)::int) as im from run group by 1),
q as (select run_id, stddev_samp(r) as sd, avg(r) as mr, sqrt(avg(least(r,0)^2)) as dn from ret group by 1), x as (select run_id, max(1-equity/peak) as mdd from dd group by 1)
select run_id, round(l/f-1,6) as total_return, round((l/f)^(252.0/(n-1))-1,4) as cagr, round(sd*sqrt(252),6) as volatility, round(mr/sd*sqrt(252),6) as sharpe, round(mr/dn*sqrt(252),6) as sortino, round(mdd,6) as max_drawdown, duration::bigint as drawdown_duration, round(n/me/((n-1)/252.0),6) as turnover, round(ex,6) as exposure, round(im,6) as time_in_market from e join q using(run_id) join x using (run_id) join dur using (run_id)""")
def metrics_all(s, d):
    m = metrics.summary(curves(s, d))
    return m.select("run_id", r6("total_return").alias("total_return"), F.round("cagr", 4).alias("cagr"), *[r6(c).alias(c) for c in ("volatility", "sharpe", "sortino", "max_drawdown")], "drawdown_duration", r6("turnover").alias("turnover"), r6("exposure").alias("exposure"), r6("time_in_market").alias("time_in_market"))


@query(f"{E_PANEL}, f as (select symbol, last_close as base from p where pos=0 and last_close is not null) select pos, round(avg(last_close/base)*1e6,4) as equity from p join f using (symbol) group by 1")
def buy_hold_curve(s, d):
    return metrics.buy_and_hold(events_panel(s, d)).select("pos", F.round("equity", 4).alias("equity"))


@query(f"""{_RETURNS}, bh as (select pos, avg(last_close/base) as e from p join (select symbol, last_close as base from p where pos=0) using (symbol) group by 1), bb as (select pos, e/lag(e) over (order by pos)-1 as b from bh), j as (select run_id, r, b, r-b as d from ret join bb using (pos) where b is not null)
select run_id, round(covar_samp(r,b)/var_samp(b),6) as beta, round((avg(r)-covar_samp(r,b)/var_samp(b)*avg(b))*252,6) as alpha, round(stddev_samp(d)*sqrt(252),6) as tracking_error, round(avg(d)/stddev_samp(d)*sqrt(252),6) as information_ratio, round(corr(r,b),6) as correlation, round(avg(b)/stddev_samp(b)*sqrt(252),6) as bench_sharpe from j group by 1""")
def benchmark_relative(s, d):
    held = metrics.buy_and_hold(events_panel(s, d)).withColumn("run_id", F.lit(0))
    bench = metrics.returns(held).select("pos", F.col("r").alias("b"))
    got = metrics.against(metrics.returns(curves(s, d)), bench)
    return got.select("run_id", *[r6(c).alias(c) for c in ("beta", "alpha", "tracking_error", "information_ratio", "correlation", "bench_sharpe")])


@query(f"{_RETURNS} select run_id, pos, round(case when count(*) over w = 10 and stddev_samp(r) over w > 0 then avg(r) over w/stddev_samp(r) over w*sqrt(252) end,6) as rolling_sharpe, round(case when count(*) over w = 10 then stddev_samp(r) over w*sqrt(252) end,6) as rolling_volatility from ret window w as (partition by run_id order by pos rows between 9 preceding and current row)")
def rolling_sharpe(s, d):
    got = metrics.rolling_sharpe(metrics.returns(curves(s, d)), 10)
    return got.select("run_id", "pos", r6("rolling_sharpe").alias("rolling_sharpe"), r6("rolling_volatility").alias("rolling_volatility"))


@query(f"{_RETURNS} select run_id, year(ts)::int as year, month(ts)::int as month, round(product(1+r)-1,6) as r from ret group by 1,2,3 union all select run_id, year(ts)::int, 0, round(product(1+r)-1,6) from ret group by 1,2")
def monthly_returns(s, d):
    return metrics.monthly_returns(metrics.returns(curves(s, d))).select("run_id", "year", "month", r6("r").alias("r"))


@query(f"{_RETURNS}, v as (select run_id, quantile_cont(r,0.05) as var from ret group by 1) select run_id, round(any_value(var),6) as var, round(avg(r) filter (r <= var),6) as cvar from ret join v using (run_id) group by 1")
def var_cvar(s, d):
    return metrics.tail_risk(metrics.returns(curves(s, d))).select("run_id", r6("var").alias("var"), r6("cvar").alias("cvar"))


@query(f"{_RETURNS}, e as (select run_id, min(r) as lo, max(r) as hi from ret group by 1) select run_id, least(floor((r-lo)/((hi-lo)/10)),9)::bigint as bin, count(*) as n from ret join e using (run_id) group by 1,2")
def histogram_returns(s, d):
    return metrics.histogram(metrics.returns(curves(s, d)), 10)


@query(f"{_RETURNS}, x as (select run_id, pos, ts, r, row_number() over (partition by run_id, date_trunc('month', ts) order by ts desc) as k from ret) select run_id, pos, round(r,6) as r from x where k=1")
def month_end_rows(s, d):
    return metrics.month_ends(metrics.returns(curves(s, d))).select("run_id", "pos", r6("r").alias("r"))


_FILLS = """fl as (select user_id % 7 as run_id, event_id as seq, ts, event_type as symbol, case when event_id % 2 = 0 then 1 else -1 end * (1 + event_id % 5)::double as quantity, 50+50*value/(value+50) as price, 0.5::double as commission from events)"""


def demo_fills(s: SparkSession, d: str) -> DataFrame:
    """Events as fills of seven runs."""
    e = _read(s, d, "events")
    side = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    return e.select((F.col("user_id") % 7).alias("run_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("symbol"), (side * (1 + F.col("event_id") % 5)).alias("quantity"), (50 + 50 * F.col("value") / (F.col("value") + 50)).alias("price"), F.lit(0.5).alias("commission"))


@query(f"with {_FILLS} select run_id, seq, round(1e6-sum(quantity*price+commission) over (partition by run_id order by seq rows between unbounded preceding and current row),4) as cash from fl")
def running_cash(s, d):
    return ledger.cash(demo_fills(s, d), 1e6).select("run_id", "seq", F.round("cash", 4).alias("cash"))


@query(f"""with recursive {_FILLS}, o as (select *, row_number() over (partition by run_id, symbol order by seq) as k from fl),
st as (select run_id, symbol, 0::bigint as k, 0.0::double as q, 0.0::double as c, 0.0::double as rz from (select distinct run_id, symbol from o)
 union all select o.run_id, o.symbol, o.k, case when st.q<>0 and sign(st.q)<>sign(o.quantity) and abs(abs(o.quantity)-abs(st.q))<=1e-9 then 0 else st.q+o.quantity end,
  case when st.q=0 or sign(st.q)=sign(o.quantity) then (abs(st.q)*st.c+abs(o.quantity)*o.price)/(abs(st.q)+abs(o.quantity)) when abs(abs(o.quantity)-abs(st.q))<=1e-9 then 0 when abs(o.quantity)<abs(st.q) then st.c else o.price end,
  case when st.q=0 or sign(st.q)=sign(o.quantity) then st.rz else st.rz+sign(st.q)*least(abs(o.quantity),abs(st.q))*(o.price-st.c) end
 from st join o on o.run_id=st.run_id and o.symbol=st.symbol and o.k=st.k+1)
select run_id, symbol, round(last(q order by k),6) as quantity, round(last(c order by k),5) as cost, round(last(rz order by k),4) as realized from st group by 1,2""")
def position_avg_cost(s, d):
    return ledger.positions(demo_fills(s, d)).select("run_id", "symbol", r6("quantity").alias("quantity"), F.round("cost", 5).alias("cost"), F.round("realized", 4).alias("realized"))


_HELD = f"""{E_PANEL}, {_FILLS}, mv as (select run_id, symbol, date_trunc('day', ts)::timestamp as ts, sum(quantity) as m from fl group by 1,2,3), g as (select r.run_id, p.pos, p.ts, p.symbol, p.last_close from (select distinct run_id from fl) r cross join p),
hd as (select g.run_id, g.pos, g.symbol, sum(coalesce(m,0)) over (partition by g.run_id, g.symbol order by g.pos rows between unbounded preceding and current row) as q, last_close from g left join mv on mv.run_id=g.run_id and mv.symbol=g.symbol and mv.ts=g.ts)"""


def demo_held(s: SparkSession, d: str) -> DataFrame:
    daily = demo_fills(s, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return ledger.held(daily, events_panel(s, d))


@query(f"{_HELD} select run_id, pos, round(sum(q*last_close),4) as net, round(sum(abs(q*last_close)),4) as gross from hd group by 1,2")
def exposure_series(s, d):
    return ledger.exposures(demo_held(s, d)).select("run_id", "pos", F.round("net", 4).alias("net"), F.round("gross", 4).alias("gross"))


@query(f"{_HELD} select run_id, pos, round(-sum(least(q*last_close,0))*0.03/252,6) as fee from hd group by 1,2")
def borrow_cost(s, d):
    return ledger.borrow_fees(ledger.exposures(demo_held(s, d)), 0.03).select("run_id", "pos", r6("fee").alias("fee"))


@query(f"{_EQUITY}, g as (select r.pos, abs(r.equity - r.cash - list_dot_product(w.c, r.q)) > 0.1 as bad from run r join wide w using (pos)) select count(*) filter (bad) as n_bad, count(*) as n from g")
def identity_check(s, d):
    curve = sma_equity(s, d)
    net = curve.join(B.arrays(events_panel(s, d), "close").select("pos", "close"), "pos").select("run_id", "pos", F.aggregate(F.zip_with("close", "shares", lambda c, q: c * q), F.lit(0.0), lambda a, x: a + x).alias("net"))
    bad = ledger.unbalanced(curve, net, 1e6)
    return curve.agg(F.count("*").alias("n")).crossJoin(bad.agg(F.count("*").alias("n_bad"))).select("n_bad", "n")


@query("with w as (select event_type symbol, case event_type when 'click' then 0.0 else 0.15 end as w from (select distinct event_type from events)), h as (select event_type symbol, (count(*) % 40)::double as q from events group by 1), px as (select event_type symbol, avg(50+50*value/(value+50)) as price from events group by 1), j as (select symbol, coalesce(w,0) as w, coalesce(q,0) as q, price from w full join h using (symbol) join px using (symbol)), k as (select symbol, price, case when w=0 and q<>0 then -q when (q=0 and w<>0) or abs(w-q*price/100000)>0.01 then floor(w*100000/price+1e-9)-q else 0 end as quantity from j) select symbol, round(quantity,6) as quantity from k where quantity<>0 and abs(quantity)*price>=0")
def rebalance_orders(s, d):
    e = _read(s, d, "events").withColumnRenamed("event_type", "symbol")
    w = e.select("symbol", F.when(F.col("symbol") == "click", 0.0).otherwise(0.15).alias("w")).distinct()
    q = e.groupBy("symbol").agg((F.count("*") % 40).cast("double").alias("q"))
    p = e.groupBy("symbol").agg(F.avg(50 + 50 * F.col("value") / (F.col("value") + 50)).alias("price"))
    return ledger.rebalance_orders(w, q, p, 100000.0, band=0.01).select("symbol", r6("quantity").alias("quantity"))


@query("with w as (select user_id % 50 as pos, event_type symbol, avg(value)/100-0.3 as w from events group by 1,2), c as (select pos, symbol, least(greatest(greatest(w,0),-0.25),0.25) as w from w), g as (select *, sum(abs(w)) over (partition by pos) as g from c) select pos, symbol, round(case when g>0.5 then w*0.5/g else w end,6) as w from g")
def constrain_weights(s, d):
    w = _read(s, d, "events").groupBy((F.col("user_id") % 50).alias("pos"), F.col("event_type").alias("symbol")).agg((F.avg("value") / 100 - 0.3).alias("w"))
    return ledger.constrained(w, 0.25, 0.5, False).select("pos", "symbol", r6("w").alias("w"))


@query(f"{_CURVE}, {_DRAW} select run_id, min(pos) as pos from dd where 1-equity/peak >= 0.05 group by 1")
def kill_switch_detect(s, d):
    return ledger.kill_switch(curves(s, d), 0.05).select("run_id", "pos")


_TRIPS = f"""{E_PANEL}, {_FILLS}, fa as (select run_id, seq, date_trunc('day', ts)::timestamp as ts, symbol, quantity, price, commission, sum(quantity) over (partition by run_id, symbol order by seq rows unbounded preceding) as aft from fl), fb as (select *, aft-quantity as bef from fa),
pc as (select run_id, symbol, seq, ts, price, 0 as k, case when bef*aft<0 then -bef else quantity end as q, bef*aft>=0 and bef=0 as st, commission*abs(case when bef*aft<0 then bef else quantity end/quantity) as fee, case when bef*aft<0 then 0 else aft end as held from fb
 union all select run_id, symbol, seq, ts, price, 1, aft, true, commission*abs(aft/quantity), aft from fb where bef*aft<0),
nu as (select *, sum(st::int) over (partition by run_id, symbol order by seq, k rows unbounded preceding) as trip from pc), nq as (select *, first_value(q) over (partition by run_id, symbol, trip order by seq, k) as q0 from nu),
tg as (select run_id, symbol, trip, sign(any_value(q0)) as side, min(ts) as entry_time, last(ts order by seq, k) as last_ts, abs(last(held order by seq, k)) as held, max(abs(held)) as quantity, sum(abs(q)) filter (sign(q)=sign(q0)) as iq, sum(abs(q)*price) filter (sign(q)=sign(q0)) as iv, sum(abs(q)) filter (sign(q)<>sign(q0)) as oq, coalesce(sum(abs(q)*price) filter (sign(q)<>sign(q0)),0) as ov, sum(fee) as commission from nq group by 1,2,3),
lp as (select symbol, last(last_close order by pos) as lc from p group by 1), tt as (select *, case when held=0 then last_ts end as exit_time, side*(ov+held*lc-iv) as pnl from tg join lp using (symbol)),
trips as (select run_id, symbol, case when side>0 then 'long' else 'short' end as direction, case when held>0 then 'open' else 'closed' end as status, entry_time, exit_time, quantity, iv/iq as entry_price, ov/oq as exit_price, pnl, commission, pnl-commission as net_pnl, (pnl-commission)/iv as ret, coalesce(x.pos, (select max(pos) from cal))-e.pos as bars_held from tt join cal e on e.ts=entry_time left join cal x on x.ts=exit_time)"""


def demo_trips(s: SparkSession, d: str) -> DataFrame:
    p = B.panel(events_bars(s, d))
    daily = demo_fills(s, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    last = p.groupBy("symbol").agg(F.max_by("last_close", "pos").alias("last_close"))
    return ledger.round_trips(daily, B.calendar(events_bars(s, d)), last)


@query(f"{_TRIPS} select run_id, symbol, direction, status, entry_time, exit_time, quantity, round(entry_price,6) as entry_price, round(exit_price,6) as exit_price, round(pnl,5) as pnl, round(commission,6) as commission, round(net_pnl,5) as net_pnl, round(ret,6) as return, bars_held from trips")
def round_trips(s, d):
    t = demo_trips(s, d)
    rounded = {"entry_price": 6, "exit_price": 6, "pnl": 5, "commission": 6, "net_pnl": 5, "return": 6}
    return t.select("run_id", "symbol", "direction", "status", "entry_time", "exit_time", "quantity", *[F.round(c, n).alias(c) for c, n in rounded.items()], "bars_held")


@query(f"{_TRIPS}, cl as (select * from trips where status='closed') select run_id, count(*) as n_trades, round(avg((net_pnl>0)::int),6) as hit_rate, round(sum(net_pnl) filter (net_pnl>0)/-sum(net_pnl) filter (net_pnl<0),6) as profit_factor, round(avg(net_pnl) filter (net_pnl>0),6) as avg_win, round(avg(net_pnl) filter (net_pnl<0),6) as avg_loss, round(avg(net_pnl),6) as avg_trade, round(avg(bars_held),6) as avg_bars from cl group by 1")
def trade_stats(s, d):
    return metrics.trade_stats(demo_trips(s, d)).select("run_id", "n_trades", *[r6(c).alias(c) for c in ("hit_rate", "profit_factor", "avg_win", "avg_loss", "avg_trade", "avg_bars")])


@query(f"{_CURVE}, tp as (select run_id, max(pos) as top from run group by 1), sp as (select run_id, pos, equity, floor(pos*6/(top+1)) as span from run join tp using (run_id)), sd as (select *, row_number() over (partition by run_id, span order by pos) as a, row_number() over (partition by run_id, span order by pos desc) as b, row_number() over (partition by run_id, span order by equity, pos) as c, row_number() over (partition by run_id, span order by equity desc, pos desc) as e from sp) select run_id, pos, round(equity,6) as equity from sd where 1 in (a,b,c,e)")
def chart_points(s, d):
    return metrics.decimated(curves(s, d), "equity", 6).select("run_id", "pos", r6("equity").alias("equity"))


# -- research

GRID = {"fast": [2, 3], "slow": [5, 7, 9]}


@query("select (a.i*3+b.i)::bigint as cfg_idx, a.v as fast, b.v as slow, 'fast=' || a.v || ', slow=' || b.v as label from (values (0,2),(1,3)) a(i,v) cross join (values (0,5),(1,7),(2,9)) b(i,v)".replace("a.v as fast", "a.v::bigint as fast").replace("b.v as slow", "b.v::bigint as slow"))
def grid_expand(s, d):
    return research.grid_table(s, GRID)


@query("with k as (select range as k from range(0, 40)) select k as \"window\", 50+k*100 as train_start, 50+k*100+299 as train_end, 50+k*100+300 as test_start, least(50+k*100+399, 999) as test_end from k where 50+k*100+300 < 1000")
def wf_windows(s, d):
    return research.windows_table(s, 1000, 300, 100, start=50).select("window", "train_start", "train_end", "test_start", F.col("test_end").cast("long"))


def sma_grid(s: SparkSession, d: str) -> DataFrame:
    return research.run_grid(events_panel(s, d), "sma_crossover", research.expand(GRID), COSTS)


@query()
def grid_rank(s, d):
    return research.ranked(sma_grid(s, d), research.expand(GRID))


@query()
def walk_forward(s, d):
    return research.walk_forward(events_bars(s, d), "sma_crossover", {"fast": [2], "slow": [4, 5]}, 14, 8, COSTS)[0]


# -- inference

_PERF = f"{_RETURNS}, perf as (select (dense_rank() over (order by run_id)-1)::bigint as cfg_idx, pos as t, r as ret from ret)"


def perf(s: SparkSession, d: str) -> DataFrame:
    """Each symbol as a configuration."""
    own = metrics.returns(curves(s, d))
    names = own.select("run_id").distinct().withColumn("cfg_idx", (F.row_number().over(W.orderBy("run_id")) - 1).cast("long"))  # one row a configuration
    return own.join(names, "run_id").select("cfg_idx", F.col("pos").alias("t"), F.col("r").alias("ret"))


_MOMENTS = f"{_RETURNS}, c as (select run_id, r, r-avg(r) over (partition by run_id) as e from ret), mo as (select run_id, count(*) as n, avg(r)/stddev_samp(r) as sr, avg(e^3)/avg(e^2)^1.5 as skew, avg(e^4)/avg(e^2)^2 as kurt from c group by 1)"


@query(f"{_MOMENTS} select run_id, n, round(sr,6) as sr, round(skew,6) as skew, round(kurt,6) as kurt from mo")
def sample_moments(s, d):
    return inference.moments(metrics.returns(curves(s, d))).select("run_id", "n", *[r6(c).alias(c) for c in ("sr", "skew", "kurt")])


@query(f"{_MOMENTS} select run_id, round(sqrt((1-skew*sr+(kurt-1)/4*sr*sr)/(n-1)),6) as se, case when sr <= 0 then 'infinity'::double else round(1+(1-skew*sr+(kurt-1)/4*sr*sr)*(1.6448536269514715/sr)^2,3) end as mintrl from mo")
def mintrl(s, d):
    m = inference.moments(metrics.returns(curves(s, d)))
    args = F.col("sr"), F.col("skew"), F.col("kurt")
    return m.select("run_id", r6(inference.standard_error(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"))).alias("se"), F.round(inference.track_record(*args), 3).alias("mintrl"))


@query()
def psr_dsr(s, d):
    return inference.probabilities(inference.moments(metrics.returns(curves(s, d))))


@query(f"{_RETURNS}, c as (select run_id, pos, r-avg(r) over (partition by run_id) as e, count(*) over (partition by run_id) as n from ret) select a.run_id, l.range::int as lag, round(sum(a.e*b.e)/any_value(a.n),8) as acov from c a cross join range(0,6) l join c b on b.run_id=a.run_id and b.pos=a.pos-l.range group by 1,2")
def acov_lags(s, d):
    return resampling.lags(metrics.returns(curves(s, d)), 5).select("run_id", F.col("lag").cast("int"), F.round("acov", 8).alias("acov"))


_BLOCKS = f"{_PERF}, z as (select count(distinct t)//4 as sz, max(t) as last from perf), u as (select cfg_idx, t, ret, 3-(last-t)//sz as block, ret-avg(ret) over (partition by cfg_idx) as x from perf, z where last-t < sz*4), bl as (select block, cfg_idx, sum(x) as s1, sum(x*x) as s2, count(*) as n from u group by 1,2), ce as (select cfg_idx, avg(ret) as c from u group by 1)"
_COMBOS = f"{_BLOCKS}, cm as (select range as combo from range(0,16) where bit_count(range::bigint)=2), sm as (select combo, cfg_idx, sum(s1) filter ((combo>>block)&1=1) as a1, sum(s2) filter ((combo>>block)&1=1) as a2, sum(n) filter ((combo>>block)&1=1) as an, sum(s1) filter ((combo>>block)&1=0) as b1, sum(s2) filter ((combo>>block)&1=0) as b2, sum(n) filter ((combo>>block)&1=0) as bn from (select combo, cfg_idx, block::int as block, s1, s2, n from cm, bl) group by 1,2), pf as (select combo, sm.cfg_idx, (a1/an+c)/sqrt((a2-a1*a1/an)/(an-1)) as train, (b1/bn+c)/sqrt((b2-b1*b1/bn)/(bn-1)) as test from sm join ce on ce.cfg_idx=sm.cfg_idx), rk as (select *, row_number() over (partition by combo order by train desc, cfg_idx) as place, rank() over (partition by combo order by test)-1 as below, count(*) over (partition by combo, test) as ties, count(*) over (partition by combo) as n from pf), lg as (select combo, cfg_idx as selected, train as is_perf, test as oos_perf, (below+(ties+1)/2)/(n+1) as w from rk where place=1)"


@query(f"{_BLOCKS} select block::int as block, cfg_idx, round(s1,8) as s1, round(s2,8) as s2 from bl")
def cscv_blocks(s, d):
    return overfitting.blocks(perf(s, d), 4).select("block", "cfg_idx", F.round("s1", 8).alias("s1"), F.round("s2", 8).alias("s2"))


@query(f"{_COMBOS} select combo, selected, round(is_perf,6) as is_perf, round(oos_perf,6) as oos_perf, round(ln(w/(1-w)),6) as logit from lg")
def pbo_logits(s, d):
    got = overfitting.logits(overfitting.performances(overfitting.blocks(perf(s, d), 4), 4))
    return got.select("combo", "selected", *[r6(c).alias(c) for c in ("is_perf", "oos_perf", "logit")])


@query(f"{_COMBOS} select count(*) as n_combinations, round(avg((ln(w/(1-w))<=0)::int),6) as pbo, round(avg((oos_perf<0)::int),6) as prob_loss, round(regr_slope(oos_perf,is_perf),5) as slope from lg")
def pbo_summary(s, d):
    return overfitting.pbo(perf(s, d), 4).select("n_combinations", r6("pbo").alias("pbo"), r6("prob_loss").alias("prob_loss"), F.round("slope", 5).alias("slope"))


_FOLDS = "with o as (select range as obs, range-4 as s, range as e from range(0,50)), t as (select (obs//10)::int as split, obs from o)"


@query(f"{_FOLDS}, bk as (select split, min(s) as lo, max(e) as hi from t join o using (obs) group by 1), rs as (select split, lo, hi, (select min(obs) from o where o.s > bk.hi) as res from bk) select k.split, o.obs from rs k cross join o where not (o.s <= k.hi and o.e >= k.lo) and not coalesce(o.obs >= k.res and o.obs < k.res+3, false) and not exists (select 1 from t where t.split=k.split and t.obs=o.obs)")
def purged_kfold(s, d):
    obs = crossval.spans(s, 50, 4)
    return crossval.training(crossval.kfold_tests(obs, 50, 5), obs, 3)


_CP = "with g as (select range as g from range(0,6)), pr as (select a.g as g1, b.g as g2, row_number() over (order by a.g,b.g)-1 as split from g a join g b on a.g<b.g), tb as (select split, g1 as g from pr union all select split, g2 from pr)"


@query(f"{_CP}, o as (select range as obs, case when range < 12 then range//3 else 4+(range-12)//2 end as g from range(0,16)) select split::int as split, g::int as \"group\", obs from tb join o using (g)".replace("range//3 else 4+(range-12)//2", "range//3 else 4+(range-12)//2"))
def cpcv_splits(s, d):
    return crossval.combinatorial_tests(crossval.spans(s, 16), 16, 6, 2)


@query(f"{_CP} select (row_number() over (partition by g order by split)-1)::int as path, g::int as \"group\", split::int as split from tb")
def cpcv_paths(s, d):
    return crossval.path_splits(s, 6, 2)


@query(f"{_PERF}, ob as (select range as obs, case when range<25 then range//5 else 5+(range-25)//4 end as g from range(0,29)), pr as (select a.range as g1, b.range as g2, row_number() over (order by a.range, b.range)-1 as split from range(0,6) a, range(0,6) b where a.range<b.range), ts_ as (select split, obs from pr join ob on g=g1 or g=g2), tr as (select split, obs from pr cross join ob where not exists (select 1 from ts_ where ts_.split=pr.split and ob.obs between ts_.obs-1 and ts_.obs+1)), sc as (select split, cfg_idx, avg(ret)/stddev_samp(ret) as score from tr join perf on perf.t-1=tr.obs group by 1,2), pk as (select *, row_number() over (partition by split order by score desc, cfg_idx) as k from sc) select split::int as split, cfg_idx, round(score,6) as score from pk where k=1")
def cpcv_select(s, d):
    p = perf(s, d).withColumn("t", F.col("t") - 1)
    return crossval.cpcv(p, 29, 6, 2, lookback=1)[0].select("split", "cfg_idx", r6("score").alias("score"))


@query(f"""{_RETURNS}, z as (select run_id, count(*) as n, greatest(5,ceil(sqrt(log10(count(*))))) as k, ceil(least(3*sqrt(count(*)),count(*)/3.0)) as most, 2*sqrt(log10(count(*))/count(*)) as noise from ret group by 1), zz as (select *, ceil(sqrt(n))+k as top from z),
ee as (select run_id, row_number() over (partition by run_id order by pos) as i, r-avg(r) over (partition by run_id) as e from ret), ac as (select zz.run_id, l.range as lag, coalesce(sum(a.e*b.e),0)/any_value(n) as acov from zz join range(0,200) l on l.range<=top join ee a on a.run_id=zz.run_id left join ee b on b.run_id=a.run_id and b.i=a.i+l.range group by 1,2),
qt as (select ac.run_id, lag, abs(acov) < noise*max(acov) filter (lag=0) over (partition by ac.run_id) as quiet, k, top from ac join zz using (run_id)), st as (select a.run_id, min(a.lag) as m from qt a where a.lag>=1 and a.lag+a.k-1<=a.top and (select bool_and(quiet) from qt b where b.run_id=a.run_id and b.lag between a.lag and a.lag+a.k-1) group by 1),
wd as (select zz.run_id, n, most, least(coalesce(2*m,top),top) as width from zz left join st using (run_id)), sm as (select run_id, any_value(n) as n, any_value(most) as most, any_value(width) as width, sum(greatest(0,least(1,2*(1-lag/width)))*case when lag=0 then 1 else 2 end*acov) as g0, sum(greatest(0,least(1,2*(1-lag/width)))*2*lag*acov) as g1 from ac join wd using (run_id) group by 1)
select run_id, round(least(greatest(cbrt(2*g1*g1*n/(2*g0*g0)),1),most),5) as stationary, round(least(greatest(cbrt(2*g1*g1*n/(4/3.0*g0*g0)),1),most),5) as circular, width::bigint as bandwidth from sm""")
def block_lengths(s, d):
    return resampling.block_lengths(metrics.returns(curves(s, d))).select("run_id", F.round("stationary", 5).alias("stationary"), F.round("circular", 5).alias("circular"), "bandwidth")


@query()
def bootstrap_ci(s, d):
    series = [r.r for r in metrics.returns(sma_equity(s, d)).orderBy("pos").select("r").collect()]  # one run's returns: the calendar
    return resampling.intervals(s, series, n_samples=500, block=3.0)


@query()
def family_validation(s, d):
    got = validation.validate_family(perf(s, d), 8, lookback=1, n_samples=300)
    return s.createDataFrame([(got.best, got.sharpe, got.dsr, got.splits, got.pbo, len(got.path_sharpes), got.format())], "best long, sharpe double, dsr double, splits int, pbo double, n_paths int, report string")


@query()
def strategy_validation(s, d):
    got = validation.validate_returns(metrics.returns(sma_equity(s, d)).select("run_id", "pos", "r"), trials=6, trial_variance=0.01, n_samples=300)
    return s.createDataFrame([(got.n, got.sharpe, got.psr, got.dsr, got.track_record, got.format())], "n long, sharpe double, psr double, dsr double, track_record double, report string")


@query()
def spa_test(s, d):
    wide = perf(s, d).groupBy("t").pivot("cfg_idx", [0, 1, 2, 3, 4]).agg(F.first("ret")).orderBy("t").toPandas().drop(columns="t")  # the calendar
    return resampling.superior_ability(s, wide.to_numpy(), 500, 3.0).select("statistic", "rc_pvalue", "p_lower", "p_consistent", "p_upper")


# -- allocation


def asset_returns(s: SparkSession, d: str) -> DataFrame:
    own = W.partitionBy("symbol").orderBy("pos")
    return events_panel(s, d).withColumn("r", F.col("last_close") / F.lag("last_close").over(own) - 1).filter("r is not null").select("pos", "sym_idx", "r")


_COV = f"{E_PANEL}, ar as (select pos, sym_idx, last_close/lag(last_close) over (partition by symbol order by pos)-1 as r from p), cv as (select a.sym_idx as i, b.sym_idx as j, covar_samp(a.r,b.r) as cov from ar a join ar b using (pos) where a.r is not null and b.r is not null group by 1,2)"


@query(f"{_COV} select i::int as i, j::int as j, round(cov,8) as cov from cv")
def covariance_sample(s, d):
    return allocation.covariance(asset_returns(s, d)).select("i", "j", F.round("cov", 8).alias("cov"))


@query(f"{_COV}, m as (select i, sum(cov*0.2)*0.2 as part from cv group by 1) select i::int as sym_idx, round(part/(select sum(part) from m),6) as share from m")
def risk_contributions(s, d):
    w = asset_returns(s, d).select("sym_idx").distinct().withColumn("w", F.lit(0.2))
    return allocation.risk_contributions(w, allocation.covariance(asset_returns(s, d))).select("sym_idx", r6("share").alias("share"))


def _allocated(method: str):
    def run(s, d):
        return allocation.allocated(events_panel(s, d), method, 20, months=False).select("pos", "symbol", r6("w").alias("w"))

    run.__name__ = f"allocation_{method}"
    return run


_ALLOCATED = {
    "ew": f"{E_PANEL} select pos, symbol, round(1.0/count(*) over (partition by pos),6) as w from p where pos>=20",
    "iv": f"{E_PANEL}, mv as (select pos, symbol, last_close/lag(last_close) over (partition by symbol order by pos)-1 as r from p), v as (select pos, symbol, 1/stddev_samp(r) over (partition by symbol order by pos rows between 19 preceding and current row) as i from mv) select pos, symbol, round(i/sum(i) over (partition by pos),6) as w from v where pos>=20",
}
for _m in allocation.ALLOCATORS:
    query(_ALLOCATED.get(_m))(_allocated(_m))


# -- order-level runs


@query()
def event_engine_run(s, d):
    """The order kernel on the weights of the vector path, which it must agree with."""
    b = events_bars(s, d)
    names = B.universe(b)
    w = sma_weights(s, d).withColumn("run_id", F.lit(0).cast("long")).select("run_id", "pos", "symbol", "w").join(names.select("symbol"), "symbol")
    rules = orderbook.Rules(slippage=trading.FixedSlippage(2.0), commission=trading.BpsCommission(1.0), lot=None)
    out = simulate.simulate(b, s.range(1).withColumnRenamed("id", "run_id"), lambda row: orderbook.Rule(), rules, weights=w)
    return simulate.equity(out).select("pos", F.round("equity", 4).alias("equity"))


SQL["event_engine_run"] = f"{_EQUITY} select pos, round(equity,4) as equity from run"


@query()
def bracket_engine_run(s, d):
    runs = s.createDataFrame([(0, "worst"), (1, "best"), (2, "high_first"), (3, "low_first")], "run_id long, path string")
    out = simulate.simulate(events_bars(s, d, "hour"), runs, lambda row: orderbook.BreakoutRule(10), lambda row: orderbook.Rules(intrabar=row["path"], participation=0.5, lot=None))
    return simulate.fills(out)


@query()
def bracket_consistency(s, d):
    """Must have no faults; that is a property of the kernel, not of the tables, so there is no SQL for it."""
    runs = s.createDataFrame([(0, "worst"), (1, "best")], "run_id long, path string")
    out = simulate.simulate(events_bars(s, d, "hour"), runs, lambda row: orderbook.BreakoutRule(10), lambda row: orderbook.Rules(intrabar=row["path"], lot=None))
    return simulate.inconsistent(simulate.orders(out)).agg(F.count("*").alias("n_faults"))


@query(f"""{E_HOUR}, {_PANEL}, q as (select pos, symbol, close*0.985 as buy, close*0.98 as sell from p where has_bar), n as (select q.pos+1 as pos, q.symbol, buy, sell, open, low from q join p on p.pos=q.pos+1 and p.symbol=q.symbol where p.has_bar)
select pos, symbol, 1 as side, round(case when open<=buy then open else buy end,6) as price from n where low<=buy union all select pos, symbol, -1, round(case when open<=sell then open else sell end,6) from n where low<=sell""")
def day_orders_run(s, d):
    """Day orders through the order kernel, which its fill rules in SQL must agree with."""
    out = simulate.simulate(events_bars(s, d, "hour"), s.range(1).withColumnRenamed("id", "run_id"), lambda row: orderbook.QuoteRule())
    return simulate.fills(out).select("pos", "symbol", F.signum("quantity").cast("int").alias("side"), r6("price").alias("price"))


@query()
def synthetic_market(s, d):
    return synthetic.market(s, synthetic.MarketSpec(3, 252))


def flagship(s: SparkSession, d: str) -> DataFrame:
    return sma_equity(s, d).select("run_id", "pos", "ts", "equity", "cash", "gross", "traded")
