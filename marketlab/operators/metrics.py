"""Statistics of equity and return series, for all runs at once.

Equity tables have ``run_id``, ``pos`` and ``equity`` (with ``gross`` and
``traded`` for turnover and exposure); return tables ``run_id``, ``pos`` and
``r``. What is undefined is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 252.0


def _line(*keys: str):
    return W.partitionBy(*(keys or ("run_id",))).orderBy("pos")


def returns(equity: DataFrame, cash: float | None = None) -> DataFrame:
    """Simple returns ``r``; the first row is left out, or taken against ``cash``."""
    before = F.lag("equity").over(_line())
    if cash is not None:
        before = F.coalesce(before, F.lit(float(cash)))
    return equity.withColumn("r", F.try_divide(F.col("equity"), before) - 1).filter(F.col("r").isNotNull())


def drawdowns(equity: DataFrame) -> DataFrame:
    """``drawdown`` below the running peak."""
    peak = F.max("equity").over(_line().rowsBetween(W.unboundedPreceding, 0))
    return equity.withColumns({"peak": peak, "drawdown": 1 - F.try_divide(F.col("equity"), peak)})


def longest_drawdown(equity: DataFrame) -> DataFrame:
    """``duration``: the most bars in a row strictly below the running peak."""
    marked = drawdowns(equity).withColumn("under", F.col("equity") < F.col("peak"))
    island = marked.withColumn("island", F.sum((~F.col("under")).cast("int")).over(_line().rowsBetween(W.unboundedPreceding, 0)))
    spans = island.groupBy("run_id", "island").agg(F.sum(F.col("under").cast("long")).alias("n"))
    return spans.groupBy("run_id").agg(F.max("n").alias("duration"))


def sharpe(r: Column, risk_free: float = 0.0, periods: float = YEAR) -> Column:
    deviation = F.stddev_samp(r)
    return F.when(deviation > 0, F.avg(r - risk_free / periods) / deviation * math.sqrt(periods))


def downside(r: Column, target: float = 0.0) -> Column:
    return F.sqrt(F.avg(F.pow(F.least(r - target, F.lit(0.0)), 2)))


def sortino(r: Column, risk_free: float = 0.0, periods: float = YEAR) -> Column:
    mean, down = F.avg(r - risk_free / periods), downside(r, risk_free / periods)
    return F.when(down > 0, mean / down * math.sqrt(periods)).when(mean > 0, float("inf"))


def cagr(first: Column, last: Column, n: Column, periods: float = YEAR) -> Column:
    return F.when((n < 2) | (first <= 0), None).when(last <= 0, -1.0).otherwise(F.pow(F.try_divide(last, first), F.try_divide(F.lit(periods), n - 1)) - 1)


def summary(equity: DataFrame, periods: float = YEAR, risk_free: float = 0.0) -> DataFrame:
    """One row a run with all metrics of its curve."""
    curve = equity.groupBy("run_id").agg(
        F.min_by("equity", "pos").alias("first"), F.max_by("equity", "pos").alias("last"), F.count("equity").alias("n"), F.avg("equity").alias("mean_equity"), F.sum("traded").alias("traded"),
        F.avg(F.when(F.col("equity") > 0, F.col("gross") / F.col("equity")).otherwise(F.lit(float("nan")))).alias("exposure"), F.avg((F.col("gross") > 0).cast("double")).alias("time_in_market"),
    )
    r = F.col("r")
    moves = returns(equity).groupBy("run_id").agg(
        (F.stddev_samp(r) * math.sqrt(periods)).alias("volatility"), sharpe(r, risk_free, periods).alias("sharpe"), sortino(r, risk_free, periods).alias("sortino"), (downside(r, risk_free / periods) * math.sqrt(periods)).alias("downside_deviation"),
    )
    falls = drawdowns(equity).groupBy("run_id").agg(F.max("drawdown").alias("max_drawdown"))
    one = curve.join(moves, "run_id", "left").join(falls, "run_id", "left").join(longest_drawdown(equity), "run_id", "left")
    grown = cagr(F.col("first"), F.col("last"), F.col("n"), periods)
    return one.select(
        "run_id", "n", F.when(F.col("first") != 0, F.try_divide(F.col("last"), F.col("first")) - 1).alias("total_return"), grown.alias("cagr"), "volatility", "downside_deviation", "sharpe", "sortino", "max_drawdown",
        F.col("duration").alias("drawdown_duration"), F.when(F.col("max_drawdown") > 0, grown / F.col("max_drawdown")).alias("calmar"),
        F.when((F.col("n") > 1) & (F.col("mean_equity") > 0), F.col("traded") / F.col("mean_equity") / ((F.col("n") - 1) / periods)).alias("turnover"), "exposure", "time_in_market",
    )


# -- benchmark


def buy_and_hold(panel: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """Equal weights at the first time, held: the mean of the price relatives of what has a price then."""
    first = panel.filter("pos = 0 and last_close is not null").select("symbol", F.col("last_close").alias("base"))
    return panel.join(F.broadcast(first), "symbol").groupBy("pos", "ts").agg((F.avg(F.col("last_close") / F.col("base")) * cash).alias("equity"))


def against(run: DataFrame, bench: DataFrame, periods: float = YEAR) -> DataFrame:
    """Beta, alpha, tracking error, information ratio and correlation with a benchmark's returns (``pos``, ``b``)."""
    both = run.join(bench, "pos").withColumn("d", F.col("r") - F.col("b"))
    beta = F.try_divide(F.covar_samp("r", "b"), F.var_samp("b"))
    error = F.stddev_samp("d")
    return both.groupBy("run_id").agg(
        beta.alias("beta"), ((F.avg("r") - beta * F.avg("b")) * periods).alias("alpha"), (error * math.sqrt(periods)).alias("tracking_error"),
        F.when(error > 0, F.avg("d") / error * math.sqrt(periods)).alias("information_ratio"), F.corr("r", "b").alias("correlation"), sharpe(F.col("b"), periods=periods).alias("bench_sharpe"),
    )


# -- views of a series


def rolling_sharpe(rets: DataFrame, n: int = 126, periods: float = YEAR) -> DataFrame:
    frame = _line().rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp("r").over(frame)
    full = F.count("r").over(frame) == n
    return rets.select("run_id", "pos", F.when(full & (sd > 0), F.avg("r").over(frame) / sd * math.sqrt(periods)).alias("rolling_sharpe"), F.when(full, sd * math.sqrt(periods)).alias("rolling_volatility"))


def monthly_returns(rets: DataFrame) -> DataFrame:
    """Compounded returns by year and month, with the year's as month 0."""
    product = F.product(1 + F.col("r")) - 1
    month = rets.groupBy("run_id", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(product.alias("r"))
    year = rets.groupBy("run_id", F.year("ts").alias("year")).agg(product.alias("r")).select("run_id", "year", F.lit(0).alias("month"), "r")
    return month.unionByName(year)


def tail_risk(rets: DataFrame, share: float = 0.05) -> DataFrame:
    """``var`` (interpolated quantile) and ``cvar`` (mean of the returns up to it)."""
    quantile = rets.groupBy("run_id").agg(F.percentile("r", share).alias("var"))
    return rets.join(quantile, "run_id").groupBy("run_id").agg(F.first("var").alias("var"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar"))


def histogram(rets: DataFrame, bins: int = 20) -> DataFrame:
    """Counts in equal bins between the least and the largest value; the last bin has both its edges."""
    edges = rets.groupBy("run_id").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("r") - F.col("lo"), (F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)), F.lit(0))
    return rets.join(edges, "run_id").groupBy("run_id", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def month_ends(table: DataFrame) -> DataFrame:
    """The last row of each month."""
    own = W.partitionBy("run_id", F.trunc("ts", "MM")).orderBy(F.desc("ts"))
    return table.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def decimated(series: DataFrame, value: str, buckets: int) -> DataFrame:
    """First, least, largest and last row of each of ``buckets`` spans of positions: what a chart of that width shows."""
    top = series.groupBy("run_id").agg(F.max("pos").alias("top"))
    span = F.floor(F.col("pos") * buckets / (F.col("top") + 1))
    own = series.join(top, "run_id").groupBy("run_id", span.alias("span"))
    kept = own.agg(F.array(F.min_by(F.struct("pos", value), "pos"), F.min_by(F.struct("pos", value), F.struct(value, "pos")), F.max_by(F.struct("pos", value), F.struct(value, "pos")), F.max_by(F.struct("pos", value), "pos")).alias("rows"))
    return kept.select("run_id", F.explode(F.array_distinct("rows")).alias("row")).select("run_id", "row.*")


def trade_stats(trades: DataFrame) -> DataFrame:
    """Of closed trades: how many, share of winners, profit factor, mean win, loss and trade, mean bars."""
    net, closed = F.col("net_pnl"), trades.filter("status = 'closed'")
    win, loss = F.sum(F.when(net > 0, net)), F.sum(F.when(net < 0, -net))
    return closed.groupBy("run_id").agg(
        F.count("*").alias("n_trades"), F.avg((net > 0).cast("double")).alias("hit_rate"), F.when(loss > 0, F.coalesce(win, F.lit(0.0)) / loss).when(win > 0, float("inf")).alias("profit_factor"),
        F.avg(F.when(net > 0, net)).alias("avg_win"), F.avg(F.when(net < 0, net)).alias("avg_loss"), F.avg(net).alias("avg_trade"), F.avg("bars_held").alias("avg_bars"),
    )
