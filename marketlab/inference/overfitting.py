"""Probability of backtest overfitting by combinatorially symmetric cross-validation.

Performance is (``cfg_idx``, ``t``, ``ret``). Blocks are summed first, so that
each of the C(S, S/2) combinations adds block sums instead of returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SettingError


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient with 0 / 0 = 0 and x / 0 = sign(x) times infinity."""
    flat = F.when(numerator > 0, float("inf")).when(numerator < 0, float("-inf")).otherwise(0.0)
    return F.when(denominator > 0, numerator / F.when(denominator > 0, denominator)).otherwise(flat)


def blocks(perf: DataFrame, splits: int) -> DataFrame:
    """By block and configuration: sums of centred returns and of their squares, squared losses, rows and the centre. The oldest rows that fill no block are left out."""
    if splits < 2 or splits % 2:
        raise SettingError("the number of blocks must be even")
    size = perf.agg(F.countDistinct("t").alias("n"), F.max("t").alias("last")).crossJoin(perf.sparkSession.range(1)).select(F.floor(F.col("n") / splits).alias("rows"), "last")
    own = perf.crossJoin(F.broadcast(size)).withColumn("back", F.col("last") - F.col("t")).filter(F.col("back") < F.col("rows") * splits)
    own = own.withColumn("block", (F.lit(splits - 1) - F.floor(F.col("back") / F.col("rows"))).cast("int"))
    centre = own.groupBy("cfg_idx").agg(F.avg("ret").alias("centre"))
    off = own.join(F.broadcast(centre), "cfg_idx").withColumn("x", F.col("ret") - F.col("centre"))
    return off.groupBy("block", "cfg_idx").agg(F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.sum(F.pow(F.least("ret", F.lit(0.0)), 2)).alias("down"), F.count("*").alias("rows"), F.first("centre").alias("centre"))


def combinations(spark, splits: int) -> DataFrame:
    """``combo``: every set of half of the blocks, as bits."""
    return spark.range(1 << splits).filter(F.bit_count("id") == splits // 2).withColumnRenamed("id", "combo")


def performances(blocks_: DataFrame, splits: int, metric: str = "sharpe") -> DataFrame:
    """(``combo``, ``cfg_idx``, ``train``, ``test``)."""
    inside = F.expr("(combo >> block) & 1") == 1
    both = combinations(blocks_.sparkSession, splits).crossJoin(F.broadcast(blocks_))
    side = lambda name, on: F.sum(F.when(inside if on else ~inside, F.col(name)).otherwise(0.0))
    sums = both.groupBy("combo", "cfg_idx").agg(*[side(n, on).alias(f"{n}_{int(on)}") for n in ("s1", "s2", "down", "rows") for on in (True, False)], F.first("centre").alias("centre"))

    def value(k: int) -> Column:
        n = F.col(f"rows_{k}")
        mean = F.col(f"s1_{k}") / n + F.col("centre")
        if metric == "mean":
            return mean
        if metric == "sharpe":
            return ratio(mean, F.sqrt(F.greatest(F.col(f"s2_{k}") - F.pow(F.col(f"s1_{k}"), 2) / n, F.lit(0.0)) / (n - 1)))
        if metric == "sortino":
            return ratio(mean, F.sqrt(F.col(f"down_{k}") / n))
        raise SettingError(f"unknown metric {metric!r}")

    return sums.select("combo", "cfg_idx", value(1).alias("train"), value(0).alias("test"))


def logits(performances_: DataFrame) -> DataFrame:
    """Per combination the winner in training (the first among equals), its results, and the logit of its average rank in the test."""
    own = W.partitionBy("combo")
    ranked = performances_.withColumns({
        "place": F.row_number().over(own.orderBy(F.desc("train"), "cfg_idx")),
        "below": F.rank().over(own.orderBy("test")) - 1,
        "ties": F.count("*").over(W.partitionBy("combo", "test")),
        "n": F.count("*").over(own),
    })
    w = (F.col("below") + (F.col("ties") + 1) / 2) / (F.col("n") + 1)
    return ranked.filter("place = 1").select("combo", F.col("cfg_idx").alias("selected"), F.col("train").alias("is_perf"), F.col("test").alias("oos_perf"), w.alias("relative_rank"), F.log(w / (1 - w)).alias("logit"))


def summary(logits_: DataFrame) -> DataFrame:
    """``pbo``, ``prob_loss`` and the regression of test on training results."""
    finite = (F.abs("is_perf") < float("inf")) & (F.abs("oos_perf") < float("inf"))
    x, y = F.when(finite, F.col("is_perf")), F.when(finite, F.col("oos_perf"))
    return logits_.agg(
        F.count("*").alias("n_combinations"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg((F.col("oos_perf") < 0).cast("double")).alias("prob_loss"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )


def selection_frequency(logits_: DataFrame) -> DataFrame:
    total = logits_.agg(F.count("*").alias("total"))
    return logits_.groupBy("selected").count().crossJoin(F.broadcast(total)).select("selected", (F.col("count") / F.col("total")).alias("share"))


def pbo(perf: DataFrame, splits: int = 16, metric: str = "sharpe") -> DataFrame:
    return summary(logits(performances(blocks(perf, splits), splits, metric)))
