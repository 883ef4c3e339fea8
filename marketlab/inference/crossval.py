"""Purged cross-validation over observations with information intervals.

Observations are (``obs``, ``s``, ``e``): a position and the closed interval of
positions that its value depends on.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spans(spark: SparkSession, n: int, lookback: int = 0, horizon: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("obs"), (F.col("id") - lookback).alias("s"), (F.col("id") + horizon).alias("e"))


def _fold(n: int, k: int, column):
    """Consecutive folds, the first n mod k of them one larger."""
    size, more = divmod(n, k)
    edge = more * (size + 1)
    return F.when(column < edge, F.floor(column / (size + 1))).otherwise(more + F.floor((column - edge) / max(size, 1))).cast("int")


def test_blocks(tests: DataFrame, obs: DataFrame) -> DataFrame:
    """Runs of consecutive test positions of each ``split``: their first and last positions, and the hull of their intervals."""
    own = W.partitionBy("split").orderBy("obs")
    island = tests.withColumn("island", F.col("obs") - F.row_number().over(own))
    return island.join(obs, "obs").groupBy("split", "island").agg(F.min("s").alias("lo"), F.max("e").alias("hi"), F.min("obs").alias("first"), F.max("obs").alias("last"))


def training(tests: DataFrame, obs: DataFrame, embargo: int = 0) -> DataFrame:
    """(``split``, ``obs``) of the training sets: not tested, not overlapping a test block, not within ``embargo`` after one.

    An embargo counts from the first observation whose interval begins after the block's hull.
    """
    blocks = test_blocks(tests, obs)
    after = blocks.join(obs, obs["s"] > blocks["hi"], "left").groupBy("split", "island").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min("obs").alias("resume"))
    every = tests.select("split").distinct().crossJoin(obs)
    free = every.join(tests, ["split", "obs"], "left_anti")
    b = F.broadcast(after.withColumnRenamed("split", "b_split"))
    overlap = (F.col("s") <= F.col("hi")) & (F.col("e") >= F.col("lo"))
    held = (F.col("obs") >= F.col("resume")) & (F.col("obs") < F.col("resume") + embargo)
    return free.join(b, (F.col("split") == F.col("b_split")) & (overlap | F.coalesce(held, F.lit(False))), "left_anti").select("split", "obs")


def kfold_tests(obs: DataFrame, n: int, k: int) -> DataFrame:
    return obs.select(_fold(n, k, F.col("obs")).alias("split"), "obs")


def combination_table(groups: int, tested: int) -> list[tuple[int, int]]:
    """(split, group) of every set of ``tested`` groups, in lexicographic order."""
    return [(s, g) for s, chosen in enumerate(combinations(range(groups), tested)) for g in chosen]


def combinatorial_tests(obs: DataFrame, n: int, groups: int = 6, tested: int = 2) -> DataFrame:
    """(``split``, ``group``, ``obs``) of combinatorial purged cross-validation."""
    table = obs.sparkSession.createDataFrame(combination_table(groups, tested), "split int, group int")
    return obs.withColumn("group", _fold(n, groups, F.col("obs"))).join(F.broadcast(table), "group").select("split", "group", "obs")


def path_splits(spark: SparkSession, groups: int = 6, tested: int = 2) -> DataFrame:
    """(``path``, ``group``, ``split``): path p takes the p-th split that tests a group."""
    table = spark.createDataFrame(combination_table(groups, tested), "split int, group int")
    return table.withColumn("path", F.row_number().over(W.partitionBy("group").orderBy("split")) - 1).select("path", "group", "split")


def n_paths(groups: int, tested: int) -> int:
    return comb(groups, tested) * tested // groups


def cpcv(perf: DataFrame, n: int, groups: int = 6, tested: int = 2, lookback: int = 0, embargo: int = 0, metric: str = "sharpe") -> tuple[DataFrame, DataFrame]:
    """(selected, paths): each split's best configuration in training (first among equals), and the out-of-sample returns stitched to paths."""
    from .overfitting import ratio

    spark = perf.sparkSession
    obs = spans(spark, n, lookback)
    tests = combinatorial_tests(obs, n, groups, tested)
    train = training(tests.select("split", "obs"), obs, embargo).join(perf.withColumnRenamed("t", "obs"), "obs")
    score = F.avg("ret") if metric == "mean" else ratio(F.avg("ret"), F.stddev_samp("ret"))
    best = train.groupBy("split", "cfg_idx").agg(score.alias("score")).withColumn("place", F.row_number().over(W.partitionBy("split").orderBy(F.desc("score"), "cfg_idx"))).filter("place = 1")
    selected = best.select("split", "cfg_idx", "score")
    paths = tests.join(path_splits(spark, groups, tested), ["split", "group"]).join(selected.select("split", "cfg_idx"), "split").join(perf.withColumnRenamed("t", "obs"), ["obs", "cfg_idx"])
    return selected, paths.select("path", F.col("obs").alias("t"), "ret", "cfg_idx")
