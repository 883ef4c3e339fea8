"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, written=written) -> DataFrame:
    """(``node``, ``label``) of the nodes of edges (``a``, ``b``): the label is the component's smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their roots by doubling, and contracts the edges to the roots; the number of
    nodes that still have edges halves at least. Hubs only meet partial
    aggregates and joins with one row per node. ``written`` keeps the rounds' tables.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known, edges = None, written(edges)
    while known is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
        while True:
            at = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = written(up.join(at, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
            up, moved = jumped.drop("moved"), not jumped.filter("moved").isEmpty()
            if not moved:
                break
        if known is None:
            known = up
        else:
            at = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            known = written(known.join(at, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        roots = lambda name: up.select(F.col("node").alias(name), F.col("label").alias(f"{name}_root"))  # noqa: B023, E731
        moved_edges = edges.join(roots("a"), "a").join(roots("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        edges = written(moved_edges.filter("a <> b").distinct())
    return known
