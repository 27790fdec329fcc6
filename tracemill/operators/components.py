"""Connected components of an edge table by alternating min-label steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import cut, drop


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; the component is its smallest node. Null ends and loops are left out.

    Each round sends every node's smallest neighbour to its larger neighbours and to itself (large-star), then shortens
    what is left to stars of the smallest node (small-star), so that paths halve and a hub's edges never meet in one
    group: only a minimum per node is aggregated. A ValueError says that ``rounds`` did not do.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    nodes = cut(ends.select("u").union(ends.select("v")).distinct().withColumnRenamed("u", "node"))
    now = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        then = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # stars: no smaller end is a larger end elsewhere, and each larger end occurs once
        if then.join(then.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and then.groupBy("u").count().where("count > 1").isEmpty():
            return nodes.join(then.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
        drop(now)
        now = then
    raise ValueError(f"{rounds} rounds did not reach the components")
