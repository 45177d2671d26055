"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nxtide.llm.common import SPREAD_ROWS, discard, join_spread, save


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Returns (node, root) for each node that has an edge to another; root is the smallest node reachable.

    Each round shuffles the edges only, takes the minimum of each node before it is
    joined to that node's edges, and is written to the shared folder. The edges of a node
    that has very many, as the centre of a star, are dealt among tasks. The number of
    rounds grows with the logarithm of the longest path. Nulls and loops are left out; without
    edges there are no rows.
    """

    def met(rows: DataFrame) -> DataFrame:
        """rows (u, v) with m, the least v of their u."""
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return rows.join(least, "u") if mark[0] <= SPREAD_ROWS else join_spread(rows, least, ["u"], "n", ["v"])

    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = save(ends.filter("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = met(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        large = save(large) if mark[0] > SPREAD_ROWS else large
        small = met(large).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        then = save(small.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct())
        after = _mark(then)
        discard(now)
        discard(large)
        now = then
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
