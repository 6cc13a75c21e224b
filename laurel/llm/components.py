"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    side = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges between comparable ids -> (node, component): the smallest id reachable, for every node that has an edge.

    Each step is written to the shared folder. Hub nodes are spread by skew joins, as minima are aggregated beforehand.
    The number of rounds grows with the logarithm of the longest chain. An empty table gives none.
    """
    e = stash(edges.filter("u <> v").distinct())
    mark = _mark(e)
    while mark[0]:
        e = stash(_small(stash(_large(e))))
        old, mark = mark, _mark(e)
        if old == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
