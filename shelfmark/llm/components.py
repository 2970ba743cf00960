"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import written


def _state(pairs: DataFrame):
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that has another node beside it: the
    root is the smallest node that can be reached.

    Rounds of large-star and small-star steps: each hangs a node's neighbours under its
    smallest neighbour. A step is a minimum per node (combined before the shuffle) and a join
    with it; no neighbour list is ever collected. Minima and rounds are written as tables: a
    lost executor costs one step, and adaptive execution can split a hot node in the join.
    Nulls and links of a node to itself are ignored; an empty table gives no rows.
    """
    pairs = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _state(pairs)
    while now != before:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")))
        large = written(both.join(lowest, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        pairs = written(small.where("a <> b").distinct())
        before, now = now, _state(pairs)
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).select(
        F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
