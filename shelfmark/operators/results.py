"""Ranking and listing of hits (query_id, volume, path, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, written

BEST_FIRST = ("score DESC", "path")


def _order(columns: tuple[str, ...]) -> list[Column]:
    return [F.col(c.removesuffix(" DESC")).desc() if c.endswith(" DESC") else F.col(c).asc()
            for c in columns]


HIT_KEY = ["query_id", "volume", "path"]


def either(one: DataFrame, other: DataFrame) -> DataFrame:
    """Hits of one search or the other; scores add up."""
    rows = one.select(*HIT_KEY, "score").unionByName(other.select(*HIT_KEY, "score"))
    return rows.groupBy(*HIT_KEY).agg(F.round(F.sum("score"), 6).alias("score"))


def both(one: DataFrame, other: DataFrame) -> DataFrame:
    """Hits of both searches; scores add up. With ``either`` and ``without`` it nests
    boolean groups to any depth."""
    rows = one.select(*HIT_KEY, "score").unionByName(other.select(*HIT_KEY, "score"))
    return (rows.groupBy(*HIT_KEY)
            .agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("_n"))
            .filter("_n = 2").drop("_n"))


def without(one: DataFrame, other: DataFrame) -> DataFrame:
    """Hits of one search that the other does not have."""
    return one.join(other.select(*HIT_KEY), HIT_KEY, "left_anti")


def number_rows(rows: DataFrame, group: list[str], order: tuple[str, ...],
                name: str) -> DataFrame:
    """Number the rows of each group from 1 in the given order, whatever a group's size.

    A window would sort each group in one task. Here the rows are range-partitioned by
    group and order, so that a big group spans many partitions; a row's number is its
    place in its partition plus the rows of the group in the partitions before. The
    placed rows are written first, since the numbers depend on where the rows lie. The rows
    themselves are written before that: the ranges are drawn from a sample, which would run
    all that the rows come from a second time.
    """
    by = [*[F.col(c) for c in group], *_order(order)]
    placed = written(
        written(rows).repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    # One row per group and partition it lies in, counted once: it is measured, then joined.
    parts = written(placed.groupBy(*group, "_part")
                    .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
                    .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return (placed.join(small_side(parts), [*group, "_part"])
            .select(*rows.columns, number.alias(name)))


def rank_hits(hits: DataFrame) -> DataFrame:
    """All hits with their rank within query and volume, best first, ties by path."""
    return number_rows(hits, ["query_id", "volume"], BEST_FIRST, "rank")


def merged_ranking(hits: DataFrame) -> DataFrame:
    """One ranking over all volumes; for hits scored with shared statistics."""
    return number_rows(hits, ["query_id"], (*BEST_FIRST, "volume"), "rank")


def concat_volumes(ranked: DataFrame, volumes: DataFrame) -> DataFrame:
    """Position of each hit when the volumes' results follow one another in the order of
    ``volumes`` (volume, volume_order). Scores of different volumes are not compared."""
    counts = ranked.groupBy("query_id", "volume").agg(F.max("rank").alias("_hits"))
    earlier = Window.partitionBy("query_id").orderBy("volume_order", "volume").rowsBetween(
        Window.unboundedPreceding, -1)
    # At most one row per query and volume, counted once: it is measured, then joined.
    offsets = written(counts.join(small_side(volumes.select("volume", "volume_order")), "volume")
                      .withColumn("_before", F.coalesce(F.sum("_hits").over(earlier), F.lit(0)))
                      .select("query_id", "volume", "_before"))
    return (ranked.join(small_side(offsets), ["query_id", "volume"])
            .withColumn("position", F.col("_before") + F.col("rank"))
            .select(*ranked.columns, "position"))


def top_k(hits: DataFrame, k: int, per_volume: bool = True) -> DataFrame:
    """The best ``k`` hits of each query and volume, or of each query. Every task keeps
    its best ``k`` of a group before the shuffle."""
    group = ["query_id", "volume"] if per_volume else ["query_id"]
    order = _order(BEST_FIRST if per_volume else (*BEST_FIRST, "volume"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (hits.withColumn("rank", rank).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def hit_paths(positioned_hits: DataFrame) -> DataFrame:
    """What is handed out: the path, in list order."""
    return positioned_hits.select("query_id", "position", "path")


def open_hits(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with the contents of their documents, which the index does not store. Read
    the corpus once for all queries; pass few hits, such as a top k, to avoid shuffling
    it."""
    return docs.join(small_side(written(hits)), ["volume", "path"])
