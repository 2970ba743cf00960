"""The change feed: classify, route, reduce to the net effect, bind contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side, written

OPS = ("created", "removed")

# Reads the documents of (volume, path) rows.
ReadDocs = Callable[[DataFrame], DataFrame]


def classify_changes(changes: DataFrame) -> DataFrame:
    """Created and removed entries of a path; every other opcode, such as a move, is ignored,
    and so is a change without a path."""
    return changes.filter(F.col("op").isin(*OPS) & F.col("path").isNotNull())


def route_to_volume(changes: DataFrame, volumes: DataFrame) -> DataFrame:
    """Changes of known volumes; a change on an unknown volume is dropped."""
    known = volumes.select("volume").distinct()
    return changes.join(small_side(known), "volume", "left_semi").select(*changes.columns)


def net_changes(changes: DataFrame) -> DataFrame:
    """One row per batch and path. Removals go before additions, so a path that has
    both in one batch counts as updated. A hot path shrinks to one row per task before
    the shuffle."""
    return changes.groupBy("batch", "volume", "path").agg(
        F.bool_or(F.col("op") == "created").alias("is_update"))


def last_changes(changes: DataFrame) -> DataFrame:
    """The net effect of all batches, applied one after the other: for each path its last
    batch decides. One aggregation: the greatest (batch, created) pair says both."""
    last = F.max(F.struct("batch", (F.col("op") == "created").alias("is_update")))
    return changes.groupBy("volume", "path").agg(last["is_update"].alias("is_update"))


def late_bound_content(net: DataFrame, docs: DataFrame | ReadDocs) -> DataFrame:
    """Contents of the updated paths as they are now. An update whose document is gone
    binds nothing. ``docs`` is the corpus, or a function that reads the documents of given
    (volume, path) rows by the corpus' own key; that one need not scan the corpus. The corpus
    is not shuffled while the batch is small."""
    updates = written(net.filter("is_update AND path IS NOT NULL").drop("is_update"))
    rows = docs(updates) if callable(docs) else docs
    return rows.join(small_side(updates), ["volume", "path"])


def commit_report(changes: DataFrame) -> DataFrame:
    """Queued updates and removals of each volume in each batch."""
    return changes.groupBy("batch", "volume").agg(
        F.count_if(F.col("op") == "created").alias("n_updates"),
        F.count_if(F.col("op") == "removed").alias("n_removals"))
