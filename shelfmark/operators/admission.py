"""Which entries may be indexed. Entries: volume, path, kind, type, contents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, as_directory, inside, named, visible
from ..session import small_side, written

INDEX_DIR = "/index/"

# The outcome codes of asking for a file to be indexed.
OK, BAD_VALUE, NOT_SUPPORTED, EXCLUDED = "OK", "bad_value", "nspt", "excl"


def regular_files(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("kind") == "file")


def no_symlinks(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("kind") != "symlink")


def visible_paths(entries: DataFrame) -> DataFrame:
    return entries.filter(visible(F.col("path")))


def not_in_index_dir(entries: DataFrame, index_dir: str = INDEX_DIR) -> DataFrame:
    return entries.filter(~inside(F.col("path"), index_dir))


def not_excluded(entries: DataFrame, excludes: DataFrame) -> DataFrame:
    """Drop entries inside an excluded directory of their volume, at any depth. A directory
    is meant with or without its last slash.

    The directories an entry lies in are matched by equality, in one lookup for each
    distinct directory. An entry without a path is in none.
    """
    prefixes = excludes.filter("dir_prefix IS NOT NULL").select(
        "volume", as_directory(F.col("dir_prefix")).alias("dir_prefix")).distinct()
    parent = F.regexp_extract(F.col("path"), r"^(.*/)[^/]*$", 1)
    placed = entries.withColumn("_parent", parent)
    parents = placed.filter("_parent <> ''").select("volume", "_parent").distinct()
    gone = (parents.withColumn("dir_prefix", F.explode(ancestors(F.col("_parent"))))
            .join(small_side(prefixes), ["volume", "dir_prefix"], "left_semi")
            .select("volume", "_parent").distinct())
    return placed.join(gone, ["volume", "_parent"], "left_anti").select(*entries.columns)


def supported_types(entries: DataFrame, types: DataFrame) -> DataFrame:
    """Keep entries of a type that some text extractor recognises."""
    return entries.join(small_side(types.select("type").distinct()), "type", "left_semi") \
        .select(*entries.columns)


def admission_status(entries: DataFrame, types: DataFrame,
                     index_dir: str = INDEX_DIR) -> DataFrame:
    """The outcome for every entry, decided in a fixed order. A missing path and a missing or
    empty volume are bad values."""
    known = small_side(types.select("type").distinct().withColumn("_known", F.lit(True)))
    status: Column = (
        F.when(F.col("path").isNull() | ~named(F.col("volume")), BAD_VALUE)
        .when(F.col("_known").isNull(), NOT_SUPPORTED)
        .when(inside(F.col("path"), index_dir), EXCLUDED)
        .otherwise(OK))
    return (entries.join(known, "type", "left")
            .withColumn("admission_status", status)
            .select(*entries.columns, "admission_status"))


def admit(entries: DataFrame, types: DataFrame | None = None,
          excludes: DataFrame | None = None, index_dir: str = INDEX_DIR) -> DataFrame:
    """The one admission filter for crawl and feed: plain column filters first. Documents
    without ``kind`` or ``type`` are held to be regular files of a supported type."""
    kept = not_in_index_dir(visible_paths(entries), index_dir)
    if "kind" in entries.columns:
        kept = regular_files(kept)
    if types is not None and "type" in entries.columns:
        kept = supported_types(kept, types)
    return not_excluded(kept, excludes) if excludes is not None else kept


@dataclass(frozen=True)
class Admission:
    """What an index takes in. It holds for builds, bootstraps and commits alike."""

    types: DataFrame | None = None
    excludes: DataFrame | None = None
    index_dir: str = INDEX_DIR

    def admit(self, docs: DataFrame) -> DataFrame:
        return admit(docs, self.types, self.excludes, self.index_dir)


def admit_updates_only(changes: DataFrame, entries: DataFrame,
                       excludes: DataFrame | None = None) -> DataFrame:
    """Updates must name a visible, existing, regular file outside the excluded
    directories; removals pass unchecked. ``entries`` has one row per path."""
    good = visible_paths(regular_files(entries)).select("volume", "path")
    updates = visible_paths(changes.filter(F.col("op") == "created"))
    if excludes is not None:
        updates = not_excluded(updates, excludes)
    admitted = good.join(small_side(written(updates)), ["volume", "path"]).select(*changes.columns)
    return admitted.unionByName(changes.filter(F.col("op") == "removed"))


def rejection_report(entries_with_status: DataFrame) -> DataFrame:
    """How many entries per volume ended with which outcome."""
    return entries_with_status.groupBy("volume", "admission_status").agg(
        F.count(F.lit(1)).alias("n_entries"))
