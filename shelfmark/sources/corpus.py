"""Corpora and volumes: where documents come from and which of them are in scope."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.paths import visible
from ..functions.text import decode_text, extract_text
from ..operators.changes import ReadDocs
from ..session import small_side, written

URL_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)"
NO_HOST = "(no host)"  # the volume of pages whose address names none
URI_START = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


def documents_corpus(documents: DataFrame) -> DataFrame:
    """Plain-text corpus from a ``documents`` table."""
    return documents.select(
        F.col("source").alias("volume"), F.col("doc_id").cast("string").alias("path"),
        F.col("text").alias("contents"))


def documents_by_key(documents: DataFrame) -> ReadDocs:
    """A reader of the documents of given (volume, path) rows from a ``documents`` table. The
    paths are turned back into the table's own key: the scan gets the range of the keys, and
    what it reads is joined with them, so a table that is clustered by its key is not read
    as a whole."""

    def read(paths: DataFrame) -> DataFrame:
        keys = small_side(written(paths.select(
            F.expr("try_cast(path AS BIGINT)").alias("doc_id")).distinct()))
        low, high = keys.agg(F.min("doc_id"), F.max("doc_id")).first()  # two numbers
        near = documents.filter(F.col("doc_id").between(F.lit(low), F.lit(high)))
        return documents_corpus(near.join(keys, "doc_id", "left_semi"))

    return read


def pages_corpus(pages: DataFrame) -> DataFrame:
    """Rich-format corpus from a ``pages`` table; the volume is the host, in small letters."""
    host = F.lower(F.regexp_extract("url", URL_HOST, 1))
    return pages.select(
        F.when(host != "", host).otherwise(NO_HOST).alias("volume"), F.col("url").alias("path"),
        extract_text(F.col("html")).alias("contents"))


def conversations_corpus(conversations: DataFrame) -> DataFrame:
    """Corpus of conversation turns; the volume is the role."""
    return conversations.select(
        F.col("role").alias("volume"),
        F.concat_ws("/", F.col("conv_id").cast("string"),
                    F.col("turn").cast("string")).alias("path"),
        F.col("text").alias("contents"))


def _file_entries(files: DataFrame, root: str, volume: str) -> DataFrame:
    # The source gives URIs; what follows the root folder is the path in the volume.
    folder = re.sub(URI_START, "", root).rstrip("/")
    path = F.regexp_replace("path", URI_START, "").substr(
        F.lit(len(folder) + 1), F.length("path"))
    return files.select(
        F.lit(volume).alias("volume"), path.alias("path"), F.lit("file").alias("kind"),
        F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("type"),
        F.col("modificationTime").alias("ts"), decode_text(F.col("content")).alias("contents"))


def read_files(spark: SparkSession, root: str, volume: str,
               modified_after: str | None = None) -> DataFrame:
    """All files under the absolute path ``root``, at any depth, as file entries.
    ``modified_after`` keeps only files changed since then; the file listing applies it,
    before any file is read. Contents are read only where they are used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    return _file_entries(reader.load(root), root, volume)


def follow_files(spark: SparkSession, root: str, volume: str,
                 files_per_batch: int | None = None) -> DataFrame:
    """Stream of the same entries: the files that are there, then those that arrive. A
    new file is a created entry; the source reports neither removals nor a second
    version under the same name, which have to come through a change table."""
    reader = (spark.readStream.format("binaryFile").schema(schemas.RAW_FILES)
              .option("recursiveFileLookup", True))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _file_entries(reader.load(root), root, volume)


def scan_volume(entries: DataFrame) -> DataFrame:
    """The crawl: every visible regular file; hidden entries and symlinks are skipped."""
    return entries.filter((F.col("kind") == "file") & visible(F.col("path")))


def eligible_volumes(volumes: DataFrame, monitor_removable: bool = False) -> DataFrame:
    """Volumes to follow: removable ones only on demand, and only those that can
    report changes."""
    wanted = F.lit(monitor_removable) | ~F.col("is_removable")
    return volumes.filter(wanted & F.col("knows_query"))


def in_scope(rows: DataFrame, volumes: DataFrame) -> DataFrame:
    """Rows of the given volumes."""
    return rows.join(small_side(volumes.select("volume").distinct()), "volume", "left_semi")


def attach_volume(volumes: DataFrame, mounted: DataFrame,
                  monitor_removable: bool = False) -> DataFrame:
    """Scope after a mount. New volumes pass the same test as those found at the start."""
    new = eligible_volumes(mounted, monitor_removable)
    new = new.join(volumes.select("volume"), "volume", "left_anti")
    return volumes.unionByName(new)


def detach_volume(volumes: DataFrame, unmounted: DataFrame) -> DataFrame:
    """Scope after an unmount. Only the scope changes: index data stays where it is."""
    return volumes.join(unmounted.select("volume"), "volume", "left_anti")
