"""The index: derived parquet tables, written by DataFrame jobs, one batch at a time.

A *base* batch holds whole volumes (first build, bootstrap, reindex); other batches hold
the documents of one commit. Tables only grow: each batch writes its own ``batch_id=``
directory, in overwrite mode, and becomes visible with its row in ``commits``. A batch
that died half-way is invisible, and its retry overwrites what it left. One writer at a
time is assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.analysis import term_bucket
from ..functions.paths import named
from ..operators.admission import Admission
from ..operators.changes import (
    ReadDocs, classify_changes, last_changes, late_bound_content, route_to_volume)
from ..operators.postings import build_postings, document_frequencies, volume_sizes
from ..session import Size, broadcast_within, measured, size_columns, small_side, written


POSTING_COLUMNS = ["volume", "term", "path", "tf", "dl", "positions"]


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class IndexView:
    """What a search reads. Every live row counts, dead ones do not."""

    stored: DataFrame         # postings as stored; batch_id tells versions apart
    doc_list: DataFrame       # volume, path, dl; live
    sizes: DataFrame          # volume, n_docs; live
    dictionary: DataFrame     # term; all that live postings have, maybe more
    buckets: int
    terms: DataFrame | None = None   # volume, bucket, term, df; None: count on demand
    keep_live: Callable[[DataFrame], DataFrame] = _as_they_are
    known_extent: Size | None = None

    @property
    def postings(self) -> DataFrame:
        """All live postings (volume, term, path, tf, dl, positions)."""
        return self.keep_live(self.stored).select(*POSTING_COLUMNS)

    def find(self, lookup: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        """Live postings that join ``lookup`` on ``keys``, with its columns. The lookup
        comes first: only what it finds is checked for being live."""
        wanted = list(dict.fromkeys(["bucket", "volume", "term", "path", *columns, "batch_id"]))
        found = self.stored.select(*wanted).join(lookup, keys)
        return self.keep_live(found).drop("batch_id")

    @cached_property
    def extent(self) -> Size:
        """Bound for the volume side, taken once per view."""
        return self.known_extent or measured(self.sizes)

    @cached_property
    def n_docs(self) -> int:
        """Documents of all volumes."""
        return self.sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]

    def volume_sizes(self) -> DataFrame:
        return broadcast_within(self.sizes, self.extent)

    def frequencies(self, terms: DataFrame, size: Size) -> DataFrame:
        """(volume, term, df) of the given terms, which are at most ``size``. Taken from
        the stored table while it holds, otherwise counted over the live postings of
        just these terms."""
        keys = broadcast_within(terms.distinct().withColumn(
            "bucket", term_bucket(F.col("term"), self.buckets)), size)
        if self.terms is not None:  # with a broadcast side only the buckets asked for are read
            return self.terms.join(keys, ["bucket", "term"], "left_semi").select(
                "volume", "term", "df")
        return document_frequencies(self.find(keys, ["bucket", "term"], []))

    def only_terms(self, terms: DataFrame) -> IndexView:
        """The view cut down to some terms, few enough to be broadcast."""
        keys = F.broadcast(terms.select("term").distinct().withColumn(
            "bucket", term_bucket(F.col("term"), self.buckets)))
        return replace(self, stored=self.stored.join(keys, ["bucket", "term"], "left_semi"))

    def volumes(self, wanted: DataFrame) -> IndexView:
        """The view cut down to some volumes."""
        keys = small_side(wanted.select("volume").distinct())

        def cut(rows):
            return None if rows is None else rows.join(keys, "volume", "left_semi")

        return replace(self, stored=cut(self.stored), doc_list=cut(self.doc_list),
                       sizes=cut(self.sizes), terms=cut(self.terms))


def view_of(docs: DataFrame, buckets: int = 8) -> IndexView:
    """A search view straight over documents, with nothing stored. For a corpus that is
    searched once; the texts are analysed again by each search."""
    rows = build_postings(docs, list_documents=True).withColumns({
        "bucket": term_bucket(F.col("term"), buckets), "batch_id": F.lit(0)})
    doc_list = rows.filter(F.col("bucket") == -1).select("volume", "path", "dl")
    postings = rows.filter(F.col("bucket") >= 0)
    return IndexView(postings, doc_list, volume_sizes(doc_list),
                     postings.select("term").distinct(), buckets,
                     document_frequencies(postings).withColumn(
                         "bucket", term_bucket(F.col("term"), buckets)))


def one_per_path(docs: DataFrame) -> DataFrame:
    """One row for each volume and path; of several, the one with the greatest contents. Only
    the rows of paths that occur twice are shuffled with their contents."""
    twice = written(docs.groupBy("volume", "path").count().filter("count > 1").drop("count"))
    if twice.isEmpty():
        return docs
    keys = ["volume", "path"]
    several = docs.join(small_side(twice), keys, "left_semi")
    return docs.join(small_side(twice), keys, "left_anti").unionByName(
        several.groupBy(*keys).agg(F.max("contents").alias("contents")))


class Index:
    """The index tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8,
                 admission: Admission | None = None):
        """``buckets`` is used when the index is new: aim at about 1 GB of postings per
        volume and bucket, so that a lookup opens one bucket's files only. ``admission`` says
        which documents builds and commits take in; all by default."""
        self.spark = spark
        self.root = root.rstrip("/")
        self._new_buckets = buckets
        self._admission = admission
        self._seen: tuple[tuple, IndexView] | None = None

    # ---- what is there -------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame | None:
        """A table of the index, or None before its first write."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _batches(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        """Some batches of a table. Other batches are not even listed."""
        if not batches:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.root}/{name}"
        return self.spark.read.schema(schema).option("basePath", folder).parquet(
            *[f"{folder}/batch_id={b}" for b in batches])

    def _log(self) -> list:
        """The commit log, oldest first: one small row per batch, so it fits the driver."""
        commits = self._table("commits", schemas.COMMITS)
        return [] if commits is None else sorted(commits.distinct().collect())

    def exists(self) -> bool:
        return bool(self._log())

    def _bases(self, log: list) -> DataFrame:
        """(volume, base, n_docs at the base) of every volume that has an index and was
        not excluded."""
        bases = [c["batch_id"] for c in log if c["is_base"]]
        stats = self._batches("volume_stats", schemas.VOLUME_STATS, bases)
        stats = stats.groupBy("volume").agg(
            F.max("batch_id").alias("base"), F.max_by("n_docs", "batch_id").alias("n_docs"))
        return self._not_excluded(stats)

    def _not_excluded(self, rows: DataFrame) -> DataFrame:
        excluded = self._table("excluded_volumes", schemas.EXCLUDED_VOLUMES)
        if excluded is None:
            return rows
        return rows.join(small_side(excluded.distinct()), "volume", "left_anti")

    def indexed_volumes(self) -> DataFrame:
        """(volume) of every volume that can be searched."""
        return self._bases(self._log()).select("volume")

    # ---- live rows -----------------------------------------------------------------

    def view(self) -> IndexView:
        """The live index as of now; ask again to see later commits. While there is none,
        the view, with its listing of files, is the same.

        A row is dead when its volume got a newer base, or its path a newer change. The
        first is a join with one row per volume, the second a join with the paths changed
        since the bases, which are few next to the postings. A view over one base
        batch has neither join, and whole batches before every base are not read.
        """
        log = self._log()
        excluded = self._table("excluded_volumes", schemas.EXCLUDED_VOLUMES)
        state_of_things = (log, excluded is not None and sorted(excluded.inputFiles()))
        if self._seen is None or self._seen[0] != state_of_things:
            self._seen = state_of_things, self._open(log, excluded is not None)
        return self._seen[1]

    def _open(self, log: list, has_exclusions: bool) -> IndexView:
        bases = self._bases(log)
        rows, size, first = bases.agg(*size_columns(bases), F.min("base")).first()
        extent = Size(rows, size)
        current = broadcast_within(bases, extent)
        seen = [c for c in log if first is not None and c["batch_id"] >= first]
        batches = [c["batch_id"] for c in seen]
        deltas = [c["batch_id"] for c in seen if not c["is_base"]]
        one_base = len(batches) == 1 and not has_exclusions

        def after_base(rows):
            if one_base:
                return rows
            kept = rows.join(current.select("volume", "base"), "volume")
            return kept.filter(F.col("batch_id") >= F.col("base")).select(*rows.columns)

        changed = None
        if deltas:
            changed = small_side(
                self._batches("doc_state", schemas.DOC_STATE, deltas)
                .groupBy("volume", "path").agg(F.max("batch_id").alias("last")))

        def keep_live(rows):
            rows = after_base(rows)
            if changed is None:
                return rows
            # An outer join stays where it is put: after the lookup. An anti join would
            # be moved below it, to all postings.
            latest = F.col("last").isNull() | (F.col("batch_id") >= F.col("last"))
            return (rows.join(changed, ["volume", "path"], "left").filter(latest)
                    .select(*rows.columns))

        stored = self._batches("postings", schemas.POSTINGS, batches)
        stored = stored.filter(F.col("bucket") >= 0)
        state = self._batches("doc_state", schemas.DOC_STATE, batches)
        doc_list = keep_live(state).filter("live").select("volume", "path", "dl")
        terms = self._batches(
            "terms", schemas.TERMS, [c["batch_id"] for c in seen if c["is_base"]])
        words = terms.select("term")
        if deltas:
            new_words = (self._batches("postings", schemas.POSTINGS, deltas)
                         .filter(F.col("bucket") >= 0).select("term"))
            words = words.unionByName(new_words)
            sizes, terms = volume_sizes(doc_list), None
        else:
            sizes = bases.select("volume", "n_docs")
            terms = after_base(terms).select("volume", "bucket", "term", "df")
        return IndexView(stored, doc_list, sizes, words.distinct(), self._buckets(log),
                         terms, keep_live, extent)

    def postings(self) -> DataFrame:
        return self.view().postings

    def doc_list(self) -> DataFrame:
        return self.view().doc_list

    # ---- jobs that write -----------------------------------------------------------

    def _taken_in(self, docs: DataFrame) -> DataFrame:
        """Documents that may be indexed. A volume and a path must be named."""
        docs = docs.filter(named(F.col("volume")) & F.col("path").isNotNull())
        if self._admission is not None:
            docs = self._admission.admit(docs)
        return self._not_excluded(docs.select("volume", "path", "contents"))

    def build(self, docs: DataFrame, volumes: DataFrame | None = None) -> int:
        """Index whole volumes: all that ``docs`` has, or those of ``volumes``, also if
        they are empty by now. Earlier rows of these volumes are dead from here on. Documents
        without a named volume or path, and those that the admission turns down, are left
        out (``rejection_report`` counts them); a path that occurs twice is indexed once."""
        if volumes is not None:
            volumes = volumes.select("volume").filter(named(F.col("volume"))).distinct()
            docs = docs.join(small_side(volumes), "volume", "left_semi")
        log = self._log()
        batch_id = self._next_batch(log)
        self._write_postings(one_per_path(self._taken_in(docs)), batch_id, log)
        written = self._written(batch_id)
        listed = written.filter(F.col("bucket") == -1)
        self._write_state(listed.select("volume", "path", "dl", F.lit(True).alias("live")),
                          batch_id)
        terms = document_frequencies(
            written.filter(F.col("bucket") >= 0).select("volume", "term")).withColumn(
            "bucket", term_bucket(F.col("term"), self._buckets(log)))
        self._writer(terms.hint("rebalance", "volume", "bucket").sortWithinPartitions(
            "volume", "bucket", "term")).partitionBy("volume", "bucket").parquet(
            f"{self.root}/terms/batch_id={batch_id}")
        sizes = volume_sizes(listed)
        if volumes is not None:
            sizes = (volumes.join(sizes, "volume", "left")
                     .select("volume", F.coalesce("n_docs", F.lit(0)).alias("n_docs")))
        self._writer(sizes).parquet(f"{self.root}/volume_stats/batch_id={batch_id}")
        self._publish(batch_id, True, None, log)
        return batch_id

    def bootstrap(self, docs: DataFrame, volumes: DataFrame) -> int | None:
        """Build the volumes that have no index yet and leave the others as they are."""
        new = self._not_excluded(volumes.select("volume").distinct()).join(
            small_side(self.indexed_volumes()), "volume", "left_anti")
        return None if new.isEmpty() else self.build(docs, new)

    def reindex(self, docs: DataFrame, volumes: DataFrame | None = None) -> int:
        """Rebuild some volumes, or all. Drops the dead rows: they are no longer read."""
        if volumes is None:
            volumes = self.indexed_volumes().unionByName(docs.select("volume")).distinct()
        return self.build(docs, volumes)

    def commit(self, changes: DataFrame, docs: DataFrame | ReadDocs,
               volumes: DataFrame | None = None, token: str | None = None) -> int | None:
        """Apply changes (volume, path, op, batch) to the index: net effect, deletes, then
        the updates with the contents found in ``docs`` now, which is the corpus or, so that
        the work grows with the batch only, a function that reads the documents of given
        paths. Updates pass the admission, removals pass unchecked. ``volumes`` restricts the
        commit. A ``token`` seen before makes it a no-op, so a redelivered batch counts
        once."""
        log = self._log()
        if token is not None and any(c["token"] == token for c in log):
            return None
        scope = self._bases(log)
        if volumes is not None:
            scope = scope.join(small_side(volumes.select("volume")), "volume", "left_semi")
        feed = route_to_volume(classify_changes(changes), scope)
        net = last_changes(feed).persist()
        try:
            batch_id = self._next_batch(log)
            self._write_postings(
                one_per_path(self._taken_in(late_bound_content(net, docs))), batch_id, log)
            added = (self._written(batch_id)
                     .filter(F.col("bucket") == -1).select("volume", "path", "dl"))
            state = net.join(added, ["volume", "path"], "left").select(
                "volume", "path", F.coalesce("dl", F.lit(0)).alias("dl"),
                F.col("dl").isNotNull().alias("live"))
            self._write_state(state, batch_id)
            self._publish(batch_id, False, token, log)
        finally:
            net.unpersist()
        return batch_id

    def exclude_volume(self, volumes: DataFrame) -> None:
        """Leave volumes out for good: out of every search, and of later builds and
        commits. For one session, use ``view().volumes(...)`` instead."""
        (volumes.select("volume").distinct().write.mode("append")
         .parquet(f"{self.root}/excluded_volumes"))

    # ---- helpers -------------------------------------------------------------------

    def _next_batch(self, log: list) -> int:
        return max((c["batch_id"] for c in log), default=-1) + 1

    def _buckets(self, log: list) -> int:
        return log[0]["buckets"] if log else self._new_buckets

    def _written(self, batch_id: int) -> DataFrame:
        return self._batches("postings", schemas.POSTINGS, [batch_id])

    def _write_postings(self, docs: DataFrame, batch_id: int, log: list) -> None:
        """Sorted by term within volume and bucket. Rebalancing splits what is too big
        for one task, whatever volume or term it is, and merges what is too small."""
        rows = build_postings(docs, list_documents=True).withColumn(
            "bucket", term_bucket(F.col("term"), self._buckets(log)))
        self._writer(rows.hint("rebalance", "volume", "bucket").sortWithinPartitions(
            "volume", "bucket", "term", "path")).partitionBy("volume", "bucket").parquet(
            f"{self.root}/postings/batch_id={batch_id}")

    def _writer(self, rows: DataFrame) -> DataFrameWriter:
        """Overwrites the whole folder of a batch, whatever the session says of partitions:
        nothing that a lost attempt left may stay."""
        return rows.write.mode("overwrite").option("partitionOverwriteMode", "static")

    def _write_state(self, state: DataFrame, batch_id: int) -> None:
        self._writer(state.hint("rebalance", "volume").sortWithinPartitions(
            "volume", "path")).partitionBy("volume").parquet(
            f"{self.root}/doc_state/batch_id={batch_id}")

    def _publish(self, batch_id: int, is_base: bool, token: str | None, log: list) -> None:
        row = self.spark.range(1).select(
            F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(is_base).alias("is_base"),
            F.lit(self._buckets(log)).alias("buckets"), F.lit(token).cast("string").alias("token"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
