"""The driver's tables in the roles of the search model. ``oracle.py`` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.analysis import positioned
from shelfmark.operators.admission import Admission
from shelfmark.operators.changes import ReadDocs
from shelfmark.plans.index import Index
from shelfmark.session import scratch_path
from shelfmark.sources.corpus import documents_by_key, documents_corpus, eligible_volumes
from shelfmark.sources.tables import read_table, spread

INDEX_DIR = "/es/"
SUPPORTED = ["en", "fr", "es"]
EXCLUDES = [("src1", "/fr/"), ("src2", "/en/"), ("src3", "/de/.drafts/")]
FEED_START = "2024-01-15 00:00:00"
# Queries of single tokens are numbered item * TOKEN_QUERIES + token.
TOKEN_QUERIES = 1_000_000
# Other tokens allowed in the window of a whole text.
SLOP = 40


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus (volume, path, contents)."""
    return documents_corpus(spread(read_table(spark, sf, "documents")))


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    """The volumes of the corpus, with flags made from their numbers."""
    source = F.col("source")
    return read_table(spark, sf, "documents").select("source").distinct().select(
        source.alias("volume"), source.endswith("5").alias("is_removable"),
        (~source.endswith("7")).alias("knows_query"),
        F.substring(source, 4, 9).cast("int").alias("volume_order"))


def scope(spark: SparkSession, sf: str) -> DataFrame:
    return eligible_volumes(volumes(spark, sf))


def current_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as it is when a commit reads it: toxic documents are gone by then."""
    gone = read_table(spark, sf, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("path"))
    return documents(spark, sf).join(gone, "path", "left_anti")


def current_reader(spark: SparkSession, sf: str) -> ReadDocs:
    """Reads single documents of that corpus."""
    labels = read_table(spark, sf, "labels").filter("toxic = 1")
    read = documents_by_key(read_table(spark, sf, "documents"))
    gone = labels.select(F.col("doc_id").cast("string").alias("path"))
    return lambda paths: read(paths).join(gone, "path", "left_anti")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files in folders: low-quality ones in a hidden folder, toxic ones
    under a hidden name (no path where both hold), copies of an earlier text as links;
    plus one entry for each language folder."""
    docs = read_table(spark, sf, "documents")
    first = docs.groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id")).select(
        "doc_id", F.lit("file").alias("first"))
    labels = read_table(spark, sf, "labels")
    bad, toxic = F.coalesce("quality", F.lit(1)) == 0, F.coalesce("toxic", F.lit(0)) == 1
    path = F.when(~(bad & toxic), F.concat(
        F.lit("/"), "lang", F.lit("/"), F.when(bad, ".drafts/").otherwise(""),
        F.when(toxic, ".").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.join(first, "doc_id", "left").join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("volume"), path.alias("path"),
        F.coalesce("first", F.lit("symlink")).alias("kind"), F.col("lang").alias("type"),
        F.col("text").alias("contents"))
    folders = docs.select("source", "lang").distinct().select(
        F.lit(None).cast("bigint").alias("doc_id"), F.col("source").alias("volume"),
        F.concat(F.lit("/"), "lang").alias("path"), F.lit("dir").alias("kind"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("contents"))
    return files.unionByName(folders)


def file_changes(events: DataFrame, all_entries: DataFrame) -> DataFrame:
    """Events as changes (seq, ts, volume, path, op, batch) of these files."""
    places = all_entries.select("doc_id", "volume", "path").filter("path IS NOT NULL")
    return as_feed(events).join(places, "doc_id").select(
        "seq", "ts", "volume", "path", "op", "batch")


def admission(spark: SparkSession) -> Admission:
    return Admission(supported(spark), excludes(spark), INDEX_DIR)


def feed_parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The events in three parts, each with later days than the one before."""
    events, day = read_table(spark, sf, "events"), F.dayofmonth("ts")
    return [events.filter(day <= 10), events.filter((day > 10) & (day <= 20)),
            events.filter(day > 20)]


def add_file(part: DataFrame, folder: str) -> None:
    """One more file in a feed's folder."""
    part.coalesce(1).write.mode("append").parquet(folder)


def excludes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXCLUDES, schemas.EXCLUDES)


def supported(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in SUPPORTED], schemas.SUPPORTED_TYPES)


def as_feed(events: DataFrame) -> DataFrame:
    """Events as changes without a volume yet: (seq, ts, doc_id, op, batch)."""
    return events.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("doc_id"),
        F.when(F.col("event_type") == "error", "removed").otherwise("created").alias("op"),
        F.unix_date(F.to_date("ts")).cast("bigint").alias("batch"))


def with_volume(feed: DataFrame, documents_table: DataFrame) -> DataFrame:
    """Changes (seq, ts, volume, path, op, batch): the volume is that of the document."""
    owner = documents_table.select("doc_id", F.col("source").alias("volume"))
    return feed.join(owner, "doc_id").select(
        "seq", "ts", "volume", F.col("doc_id").cast("string").alias("path"), "op", "batch")


def changes(spark: SparkSession, sf: str) -> DataFrame:
    return with_volume(as_feed(read_table(spark, sf, "events")),
                       read_table(spark, sf, "documents"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text")


def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, i, term): every distinct token of every text that is not a stop word,
    numbered in the order of its first place."""
    terms = F.transform(positioned(F.col("text")), lambda t: t["term"])
    return queries(spark, sf).select(
        "query_id", F.posexplode(F.array_distinct(terms)).alias("i", "term"))


def token_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, term): one query for each of these tokens."""
    return query_tokens(spark, sf).select(
        (F.col("query_id") * TOKEN_QUERIES + F.col("i")).alias("query_id"), "term")


_indexes: dict[tuple[str, str], Index] = {}


def new_index(spark: SparkSession, name: str, rules: Admission | None = None) -> Index:
    return Index(spark, scratch_path(spark, f"index-{name}"), buckets=4, admission=rules)


def corpus_index(spark: SparkSession, sf: str) -> Index:
    """The index of the whole corpus, built once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        index = new_index(spark, "corpus")
        index.build(documents(spark, sf))
        _indexes[key] = index
    return _indexes[key]
