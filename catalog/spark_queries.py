"""One function (spark, data folder) -> DataFrame per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import search, search_text, view_of
from shelfmark.functions.analysis import tokens
from shelfmark.operators import admission, changes as feed_ops, postings as posting_ops, results
from shelfmark.session import scratch_path
from shelfmark.sources import corpus, feed
from shelfmark.sources.tables import read_table, spread
from shelfmark.streaming.follow import drain_batches

from . import inputs

REGISTRY: dict = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


def _clauses(rows: DataFrame, **given) -> DataFrame:
    """Clauses from query tokens; values are columns or plain values."""
    given = {"clause_id": F.col("i"), "text": F.col("term")} | given
    return rows.select("query_id", *[
        (v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in given.items()])


def _hits(spark: SparkSession, sf: str, clauses: DataFrame, shared: bool = False) -> DataFrame:
    return search(inputs.corpus_index(spark, sf).view(), clauses, shared)


def _any_token(spark: SparkSession, sf: str, shared: bool = False) -> DataFrame:
    return _hits(spark, sf, _clauses(inputs.query_tokens(spark, sf)), shared)


def _all_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, _clauses(inputs.query_tokens(spark, sf), occur="must"))


# ---- sources and sinks -------------------------------------------------------------------


@query
def scan_volume(spark, sf):
    return corpus.scan_volume(inputs.entries(spark, sf)).select("volume", "path", "type")


@query
def eligible_volumes(spark, sf):
    docs = inputs.documents(spark, sf).select("volume", "path")
    return corpus.in_scope(docs, inputs.scope(spark, sf))


@query
def changes_since(spark, sf):
    events = feed.changes_since(read_table(spark, sf, "events"), inputs.FEED_START)
    return inputs.with_volume(inputs.as_feed(events), read_table(spark, sf, "documents")) \
        .select("seq", "volume", "path", "op")


@query
def backfill_then_follow(spark, sf):
    # Two files are there at first, a third arrives; each is a micro-batch of its own.
    folder, target = scratch_path(spark, "feed"), scratch_path(spark, "followed")
    checkpoint = scratch_path(spark, "checkpoint")
    schema = read_table(spark, sf, "events").schema

    def follow():
        events = feed.follow_table(spark, folder, schema, files_per_batch=1)
        run = (inputs.as_feed(events).writeStream.format("parquet").option("path", target)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        run.awaitTermination()

    *first, last = inputs.feed_parts(spark, sf)
    for part in first:
        inputs.add_file(part, folder)
    follow()
    inputs.add_file(last, folder)
    follow()
    followed = spark.read.schema(inputs.as_feed(read_table(spark, sf, "events")).schema) \
        .parquet(target)
    return inputs.with_volume(followed, read_table(spark, sf, "documents")) \
        .select("seq", "volume", "path", "op")


@query
def bootstrap_or_merge(spark, sf):
    files = inputs.entries(spark, sf)
    index = inputs.new_index(spark, "bootstrap", inputs.admission(spark))
    index.build(files, inputs.scope(spark, sf))
    index.bootstrap(files, inputs.volumes(spark, sf))
    return index.doc_list()


@query
def extract_text(spark, sf):
    return corpus.pages_corpus(spread(read_table(spark, sf, "pages")))


@query
def write_index(spark, sf):
    index = inputs.new_index(spark, "written")
    index.build(inputs.documents(spark, sf))
    return index.postings().select("volume", "term", "path", "tf", "dl")


@query
def read_index(spark, sf):
    view = inputs.corpus_index(spark, sf).view()
    terms = view.terms.groupBy("volume").agg(F.count(F.lit(1)).alias("n_terms"))
    return view.sizes.join(terms, "volume", "left").select(
        "volume", "n_docs", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


@query
def write_hits(spark, sf):
    target = scratch_path(spark, "hits")
    _any_token(spark, sf).write.parquet(target)
    return spark.read.schema("query_id BIGINT, volume STRING, path STRING, score DOUBLE") \
        .parquet(target)


# ---- admission ---------------------------------------------------------------------------


def _listed(entries: DataFrame) -> DataFrame:
    return entries.select("volume", "path", "kind", "type")


@query
def regular_files(spark, sf):
    return _listed(admission.regular_files(inputs.entries(spark, sf)))


@query
def visible_paths(spark, sf):
    return _listed(admission.visible_paths(inputs.entries(spark, sf)))


@query
def no_symlinks(spark, sf):
    return _listed(admission.no_symlinks(inputs.entries(spark, sf)))


@query
def not_excluded(spark, sf):
    return _listed(admission.not_excluded(inputs.entries(spark, sf), inputs.excludes(spark)))


@query
def not_in_index_dir(spark, sf):
    return _listed(admission.not_in_index_dir(inputs.entries(spark, sf), inputs.INDEX_DIR))


@query
def supported_types(spark, sf):
    return _listed(admission.supported_types(inputs.entries(spark, sf),
                                             inputs.supported(spark)))


def _status(spark, sf):
    return admission.admission_status(
        inputs.entries(spark, sf), inputs.supported(spark), inputs.INDEX_DIR)


@query
def admission_status(spark, sf):
    return _status(spark, sf).select("volume", "path", "kind", "admission_status")


@query
def admit_updates_only(spark, sf):
    entries = inputs.entries(spark, sf)
    changes = inputs.file_changes(read_table(spark, sf, "events"), entries).select(
        "seq", "volume", "path", "op")
    return admission.admit_updates_only(changes, entries, inputs.excludes(spark))


# ---- change feed -------------------------------------------------------------------------


@query
def classify_changes(spark, sf):
    # Signups play the opcode that is not handled.
    events = read_table(spark, sf, "events")
    moved = events.filter("event_type = 'signup'").select(F.col("event_id").alias("seq"))
    raw = inputs.changes(spark, sf).join(moved.withColumn("_moved", F.lit(True)), "seq", "left")
    raw = raw.withColumn("op", F.when(F.col("_moved"), "moved").otherwise(F.col("op")))
    return feed_ops.classify_changes(raw).select("seq", "volume", "path", "op")


@query
def route_to_volume(spark, sf):
    return feed_ops.route_to_volume(inputs.changes(spark, sf), inputs.scope(spark, sf)) \
        .select("seq", "volume", "path", "op")


@query
def drain_batch(spark, sf):
    # Two files of changes are there at first, a third arrives; each is a commit of its own.
    files = inputs.entries(spark, sf)
    index = inputs.new_index(spark, "streamed", inputs.admission(spark))
    index.build(files)
    folder, checkpoint = scratch_path(spark, "feed"), scratch_path(spark, "checkpoint")
    schema = read_table(spark, sf, "events").schema

    def drain():
        run = drain_batches(
            index, feed.follow_table(spark, folder, schema, files_per_batch=1),
            lambda: inputs.entries(spark, sf), checkpoint, name="drain", available_now=True,
            prepare=lambda rows: inputs.file_changes(rows, inputs.entries(spark, sf)))
        run.awaitTermination()

    *first, last = inputs.feed_parts(spark, sf)
    for part in first:
        inputs.add_file(part, folder)
    drain()
    inputs.add_file(last, folder)
    drain()
    return index.doc_list()


@query
def net_changes(spark, sf):
    return feed_ops.net_changes(inputs.changes(spark, sf))


@query
def late_bound_content(spark, sf):
    net = feed_ops.last_changes(inputs.changes(spark, sf))
    return feed_ops.late_bound_content(net, inputs.current_reader(spark, sf)) \
        .select("volume", "path", "contents")


@query
def attach_volume(spark, sf):
    scope = corpus.attach_volume(
        inputs.scope(spark, sf), inputs.volumes(spark, sf), monitor_removable=True)
    index, docs = inputs.new_index(spark, "attached"), inputs.documents(spark, sf)
    index.build(docs, inputs.scope(spark, sf))
    index.bootstrap(docs, scope)
    return index.doc_list().select("volume", "path")


@query
def detach_volume(spark, sf):
    leaving = inputs.volumes(spark, sf).filter("volume_order >= 10")
    scope = corpus.detach_volume(inputs.scope(spark, sf), leaving)
    return corpus.in_scope(inputs.documents(spark, sf).select("volume", "path"), scope)


# ---- index tables ------------------------------------------------------------------------


def _plain(postings: DataFrame) -> DataFrame:
    """Postings with the positions as text, which both engines print alike."""
    return postings.select("volume", "term", "path", "tf", "dl", F.concat_ws(
        ",", F.col("positions").cast("array<string>")).alias("positions"))


@query
def build_postings(spark, sf):
    return _plain(posting_ops.build_postings(inputs.documents(spark, sf)))


@query
def build_postings_pages(spark, sf):
    docs = corpus.pages_corpus(spread(read_table(spark, sf, "pages")))
    return _plain(posting_ops.build_postings(docs))


@query
def build_postings_conversations(spark, sf):
    docs = corpus.conversations_corpus(spread(read_table(spark, sf, "conversations")))
    return _plain(posting_ops.build_postings(docs))


@query
def build_statistics(spark, sf):
    view = view_of(inputs.documents(spark, sf))
    return view.terms.join(view.sizes, "volume").select(
        "volume", "term", "df", "n_docs")


@query
def document_lengths(spark, sf):
    return posting_ops.document_lengths(inputs.documents(spark, sf))


def _touched(spark, sf, is_update: bool) -> DataFrame:
    last = feed_ops.last_changes(inputs.changes(spark, sf))
    return last.filter(F.col("is_update") == is_update).select("volume", "path")


@query
def upsert_docs(spark, sf):
    docs = inputs.documents(spark, sf)
    batch = docs.join(_touched(spark, sf, True), ["volume", "path"]).withColumn(
        "contents", F.concat("contents", F.lit(" revised")))
    return posting_ops.upsert_docs(docs, batch).select(
        "volume", "path", F.length("contents").alias("n_chars"),
        F.md5("contents").alias("digest"))


@query
def delete_docs(spark, sf):
    docs = inputs.documents(spark, sf).select("volume", "path")
    return posting_ops.delete_docs(docs, _touched(spark, sf, False))


def _committed(spark, sf, name: str):
    index = inputs.new_index(spark, name)
    index.build(inputs.documents(spark, sf))
    index.commit(inputs.changes(spark, sf), inputs.current_reader(spark, sf))
    return index


@query
def commit(spark, sf):
    postings = _committed(spark, sf, "committed").postings()
    return postings.groupBy("volume", "path").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query
def reindex(spark, sf):
    index = _committed(spark, sf, "reindexed")
    index.reindex(inputs.current_documents(spark, sf))
    return index.view().terms.select("volume", "term", "df")


@query
def exclude_volume(spark, sf):
    index = inputs.new_index(spark, "excluding")
    index.build(inputs.documents(spark, sf), inputs.volumes(spark, sf))
    index.exclude_volume(inputs.volumes(spark, sf).filter("is_removable"))
    return index.view().volumes(inputs.volumes(spark, sf).filter("knows_query")).doc_list


@query
def commit_report(spark, sf):
    return feed_ops.commit_report(inputs.changes(spark, sf))


@query
def rejection_report(spark, sf):
    return admission.rejection_report(_status(spark, sf))


# ---- text analysis -----------------------------------------------------------------------


@query
def tokenize(spark, sf):
    return inputs.documents(spark, sf).select(
        "volume", "path", F.posexplode(tokens(F.col("contents"))).alias("pos", "term"))


@query
def lowercase(spark, sf):
    terms = inputs.documents(spark, sf).select(F.explode(tokens(F.col("contents"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def stop_words(spark, sf):
    return posting_ops.tokenize(inputs.documents(spark, sf))


@query
def exact_key(spark, sf):
    keys = inputs.queries(spark, sf).select(F.col("query_id").cast("string").alias("path"))
    return inputs.documents(spark, sf).select("volume", "path").join(keys, "path")


@query
def analyze_query(spark, sf):
    rows = inputs.queries(spark, sf).select(
        F.lit("").alias("volume"), F.col("query_id").alias("path"),
        F.col("text").alias("contents"))
    return posting_ops.tokenize(rows).select(F.col("path").alias("query_id"), "pos", "term")


# ---- search ------------------------------------------------------------------------------


@query
def search_term(spark, sf):
    return _hits(spark, sf, _clauses(inputs.token_queries(spark, sf), clause_id=0))


@query
def search_any(spark, sf):
    return _any_token(spark, sf)


@query
def search_all(spark, sf):
    return _all_tokens(spark, sf)


@query
def search_not(spark, sf):
    occur = F.when(F.col("i") % 8 == 7, "must_not").otherwise("should")
    return _hits(spark, sf, _clauses(inputs.query_tokens(spark, sf), occur=occur))


@query
def search_occur(spark, sf):
    occur = F.when(F.col("i") % 16 == 0, "must").when(
        F.col("i") % 16 == 15, "must_not").otherwise("should")
    return _hits(spark, sf, _clauses(inputs.query_tokens(spark, sf), occur=occur))


def _texts(spark, sf, **given) -> DataFrame:
    """One clause for each whole text."""
    return _clauses(inputs.queries(spark, sf), clause_id=0, text=F.col("text"), **given)


@query
def search_phrase(spark, sf):
    return _hits(spark, sf, _texts(spark, sf, kind="phrase"))


@query
def search_proximity(spark, sf):
    return _hits(spark, sf, _texts(spark, sf, kind="proximity", slop=inputs.SLOP))


def _patterns(spark, sf, **given) -> DataFrame:
    """One query with one pattern clause for each token."""
    return _clauses(inputs.token_queries(spark, sf), **({"clause_id": 0} | given))


@query
def search_prefix(spark, sf):
    return _hits(spark, sf, _patterns(spark, sf, kind="prefix", text=F.left("term", F.lit(3))))


@query
def search_wildcard(spark, sf):
    pattern = F.concat(F.left("term", F.lit(1)), F.lit("?"), F.substring("term", 3, 1), F.lit("*"))
    return _hits(spark, sf, _patterns(spark, sf, kind="wildcard", text=pattern))


@query
def search_fuzzy(spark, sf):
    edits = F.when(F.length("term") < 6, 1).otherwise(2)
    return _hits(spark, sf, _patterns(spark, sf, kind="fuzzy", slop=edits))


@query
def search_range(spark, sf):
    inside = _patterns(spark, sf, kind="range", text=F.left("term", F.lit(3)),
                       text2=F.col("term"), occur="should")
    above = _patterns(spark, sf, clause_id=1, kind="range_exclusive",
                      text2=F.concat("term", F.lit("z")), occur="must_not")
    return _hits(spark, sf, inside.unionByName(above))


@query
def search_boost(spark, sf):
    boost = F.when(F.col("i") % 2 == 0, 2.5).otherwise(0.5)
    return _hits(spark, sf, _clauses(inputs.query_tokens(spark, sf), boost=boost))


@query
def search_groups(spark, sf):
    return _hits(spark, sf, _clauses(
        inputs.query_tokens(spark, sf), group_id=F.col("i") % 2,
        group_occur=F.when(F.col("i") % 2 == 0, "must").otherwise("should")))


def _own_path(spark, sf) -> DataFrame:
    return _clauses(inputs.queries(spark, sf), clause_id=-1, field="path",
                    text=F.col("query_id").cast("string"))


@query
def search_field(spark, sf):
    words = _clauses(inputs.query_tokens(spark, sf), field="contents")
    return _hits(spark, sf, words.unionByName(_own_path(spark, sf)))


@query
def score_hits(spark, sf):
    view = inputs.corpus_index(spark, sf).view()
    return search_text(view, inputs.queries(spark, sf))


@query
def rank_hits(spark, sf):
    return results.rank_hits(_any_token(spark, sf))


@query
def search_batch(spark, sf):
    return results.merged_ranking(score_hits(spark, sf))


@query
def search_nested(spark, sf):
    tokens_of = inputs.query_tokens(spark, sf)
    first, second = (_hits(spark, sf, _clauses(tokens_of.filter(f"i % 2 = {half}")))
                     for half in (0, 1))
    phrase = _hits(spark, sf, _texts(spark, sf, kind="phrase"))
    path = _hits(spark, sf, _own_path(spark, sf))
    return results.either(results.without(results.both(first, second), phrase), path)


# ---- results -----------------------------------------------------------------------------


def _positions(spark, sf):
    ranked = results.rank_hits(_any_token(spark, sf))
    return results.concat_volumes(ranked, inputs.volumes(spark, sf))


@query
def concat_volumes(spark, sf):
    return _positions(spark, sf).select("query_id", "position", "volume", "rank", "path")


@query
def merged_ranking(spark, sf):
    return results.merged_ranking(_any_token(spark, sf, shared=True))


@query
def hit_paths(spark, sf):
    return results.hit_paths(_positions(spark, sf))


@query
def open_hit(spark, sf):
    return results.open_hits(_all_tokens(spark, sf), inputs.documents(spark, sf)).select(
        "query_id", "volume", "path", "contents")


@query
def top_k(spark, sf):
    return results.top_k(_any_token(spark, sf), 3)
