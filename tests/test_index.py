"""Index tables: commits, liveness, reindex, exclusion and the stream."""

import itertools

import pytest
from pyspark.sql import functions as F

from shelfmark import Index, schemas, search_text
from shelfmark.operators import changes as change_ops, postings as posting_ops
from shelfmark.session import scratch_path
from shelfmark.sources.corpus import follow_files, read_files, scan_volume
from shelfmark.sources.feed import changes_since, follow_table
from shelfmark.streaming.follow import drain_batches

CHANGE = "seq BIGINT, volume STRING, path STRING, op STRING, batch BIGINT"
OLD = {("v1", "replaced"): "old words", ("v1", "removed"): "alpha", ("v1", "both"): "beta here",
       ("v1", "lost"): "gamma", ("v1", "still"): "alpha beta", ("v2", "same"): "alpha",
       ("v1", "/.cfg/hidden"): "alpha"}
NEW = {("v1", "new"): "fresh alpha", ("v1", "replaced"): "new words", ("v1", "both"): "beta now",
       ("v1", "twice"): "two two", ("v1", "still"): "alpha beta", ("v2", "same"): "alpha",
       ("v1", "moved"): "never"}
FEED = [("v1", "new", "created"), ("v1", "replaced", "created"), ("v1", "removed", "removed"),
        ("v1", "unknown", "removed"), ("v1", "both", "removed"), ("v1", "both", "created"),
        ("v1", "both", "removed"), ("v1", "gone", "created"), ("v1", "gone", "removed"),
        ("v1", "lost", "created"), ("v1", "twice", "created"), ("v1", "twice", "created"),
        ("v1", "moved", "moved"), ("v9", "elsewhere", "created"),
        ("v1", "/.cfg/hidden", "removed")]
AFTER = {("v1", "new"): "fresh alpha", ("v1", "replaced"): "new words",
         ("v1", "both"): "beta now", ("v1", "twice"): "two two", ("v1", "still"): "alpha beta",
         ("v2", "same"): "alpha"}


def docs_of(spark, corpus):
    return spark.createDataFrame([(v, p, c) for (v, p), c in corpus.items()], schemas.DOCS)


def feed_of(spark, rows, batch=1):
    return spark.createDataFrame(
        [(i, v, p, op, batch) for i, (v, p, op) in enumerate(rows)], CHANGE)


def new_index(spark, corpus=OLD):
    index = Index(spark, scratch_path(spark, "index"), buckets=2)
    index.build(docs_of(spark, corpus))
    return index


def listed(index):
    return {(r["volume"], r["path"]): r["dl"] for r in index.doc_list().collect()}


def inverted(postings):
    return sorted((r["volume"], r["term"], r["path"], r["tf"], r["dl"], tuple(r["positions"]))
                  for r in postings.collect())


def statistics(view, spark):
    terms = view.postings.select("term").distinct()
    df = {(r["volume"], r["term"]): r["df"] for r in
          view.frequencies(terms, view.extent).collect()}
    return df, {r["volume"]: r["n_docs"] for r in view.sizes.collect()}


def same_as_rebuilt(spark, index, corpus):
    rebuilt = new_index(spark, corpus)
    assert listed(index) == listed(rebuilt)
    assert inverted(index.postings()) == inverted(rebuilt.postings())
    assert statistics(index.view(), spark) == statistics(rebuilt.view(), spark)
    queries = spark.createDataFrame([(1, "alpha beta new")], "query_id BIGINT, text STRING")
    scores = [sorted(map(tuple, search_text(i.view(), queries).collect()))
              for i in (index, rebuilt)]
    assert scores[0] == scores[1]


def test_postings_without_a_shuffle(spark):
    docs = docs_of(spark, {("v", "a"): "b the c B", ("v", "b"): "", ("v", "c"): None})
    postings = posting_ops.build_postings(docs, list_documents=True)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    assert inverted(postings) == [
        ("v", "", "a", 0, 3, ()), ("v", "", "b", 0, 0, ()), ("v", "", "c", 0, 0, ()),
        ("v", "b", "a", 2, 3, (0, 3)), ("v", "c", "a", 1, 3, (2,))]
    assert {r["path"]: r["dl"] for r in posting_ops.document_lengths(docs).collect()} == {
        "a": 3, "b": 0, "c": 0}


def test_commit_cases(spark):
    index = new_index(spark)
    index.commit(feed_of(spark, FEED), docs_of(spark, NEW))
    assert set(listed(index)) == set(AFTER)
    same_as_rebuilt(spark, index, AFTER)


def test_shuffled_commit_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr("shelfmark.session.BROADCAST_ROWS", -1)
    index = new_index(spark)
    index.commit(feed_of(spark, FEED), docs_of(spark, NEW))
    same_as_rebuilt(spark, index, AFTER)


def test_commits_one_after_the_other(spark):
    """Three commits, and the same three batches in one commit."""
    steps = [[("v1", "removed", "removed"), ("v1", "new", "created")],
             [("v1", "removed", "created"), ("v1", "new", "removed")],
             [("v2", "same", "removed"), ("v1", "still", "created")]]
    docs = {**OLD, ("v1", "new"): "fresh", ("v1", "still"): "other text"}
    one, many = new_index(spark), new_index(spark)
    feeds = [feed_of(spark, step, batch) for batch, step in enumerate(steps)]
    for feed in feeds:
        many.commit(feed, docs_of(spark, docs))
    one.commit(feeds[0].union(feeds[1]).union(feeds[2]), docs_of(spark, docs))
    expected = {k: v for k, v in OLD.items() if k != ("v2", "same")}
    expected["v1", "still"] = "other text"
    same_as_rebuilt(spark, many, expected)
    same_as_rebuilt(spark, one, expected)


def test_order_in_a_batch_does_not_matter(spark):
    rows = [("v1", "a", "created"), ("v1", "a", "removed"), ("v1", "b", "removed")]
    for order in itertools.permutations(rows):
        net = change_ops.net_changes(feed_of(spark, order)).collect()
        assert {r["path"]: r["is_update"] for r in net} == {"a": True, "b": False}


def test_same_batch_twice_counts_once(spark):
    index = new_index(spark)
    feed, docs = feed_of(spark, FEED), docs_of(spark, NEW)
    assert index.commit(feed, docs, token="feed:0") is not None
    before = inverted(index.postings())
    assert index.commit(feed, docs, token="feed:0") is None
    assert inverted(index.postings()) == before
    index.commit(feed, docs)
    assert inverted(index.postings()) == before


def test_a_batch_that_died_is_invisible(spark, monkeypatch):
    index = new_index(spark)
    before = inverted(index.postings())
    with monkeypatch.context() as broken:
        broken.setattr(Index, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.commit(feed_of(spark, FEED), docs_of(spark, NEW), token="feed:0")
    assert inverted(index.postings()) == before
    index.commit(feed_of(spark, FEED), docs_of(spark, NEW), token="feed:0")
    same_as_rebuilt(spark, index, AFTER)


def test_commit_of_one_volume(spark):
    index = new_index(spark)
    feed = feed_of(spark, [("v1", "removed", "removed"), ("v2", "same", "removed")])
    only = spark.createDataFrame([("v2",)], "volume STRING")
    index.commit(feed, docs_of(spark, NEW), volumes=only)
    assert set(listed(index)) == set(OLD) - {("v2", "same")}


def test_reindex(spark):
    index = new_index(spark)
    index.commit(feed_of(spark, FEED), docs_of(spark, NEW))
    one = spark.createDataFrame([("v1",)], "volume STRING")
    index.reindex(docs_of(spark, {("v1", "x"): "alpha", ("v2", "y"): "not asked for"}), one)
    expected = {("v1", "x"): "alpha", ("v2", "same"): "alpha"}
    same_as_rebuilt(spark, index, expected)
    index.commit(feed_of(spark, [("v1", "new", "created")]), docs_of(spark, NEW))
    same_as_rebuilt(spark, index, {**expected, ("v1", "new"): "fresh alpha"})
    index.reindex(docs_of(spark, OLD))
    assert index.view().terms is not None
    same_as_rebuilt(spark, index, OLD)
    index.reindex(docs_of(spark, {("v1", "x"): "alpha"}))
    assert set(listed(index)) == {("v1", "x")}


def test_bootstrap_only_builds_what_is_missing(spark):
    index = Index(spark, scratch_path(spark, "index"), buckets=2)
    assert not index.exists() and index.doc_list().count() == 0
    index.build(docs_of(spark, {("v1", "kept"): "old"}))
    volumes = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "volume STRING")
    corpus = docs_of(spark, {("v1", "ignored"): "x", ("v2", "taken"): "y"})
    assert index.bootstrap(corpus, volumes) is not None
    assert set(listed(index)) == {("v1", "kept"), ("v2", "taken")}
    assert index.bootstrap(corpus, volumes) is None
    # The volume without documents has an index too, and follows changes.
    index.commit(feed_of(spark, [("v3", "first", "created")]),
                 docs_of(spark, {("v3", "first"): "z"}))
    assert ("v3", "first") in listed(index)


def test_exclude_volume(spark):
    index = new_index(spark)
    session_only = index.view().volumes(spark.createDataFrame([("v2",)], "volume STRING"))
    assert {r["volume"] for r in session_only.doc_list.collect()} == {"v2"}
    index.exclude_volume(spark.createDataFrame([("v1",)], "volume STRING"))
    assert set(listed(index)) == {("v2", "same")}
    index.commit(feed_of(spark, [("v1", "new", "created")]), docs_of(spark, NEW))
    index.reindex(docs_of(spark, NEW))
    assert {v for v, _ in listed(index)} == {"v2"}
    assert {r["volume"] for r in index.view().sizes.collect()} == {"v2"}


def test_files_are_sorted_by_term(spark):
    index = new_index(spark, {("v", str(i)): f"w{i % 50} w{i % 7} common" for i in range(300)})
    rows = spark.read.parquet(f"{index.root}/postings").select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "term")
    for _, group in itertools.groupby(rows.orderBy("file", "at").collect(), lambda r: r["file"]):
        terms = [r["term"] for r in group]
        assert terms == sorted(terms)


def test_changes_since(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")],
                                 "seq BIGINT, ts STRING").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    assert [r["seq"] for r in changes_since(rows, "2024-01-01 00:00:00").collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    """Three files, three micro-batches; then a restart that finds one more file."""
    folder = tmp_path / "feed"
    steps = [FEED[:5], FEED[5:10], FEED[10:], [("v1", "still", "removed")]]

    def arrive(batch):
        feed_of(spark, steps[batch], batch).coalesce(1).write.mode("append").parquet(str(folder))

    index, commits = new_index(spark), []
    checkpoint = scratch_path(spark, "checkpoint")

    def follow():
        before = len(index._log())
        stream = follow_table(spark, str(folder), CHANGE, files_per_batch=1)
        drain_batches(index, stream, lambda: docs_of(spark, NEW), checkpoint,
                      available_now=True).awaitTermination()
        commits.append(len(index._log()) - before)

    for batch in range(3):
        arrive(batch)
    follow()
    follow()
    arrive(3)
    follow()
    assert commits == [3, 0, 1]
    batch_index = new_index(spark)
    batch_index.commit(spark.read.schema(CHANGE).parquet(str(folder)), docs_of(spark, NEW))
    assert inverted(index.postings()) == inverted(batch_index.postings())
    assert ("v1", "still") not in listed(index) and ("v1", "new") in listed(index)


def test_files_are_followed(spark, tmp_path):
    """Raw files: what is there is indexed first, then what arrives."""
    root = tmp_path / "volume"
    (root / "sub").mkdir(parents=True)
    (root / "first.txt").write_text("alpha beta")
    index = Index(spark, scratch_path(spark, "index"), buckets=2)
    volume = spark.createDataFrame([("v1",)], "volume STRING")
    index.build(read_files(spark, str(root), "v1").filter(F.lit(False)), volume)
    checkpoint = scratch_path(spark, "checkpoint")

    def follow():
        created = follow_files(spark, str(root), "v1")
        drain_batches(
            index, created, lambda: scan_volume(read_files(spark, str(root), "v1")), checkpoint,
            available_now=True, prepare=lambda rows: scan_volume(rows).select(
                "volume", "path", F.lit("created").alias("op"), F.lit(0).alias("batch"))
        ).awaitTermination()

    follow()
    assert listed(index) == {("v1", "/first.txt"): 2}
    (root / "sub" / "second.txt").write_text("gamma")
    follow()
    assert listed(index) == {("v1", "/first.txt"): 2, ("v1", "/sub/second.txt"): 1}


def test_another_stream_is_not_taken_for_a_seen_one(spark, tmp_path):
    """The same name and epoch, but another checkpoint: the batch counts."""
    index = new_index(spark)

    def follow(rows, folder):
        feed_of(spark, rows, 0).coalesce(1).write.parquet(str(tmp_path / folder))
        stream = follow_table(spark, str(tmp_path / folder), CHANGE)
        drain_batches(index, stream, lambda: docs_of(spark, NEW),
                      scratch_path(spark, "checkpoint"), available_now=True).awaitTermination()

    follow(FEED, "one")
    assert ("v1", "still") in listed(index)
    follow([("v1", "still", "removed")], "two")
    assert ("v1", "still") not in listed(index)


def test_unnamed_volumes_and_double_paths(spark):
    rows = [("v", "a", "one"), ("v", "a", "two"), ("v", "b", "three"), ("", "c", "four"),
            (None, "d", "five"), ("v", None, "six")]
    docs = spark.createDataFrame(rows, "volume STRING, path STRING, contents STRING")
    index = Index(spark, scratch_path(spark, "index"), buckets=2)
    index.build(docs)
    assert index.doc_list().count() == 2 and set(listed(index)) == {("v", "a"), ("v", "b")}
    assert [r["n_docs"] for r in index.view().sizes.collect()] == [2]
    assert {r["term"] for r in index.postings().collect()} == {"two", "three"}


def test_a_retry_leaves_nothing_of_a_lost_attempt(spark, monkeypatch):
    """Also where the session overwrites only the partitions it writes."""
    monkeypatch.setattr(Index, "_publish", lambda *a, **b: (_ for _ in ()).throw(OSError()))
    index = Index(spark, scratch_path(spark, "index"), buckets=2)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        with pytest.raises(OSError):
            index.build(docs_of(spark, {("v1", "a"): "x", ("v2", "b"): "y"}))
        monkeypatch.undo()
        index.build(docs_of(spark, {("v1", "a"): "x"}))
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert set(listed(index)) == {("v1", "a")}
