"""The plans are what they are meant to be: what is shuffled, pruned and pushed down."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import inputs, spark_queries
from shelfmark import search
from shelfmark.operators import changes, results
from shelfmark.operators.postings import build_postings
from shelfmark.sources.corpus import documents_by_key
from shelfmark.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def lines(frame, word):
    return [line for line in plan_of(frame).splitlines() if word in line]


@pytest.fixture(scope="module")
def view(spark):
    return inputs.corpus_index(spark, FOLDER).view()


@pytest.fixture(scope="module")
def hits(spark, view):
    clauses = inputs.query_tokens(spark, FOLDER).select("query_id", F.col("term").alias("text"))
    return search(view, clauses)


def test_no_nested_loops(spark):
    for name in ("search_any", "search_phrase", "search_wildcard", "search_fuzzy",
                 "search_range", "search_field", "merged_ranking", "not_excluded",
                 "admit_updates_only", "net_changes", "late_bound_content"):
        plan = plan_of(spark_queries.REGISTRY[name](spark, FOLDER))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_term_search_prunes_and_shuffles_once(hits):
    scan = next(line for line in lines(hits, "FileScan") if "/postings" in line)
    assert re.search(r"dynamicpruningexpression\(bucket", scan)
    assert re.search(r"dynamicpruningexpression\(volume", scan)
    assert "positions" not in scan.split("ReadSchema")[1]
    # Rows found are shuffled once, by query and document.
    assert len(lines(hits, "Exchange hashpartitioning(query_id#")) - len(
        [line for line in lines(hits, "Exchange hashpartitioning(query_id#")
         if "path#" not in line]) == 1


def test_many_sums_shuffle_postings_by_document_only(spark, view, monkeypatch):
    monkeypatch.setattr("shelfmark.operators.matching.SUMS_IN_A_TASK", 10)
    tokens = inputs.query_tokens(spark, FOLDER).select("query_id", F.col("term").alias("text"))
    for clauses in (tokens, tokens.withColumn("group_id", F.length("text") % 2)):
        by_path = [line for line in lines(search(view, clauses), "Exchange hashpartitioning(")
                   if "path#" in line]
        assert len(by_path) == 1 and "Exchange hashpartitioning(volume#" in by_path[0]


def test_top_k_limits_before_the_shuffle(hits):
    top = lines(results.top_k(hits, 5), "WindowGroupLimit")
    assert any("Partial" in line for line in top) and any("Final" in line for line in top)


def test_building_postings_shuffles_nothing(spark):
    docs = inputs.documents_corpus(read_table(spark, FOLDER, "documents"))
    assert "Exchange" not in plan_of(build_postings(docs))


def test_change_filter_reaches_the_file(spark):
    plan = plan_of(spark_queries.REGISTRY["changes_since"](spark, FOLDER))
    scan = next(line for line in plan.splitlines() if "events.parquet" in line)
    assert "GreaterThan(ts" in scan and "props" not in scan


def test_liveness_is_checked_after_the_lookup(spark):
    index = inputs.new_index(spark, "plans")
    index.build(inputs.documents(spark, FOLDER))
    index.commit(inputs.changes(spark, FOLDER), inputs.current_reader(spark, FOLDER))
    view = index.view()
    terms = spark.createDataFrame([("er",)], "term STRING").withColumn("bucket", F.lit(0))
    plan = view.find(F.broadcast(terms), ["bucket", "term"], ["tf"])
    depth = {"term": [], "path": []}
    for line in lines(plan, "Join ["):
        for key in depth:
            if re.search(rf"Join \[[^\]]*{key}#", line):
                depth[key].append(line.index("Join"))
    assert min(depth["path"]) < min(depth["term"])


def test_keys_of_a_batch_reach_the_documents(spark):
    net = spark.createDataFrame(
        [("src1", "1", True), ("src1", "21", True), ("src2", "1", True), ("src2", "2", False),
         ("src2", None, True), ("src2", "no number", True)],
        "volume STRING, path STRING, is_update BOOLEAN")
    found = changes.late_bound_content(net, documents_by_key(read_table(spark, FOLDER, "documents")))
    assert {(r["volume"], r["path"]) for r in found.collect()} == {("src1", "1"), ("src1", "21")}
    scan = next(line for line in plan_of(found).splitlines() if "documents.parquet" in line)
    assert "GreaterThanOrEqual(doc_id,1)" in scan and "LessThanOrEqual(doc_id,21)" in scan


def test_dictionary_is_pruned_by_bucket(hits):
    scan = next(line for line in lines(hits, "FileScan") if "/terms" in line)
    assert re.search(r"dynamicpruningexpression\(bucket", scan)
