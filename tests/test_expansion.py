"""Pattern searches: what is shuffled, and queries that say the same."""

import pytest
from pyspark.sql import functions as F

from catalog import spark_queries
from shelfmark import Index, schemas, search, view_of
from shelfmark.operators import clauses as clause_ops

FOLDER = "/root/testdata/sf0.001"
CLAUSES = "query_id BIGINT, occur STRING, kind STRING, text STRING"


@pytest.mark.parametrize("name", ["search_prefix", "search_range", "search_wildcard", "search_fuzzy"])
def test_pairs_are_not_shuffled(spark, name):
    """Postings go to their documents once; pairs with patterns or queries stay there."""
    plan = spark_queries.REGISTRY[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "path#" in line]
    assert len(dealt) == 1 and not any("pattern#" in line or "query_id#" in line for line in dealt)


def test_wildcards_are_anchored_on_their_first_letters(spark):
    rows = [("f?r*", "&x?x|f?r"), ("f?*", "&x?|f?"), ("ab", "&xx|ab"), ("??c", "&??x|??c"),
            ("abcd*", "&xxx|abc"), ("日?b", "&x?x|日?b"), ("*ing", "$ng"), ("?*", "*"), ("*a*", "~a")]
    frame = spark.createDataFrame([(i, "should", "wildcard", t) for i, (t, _) in enumerate(rows)], CLAUSES)
    anchors = clause_ops.anchored(clause_ops.analyze_clauses(frame)).select("text", "anchor").collect()
    assert sorted(map(tuple, anchors)) == sorted(rows)
    terms = ["f", "fa", "far", "farm", "ab", "abcde", "xxc", "日xb", "日xbc", "sing", "a", "日"]
    found = clause_ops.expand_patterns(
        clause_ops.anchored(clause_ops.analyze_clauses(frame)),
        spark.createDataFrame([(t,) for t in terms], "term STRING"))
    got = {}
    for r in found.withColumn("text", F.get_json_object("pattern", "$.text")).collect():
        got.setdefault(r["text"], []).append(r["term"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "f?r*": ["far", "farm"], "f?*": ["fa", "far", "farm"], "ab": ["ab"], "??c": ["xxc"],
        "abcd*": ["abcde"], "日?b": ["日xb"], "*ing": ["sing"], "?*": sorted(terms),
        "*a*": ["a", "ab", "abcde", "fa", "far", "farm"]}


def test_equal_queries_are_searched_once(spark):
    """In any order of their clauses; a clause that comes twice counts twice."""
    rows = [(7, "must", "term", "alpha"), (7, "should", "prefix", "be"),
            (3, "should", "prefix", "be"), (3, "must", "term", "alpha"),
            (5, "must", "term", "alpha"), (5, "must", "term", "alpha"), (5, "should", "prefix", "be"),
            (6, "should", "prefix", "be"), (8, "should", "prefix", "be"), (None, "should", "prefix", "be")]
    frame = spark.createDataFrame(rows, CLAUSES)
    clauses, askers = clause_ops.one_of_equal(clause_ops.analyze_clauses(frame))
    assert sorted(map(tuple, askers.collect())) == [(3, 3), (3, 7), (5, 5), (6, 6), (6, 8)]
    assert {r["query_id"]: r["n_clauses"] for r in clauses.collect()} == {3: 2, 5: 3, 6: 1}
    docs = spark.createDataFrame([("v", "a", "alpha beta bee"), ("v", "b", "beta"), ("w", "c", "alpha"),
                                  ("w", "d", "gamma")], "volume STRING, path STRING, contents STRING")
    hits = {}
    for r in search(view_of(docs), frame).collect():
        assert r["path"] not in hits.setdefault(r["query_id"], {})
        hits[r["query_id"]][r["path"]] = r["score"]
    assert set(hits) == {3, 5, 6, 7, 8} and hits[3] == hits[7] and hits[6] == hits[8] == {"a": 1.0, "b": 1.0}
    assert set(hits[3]) == set(hits[5]) == {"a", "c"} and hits[3] != hits[5]


def test_groups_are_summed_after_one_shuffle(spark):
    plan = spark_queries.REGISTRY["search_groups"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "path#" in line]
    assert len(dealt) == 1 and "group_id#" not in dealt[0].split("hashpartitioning")[1]


@pytest.mark.parametrize("name", ["search_phrase", "search_proximity"])
def test_positions_are_read_of_documents_that_hold_all_terms(spark, name):
    """The postings are looked up by document too, not joined with every clause on their term."""
    plan = spark_queries.REGISTRY[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    lookups = [line for line in plan.splitlines() if "HashJoin [bucket#" in line]
    assert lookups and any("path#" in line.split("]")[0] for line in lookups)


def test_a_base_writes_only_tables_that_searches_read(spark, tmp_path):
    """No gram table; new terms of a commit are found all the same."""
    root = tmp_path / "index"
    index = Index(spark, f"file://{root}", buckets=2)
    docs = spark.createDataFrame([("v", "a", "farm"), ("v", "b", "gone")], schemas.DOCS)
    index.build(docs)
    assert {p.name for p in root.iterdir()} == {"postings", "doc_state", "terms", "volume_stats", "commits"}
    now = spark.createDataFrame([("v", "c", "fork forest")], schemas.DOCS)
    changes = spark.createDataFrame([("v", "b", "removed", 1), ("v", "c", "created", 1)],
                                    "volume STRING, path STRING, op STRING, batch BIGINT")
    index.commit(changes, now)
    asked = spark.createDataFrame([(1, "should", "wildcard", "f?r*"), (2, "should", "wildcard", "*ne")], CLAUSES)
    assert {(r["query_id"], r["path"]) for r in search(index.view(), asked).collect()} == {(1, "a"), (1, "c")}
