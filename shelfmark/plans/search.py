"""Whole searches: a table of queries in, a table of hits out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clauses import (
    EXPANDED, POSITIONAL, analyze_clauses, clauses_from_text, one_of_equal)
from ..operators.matching import (
    MATCH_COLUMNS, clause_bounds, combine, match_expanded, match_paths, match_positional,
    match_terms, summed_at_documents)
from ..session import small_side, written
from .index import IndexView


def search(view: IndexView, clauses: DataFrame, shared_statistics: bool = False) -> DataFrame:
    """Hits (query_id, volume, path, score) of a table of clauses, all queries at once.

    See ``schemas.CLAUSES``; columns left out take their defaults. Only the branches for
    clause kinds that occur are planned, and queries that say the same are searched once. With ``shared_statistics`` all volumes are
    scored as one collection.
    """
    grouped = "group_id" in clauses.columns
    # Read many times below, and small next to the index.
    clauses, askers = one_of_equal(written(analyze_clauses(clauses)))
    bounds = clause_bounds(clauses)
    at_documents = summed_at_documents(view, bounds)
    branches = []
    if "term" in bounds.kinds:
        branches.append(match_terms(view, clauses, bounds, shared_statistics, at_documents))
    if bounds.kinds & set(POSITIONAL):
        branches.append(match_positional(view, clauses, bounds, shared_statistics))
    if bounds.kinds & set(EXPANDED):
        branches.append(match_expanded(view, clauses, bounds))
    if "path" in bounds.kinds:
        branches.append(match_paths(view, clauses, bounds, shared_statistics))
    if not branches:
        return _no_hits(clauses)
    matches = branches[0].select(*MATCH_COLUMNS)
    for branch in branches[1:]:
        matches = matches.unionByName(branch.select(*MATCH_COLUMNS))
    hits = combine(matches, clauses, bounds, grouped, at_documents and len(branches) == 1) \
        .withColumnRenamed("query_id", "asked")
    return hits.join(small_side(askers), "asked").select("query_id", "volume", "path", "score")


def search_text(view: IndexView, queries: DataFrame, occur: str = "should",
                shared_statistics: bool = False) -> DataFrame:
    """Hits of (query_id, text): any token of the text, or all with ``occur='must'``."""
    return search(view, clauses_from_text(queries, occur), shared_statistics)


def _no_hits(clauses: DataFrame) -> DataFrame:
    return clauses.filter(F.lit(False)).select(
        "query_id", F.lit("").alias("volume"), F.lit("").alias("path"),
        F.lit(0.0).alias("score"))
