"""Matching clauses against an index view, and combining the matches into hits.

Every ``match_*`` function returns *matches*: (query_id, group_id, volume, path, must,
should, must_not, weight), where the three counts say how many clauses of each kind the
row stands for and ``weight`` is their share of the score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import term_bucket
from ..plans.index import IndexView
from ..session import (
    Size, broadcast_within, by_document, measured, size_columns, small_side, written)
from .clauses import (EXPANDED, POSITIONAL, anchor_mark, clause_anchors, expand_patterns,
                      with_anchors, with_pattern)

MATCH_COLUMNS = ["query_id", "group_id", "volume", "path",
                 "must", "should", "must_not", "weight"]
OCCURS = ("must", "should", "must_not")
# Pairs of queries and documents whose sums a task keeps; where they are more in all, term
# matches are summed where their document is.
SUMS_IN_A_TASK = 1_000_000


def _idf(n_docs: Column, df: Column) -> Column:
    return F.lit(1.0) + F.log(n_docs / (df + 1))


def _occur_counts() -> list[Column]:
    return [F.when(F.col("occur") == o, 1).otherwise(0).cast("bigint").alias(o)
            for o in OCCURS]


@dataclass(frozen=True)
class ClauseBounds:
    """Upper bounds for the clause side of a search, from one look at the clauses."""

    kinds: frozenset[str]
    occurs: frozenset[str]
    clauses: Size   # also bounds what is grouped or filtered from the clauses
    slots: Size     # the clauses, once for every term in them
    anchors: Size   # the clauses, once for every anchor they have
    marks: frozenset[str]   # the kinds of anchors
    one_each: bool  # no query has a second clause, so nothing is to be summed
    queries: int


def clause_bounds(clauses: DataFrame) -> ClauseBounds:
    terms = F.greatest(F.size("terms"), F.lit(1))
    anchors = F.when(F.col("kind").isin(*EXPANDED), clause_anchors()).otherwise(
        F.array().cast("array<string>"))
    # A mark is the first letter of an anchor; segments carry their number of edits with it.
    marks = F.array_distinct(F.transform(anchors, anchor_mark))
    n_anchors = F.size(anchors)
    # The sets hold kinds, occurs and marks, of which there are a handful.
    (rows, size, all_terms, all_anchors, most_terms, most_anchors,
     kinds, occurs, marks, most_clauses, queries) = clauses.agg(
        *size_columns(clauses), *[F.coalesce(total, F.lit(0)) for total in (
            F.sum(terms), F.sum(n_anchors), F.max(terms), F.max(n_anchors))],
        F.collect_set("kind"), F.collect_set("occur"),
        F.flatten(F.collect_set(marks)), F.max("n_clauses"),
        F.coalesce(F.sum(1 / F.col("n_clauses")), F.lit(0.0))).first()
    return ClauseBounds(frozenset(kinds), frozenset(occurs), Size(rows, size),
                        Size(all_terms, size * most_terms),
                        Size(all_anchors, size * most_anchors), frozenset(marks),
                        most_clauses == 1, round(queries))


def summed_at_documents(view: IndexView, bounds: ClauseBounds) -> bool:
    """Whether the postings found go to their document before they meet the queries, and not
    the matches: where there is something to sum, and it is not little."""
    return ("term" in bounds.kinds and not bounds.one_each and bounds.clauses.fits()
            and bounds.queries * view.n_docs > SUMS_IN_A_TASK)


def _term_statistics(view: IndexView, wanted: DataFrame, size: Size,
                     shared: bool) -> DataFrame:
    """(volume, term, idf), or (term, idf) when all volumes share their statistics."""
    df = view.frequencies(wanted.select("term").distinct(), size)
    if shared:
        return df.groupBy("term").agg(F.sum("df").alias("df")).select(
            "term", _idf(F.lit(view.n_docs), F.col("df")).alias("idf"))
    return df.join(view.volume_sizes(), "volume").select(
        "volume", "term", _idf(F.col("n_docs"), F.col("df")).alias("idf"))


def _postings_of(view: IndexView, wanted: DataFrame, size: Size, columns: list[str],
                 shared: bool) -> DataFrame:
    """Postings of the wanted terms, with the wanted rows' columns and ``idf``.

    The bucket is part of the join key: a broadcast query side then prunes the postings
    directories by volume and bucket before anything is read.
    """
    statistics = _term_statistics(view, wanted, size, shared)
    lookup = statistics.join(broadcast_within(wanted, size), "term").withColumn(
        "bucket", term_bucket(F.col("term"), view.buckets))
    # A wanted row meets each volume once at most.
    lookup_size = size if shared else size.times(view.extent)
    lookup = broadcast_within(lookup, lookup_size)
    if size.fits() and not lookup_size.fits():
        # Both sides are shuffled: drop the postings of all other terms before.
        view = view.only_terms(wanted)
    keys = ["bucket", "term"] if shared else ["bucket", "volume", "term"]
    return view.find(lookup, keys, columns)


def match_terms(view: IndexView, clauses: DataFrame, bounds: ClauseBounds,
                shared: bool = False, at_documents: bool = False) -> DataFrame:
    """Term clauses. Clauses of one query on the same term are counted together first:
    they match the same documents.

    A term that many queries ask for gives a match for each of them and each document.
    ``at_documents`` looks every distinct term up once and shuffles the postings found, by
    document; they become matches there, and sums by query and document stay there."""
    scored = F.when(F.col("occur") != "must_not", F.col("boost")).otherwise(0.0)
    wanted = (
        clauses.filter(F.col("kind") == "term")
        .select("query_id", "group_id", F.get("terms", F.lit(0))["term"].alias("term"),
                *_occur_counts(), scored.alias("boost"))
        .groupBy("query_id", "group_id", "term")
        .agg(*[F.sum(c).alias(c) for c in (*OCCURS, "boost")]))
    if at_documents:
        share = F.sqrt("tf") * F.col("idf") * F.col("idf") / F.sqrt("dl")
        found = _postings_of(
            view, wanted.select("term").distinct(), bounds.clauses, ["tf", "dl"], shared).select(
            "volume", "path", "term", share.alias("share"))
        weight = F.col("boost") * F.col("share")
        matched = by_document(found, bounds.queries * view.n_docs, SUMS_IN_A_TASK).join(
            F.broadcast(wanted), "term")
    else:
        weight = F.col("boost") * F.sqrt("tf") * F.col("idf") * F.col("idf") / F.sqrt("dl")
        matched = _postings_of(view, wanted, bounds.clauses, ["tf", "dl"], shared)
    return matched.select(
        "query_id", "group_id", "volume", "path", *OCCURS, weight.alias("weight"))


def _phrase_count(slots: Column) -> Column:
    """Number of places where all slots stand at their offsets: shift every position
    list back by its offset and intersect."""
    first = F.get(slots, F.lit(0))

    def shifted(slot):
        return F.transform(slot["positions"], lambda p: p - slot["offset"])

    return F.size(F.reduce(slots, shifted(first),
                           lambda acc, slot: F.array_intersect(acc, shifted(slot))))


NOWHERE = -(1 << 40)


def _window_count(slots: Column, slop: Column) -> Column:
    """Number of positions where a window ends that holds all slots, in any order, with
    at most ``slop`` other tokens in it. One pass over the merged positions, keeping the
    last position of every slot."""
    merged = F.sort_array(F.flatten(F.transform(slots, lambda slot: F.transform(
        slot["positions"], lambda p: F.struct(
            p.cast("bigint").alias("pos"), slot["offset"].alias("slot"))))))
    start = F.struct(
        F.array_repeat(F.lit(NOWHERE).cast("bigint"), F.size(slots)).alias("last"),
        F.lit(0).cast("bigint").alias("n"))

    def step(acc, token):
        last = F.transform(acc["last"], lambda pos, i: F.when(
            i == token["slot"], token["pos"]).otherwise(pos))
        between = token["pos"] - F.array_min(last) - F.size(slots) + 1
        return F.struct(last.alias("last"),
                        (acc["n"] + F.when(between <= slop, 1).otherwise(0)).alias("n"))

    return F.reduce(merged, start, step)["n"]


def match_positional(view: IndexView, clauses: DataFrame, bounds: ClauseBounds,
                     shared: bool = False) -> DataFrame:
    """Phrase and proximity clauses. The documents that hold the rarest term of a clause come
    first, then those of them that hold all; only their positions are read. One shuffle brings
    their lists together, and the rest happens in a row."""
    asked = clauses.filter(F.col("kind").isin(*POSITIONAL))
    first_pos = F.get("terms", F.lit(0))["pos"]
    in_phrase = F.transform("terms", lambda t: F.struct(
        t["term"].alias("term"), (t["pos"] - first_pos).alias("offset")))
    distinct = F.array_distinct(F.transform("terms", lambda t: t["term"]))
    in_window = F.transform(distinct, lambda t, i: F.struct(
        t.alias("term"), i.alias("offset")))
    slots = F.when(F.col("kind") == "phrase", in_phrase).otherwise(in_window)
    wanted = asked.withColumn("slots", slots).select(
        "clause_key", F.inline("slots"))
    place = ["clause_key", "volume", "path"]
    key = ["bucket", "volume", "term", "path"]
    bucket = term_bucket(F.col("term"), view.buckets)
    words = wanted.select("clause_key", "term").distinct()
    n_words = words.groupBy("clause_key").agg(F.count(F.lit(1)).alias("n_words"))
    # Any term of the clause would do; a clause with a term that nobody has fails at the count.
    counted = view.frequencies(wanted.select("term").distinct(), bounds.slots).groupBy("term").agg(
        F.sum("df").alias("df"))
    rarest = words.join(counted, "term").groupBy("clause_key").agg(
        F.min_by("term", F.struct("df", "term")).alias("term")).withColumn("bucket", bucket)
    some = written(view.find(broadcast_within(rarest, bounds.clauses), ["bucket", "term"], [])
                   .select(*place).distinct())
    asked_of = small_side(some.join(broadcast_within(words, bounds.slots), "clause_key")
                          .withColumn("bucket", bucket))
    full = written(view.find(asked_of, key, []).groupBy(*place).agg(
        F.count(F.lit(1)).alias("n")).join(broadcast_within(n_words, bounds.clauses), "clause_key")
        .filter("n = n_words").select(*place))
    statistics = broadcast_within(
        _term_statistics(view, wanted, bounds.slots, shared),
        bounds.slots if shared else bounds.slots.times(view.extent))
    lookup = small_side(written(
        full.join(broadcast_within(wanted, bounds.slots), "clause_key")
        .join(statistics, ["term"] if shared else ["volume", "term"]).withColumn("bucket", bucket)))
    clause = asked.select("clause_key", "query_id", "group_id", "kind", "occur", "boost", "slop")
    together = (
        view.find(lookup, key, ["dl", "positions"])
        .groupBy(*place)
        .agg(F.collect_list(F.struct("offset", "positions")).alias("slots"),
             F.sum("idf").alias("idf"), F.max("dl").alias("dl"))
        .join(broadcast_within(clause, bounds.clauses), "clause_key"))
    found = F.when(F.col("kind") == "phrase", _phrase_count(F.col("slots"))).otherwise(
        _window_count(F.col("slots"), F.col("slop")))
    weight = F.when(F.col("occur") == "must_not", 0.0).otherwise(
        F.col("boost") * F.sqrt("tf") * F.col("idf") * F.col("idf") / F.sqrt("dl"))
    return together.withColumn("tf", found).filter("tf > 0").select(
        "query_id", "group_id", "volume", "path", *_occur_counts(), weight.alias("weight"))


def match_expanded(view: IndexView, clauses: DataFrame, bounds: ClauseBounds) -> DataFrame:
    """Prefix, wildcard, fuzzy and range clauses: expanded over the dictionary, then
    looked up, each distinct pattern once. A match scores its boost, however many of the
    terms a document has.

    Terms that match the same patterns are one *family*. A posting is looked up once, for the
    family of its term, and goes to its document as that; there the families turn into
    patterns, and these into clauses. Pairs of patterns and postings are never shuffled, and
    pairs of queries and documents come to be where their document is."""
    patterns = with_pattern(clauses).withColumn(
        "pattern", F.min("clause_key").over(Window.partitionBy("pattern")))
    asked = broadcast_within(with_anchors(patterns), bounds.anchors)
    # Of unknown size: written once, then measured.
    terms = written(expand_patterns(asked, view.dictionary, bounds.marks).groupBy("term").agg(
        F.sort_array(F.collect_set("pattern")).alias("patterns")))
    families = small_side(written(terms.select("patterns").distinct().withColumn(
        "family", F.monotonically_increasing_id())))
    size = measured(terms.select("term", F.lit(0).alias("bucket"), F.lit(1 << 40).alias("family")))
    lookup = terms.join(families, "patterns").select(
        "term", term_bucket(F.col("term"), view.buckets).alias("bucket"), "family")
    # The postings are not sorted for the join where the terms are too many for a broadcast.
    lookup = broadcast_within(lookup, size) if size.fits() else lookup.hint("shuffle_hash")
    found = view.find(lookup, ["bucket", "term"], []).select("family", "volume", "path")
    matched = (
        by_document(found, view.n_docs * bounds.clauses.rows)
        .join(families, "family").groupBy("volume", "path")
        .agg(F.array_distinct(F.flatten(F.collect_list("patterns"))).alias("patterns"))
        .select("volume", "path", F.explode("patterns").alias("pattern")))
    weight = F.when(F.col("occur") == "must_not", 0.0).otherwise(F.col("boost"))
    askers = patterns.select(
        "pattern", "query_id", "group_id", *_occur_counts(), weight.alias("weight"))
    return matched.join(broadcast_within(askers, bounds.clauses), "pattern").select(*MATCH_COLUMNS)


def match_paths(view: IndexView, clauses: DataFrame, bounds: ClauseBounds,
                shared: bool = False) -> DataFrame:
    """Clauses on the path: the whole value, case-sensitive. As a field of one token that
    one document of a volume has, it scores with tf = dl = df = 1."""
    asked = clauses.filter(F.col("kind") == "path").select(
        "query_id", "group_id", "occur", "boost", F.col("text").alias("path"))
    found = view.doc_list.select("volume", "path").join(
        broadcast_within(asked, bounds.clauses), "path")
    if shared:
        same = found.groupBy("path").agg(F.countDistinct("volume").alias("df"))
        found = found.join(same, "path").withColumn("n_docs", F.lit(view.n_docs))
    else:
        found = found.withColumn("df", F.lit(1)).join(view.volume_sizes(), "volume")
    idf = _idf(F.col("n_docs"), F.col("df"))
    weight = F.when(F.col("occur") == "must_not", 0.0).otherwise(F.col("boost") * idf * idf)
    return found.select("query_id", "group_id", "volume", "path", *_occur_counts(),
                        weight.alias("weight"))


def _keep_matching(rows: DataFrame, shape: DataFrame, bounds: ClauseBounds,
                   keys: list[str]) -> DataFrame:
    """Required clauses all there, prohibited ones absent, and one optional clause at
    least where nothing is required. The score is scaled by the share of clauses met."""
    met = F.col("must") + F.col("should")
    return (
        rows.join(broadcast_within(shape, bounds.clauses), keys)
        .filter((F.col("must") == F.col("n_must")) & (F.col("must_not") == 0)
                & ((F.col("n_must") > 0) | (F.col("should") > 0)))
        .withColumn("score", met / F.col("n_scored") * F.col("weight")))


def _shape(keys: list[str], clauses: DataFrame) -> DataFrame:
    return clauses.groupBy(*keys).agg(
        F.count_if(F.col("occur") == "must").alias("n_must"),
        F.count_if(F.col("occur") != "must_not").alias("n_scored"))


def _summed(rows: DataFrame, keys: list[str], occurs: frozenset[str], one_each: bool) -> DataFrame:
    """Counts and weights per key; what cannot occur is not carried along. With one clause
    for each query every row has a key of its own."""
    if one_each:
        return rows.select(*keys, *OCCURS, "weight")
    return rows.groupBy(*keys).agg(*[
        (F.sum(c) if c in occurs or c == "weight" else F.lit(0)).alias(c)
        for c in (*OCCURS, "weight")])


def combine(matches: DataFrame, clauses: DataFrame, bounds: ClauseBounds,
            grouped: bool = False, at_documents: bool = False) -> DataFrame:
    """Hits (query_id, volume, path, score) from the matches of all clauses. With groups,
    the same rule holds inside each group and again over the groups. Matches that are
    ``at_documents`` are not shuffled again."""
    inner = ["query_id", "group_id"] if grouped else ["query_id"]
    if grouped and not bounds.one_each and not at_documents:
        # Groups are summed where their document is: one shuffle for both sums.
        matches = matches.repartition("query_id", "volume", "path")
    rows = _keep_matching(_summed(matches, [*inner, "volume", "path"], bounds.occurs, bounds.one_each),
                          _shape(inner, clauses), bounds, inner)
    if grouped:
        groups = clauses.groupBy(*inner).agg(F.min("group_occur").alias("occur"))
        outer = rows.select(*inner, "volume", "path", "score").join(
            broadcast_within(groups, bounds.clauses), inner)
        weight = F.when(F.col("occur") == "must_not", 0.0).otherwise(F.col("score"))
        outer = outer.select("query_id", "volume", "path", *_occur_counts(),
                             weight.alias("weight"))
        rows = _keep_matching(
            _summed(outer, ["query_id", "volume", "path"], frozenset(OCCURS), bounds.one_each),
            _shape(["query_id"], groups), bounds, ["query_id"])
    return rows.select("query_id", "volume", "path", F.round("score", 6).alias("score"))
