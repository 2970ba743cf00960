"""Query clauses: analysis, and the expansion of patterns over the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.analysis import positioned
from ..session import written

# Clause kinds by what they read.
POSITIONAL = ("phrase", "proximity")
EXPANDED = ("prefix", "wildcard", "fuzzy", "range", "range_exclusive")


def with_defaults(clauses: DataFrame) -> DataFrame:
    """All clause columns; what is missing or null takes its default."""
    defaults = {
        "clause_id": F.lit(0), "group_id": F.lit(0), "group_occur": F.lit("must"),
        "occur": F.lit("should"), "kind": F.lit("term"), "field": F.lit("contents"),
        "slop": F.lit(0), "boost": F.lit(1.0)}
    columns = []
    for name, data_type in (column.split(" ") for column in schemas.CLAUSES.split(", ")):
        given = F.col(name) if name in clauses.columns else F.lit(None)
        if name in defaults:
            given = F.coalesce(given, defaults[name])
        columns.append(given.cast(data_type).alias(name))
    return clauses.select(*columns)


def clauses_from_text(queries: DataFrame, occur: str = "should") -> DataFrame:
    """(query_id, text) to one term clause per token: any of them by default."""
    return queries.select(
        "query_id", F.inline(positioned(F.col("text")))).select(
        "query_id", F.col("pos").alias("clause_id"), F.lit(occur).alias("occur"),
        F.lit("term").alias("kind"), F.lit("contents").alias("field"),
        F.col("term").alias("text"))


def analyze_clauses(clauses: DataFrame) -> DataFrame:
    """Clauses with their ``terms`` (array of term and pos). The query text goes through
    the analysis of the documents. A clause without anything to look for vanishes: it
    neither matches nor counts. A term clause of several tokens is a phrase. Every clause gets
    a ``clause_key`` of its own, whatever ids were given; write the result before using it."""
    clauses = with_defaults(clauses)
    on_path = F.col("field") == "path"
    analyzed = ~on_path & F.col("kind").isin("term", *POSITIONAL)
    terms = F.when(analyzed, positioned(F.col("text")))
    several = (F.col("kind") == "term") & (F.size("terms") > 1)
    single = F.col("kind").isin(*POSITIONAL) & (F.size("terms") == 1)
    kind = (F.when(on_path, "path").when(several, "phrase").when(single, "term")
            .otherwise(F.col("kind")))
    text = F.when(F.col("kind").isin(*EXPANDED), F.lower("text")).otherwise(F.col("text"))
    usable = (
        F.when(F.col("kind").isin("range", "range_exclusive"),
               F.col("text").isNotNull() | F.col("text2").isNotNull())
        .when(F.col("kind").isin("term", *POSITIONAL), F.size("terms") > 0)
        .otherwise(F.length("text") > 0))
    return (clauses.withColumn("terms", terms)
            .withColumns({"kind": kind, "text": text, "text2": F.lower("text2")})
            .filter(usable).withColumn("clause_key", F.monotonically_increasing_id()))


def one_of_equal(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that say the same have the same hits, so one of each such set is searched: its
    clauses with ``n_clauses`` of the query, and (asked, query_id), which query stands for
    which. A query is its clauses in any order; a clause without a query has no hits."""
    own = ("query_id", "clause_id", "clause_key")
    said = F.to_json(F.struct(*[F.col(c) for c in clauses.columns if c not in own]))
    queries = clauses.filter("query_id IS NOT NULL").groupBy("query_id").agg(
        F.sort_array(F.collect_list(said)).alias("said"))
    same = written(queries.select(
        "query_id", F.size("said").alias("n_clauses"),
        F.min("query_id").over(Window.partitionBy("said")).alias("asked")))
    first = same.filter("query_id = asked").select("query_id", "n_clauses")
    return written(clauses.join(first, "query_id")), same.select("asked", "query_id")


# ---- dictionary expansion --------------------------------------------------------------
#
# A pattern is matched against the dictionary by an equality join on anchors, then
# checked. An anchor is a small fact that every term matching the pattern shares with it:
#   ^xyz begins with xyz       ~xy  contains xy         @n  first letter is in page n
#   &x?z|a?c  first letters under a mask
#   $xy  ends with xy          %k|n|i|s  segment i of an n-letter term, for k edits
#   *    no fact known
# Each clause takes the most telling anchors it has; terms carry all of theirs.


def _first(text: Column) -> Column:
    return F.array(*[F.concat(F.lit("^"), F.left(text, F.lit(n))) for n in (1, 2, 3)])


def _last(text: Column) -> Column:
    return F.array(*[F.concat(F.lit("$"), F.right(text, F.lit(n))) for n in (1, 2)])


def _page(text: Column) -> Column:
    """A coarse, order-preserving number of the first letter."""
    code = F.ascii(text)
    return F.when(code < 256, code).otherwise(F.lit(256) + F.shiftright(code, 8))


def _grams(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(text))
    return F.flatten(F.transform(starts, lambda i: F.transform(
        F.array(F.lit(1), F.lit(2)),
        lambda n: F.concat(F.lit("~"), F.substring(text, i, n)))))


def term_anchors(term: Column, marks: frozenset[str]) -> Column:
    """The anchors of a term, of the marks that some clause asks for."""
    by_mark = {
        "^": _first(term), "$": _last(term), "~": _grams(term), "*": F.array(F.lit("*")),
        "#": F.array(F.concat(F.lit("#"), F.length(term).cast("string"))),
        "@": F.array(F.concat(F.lit("@"), _page(term).cast("string")))}
    parts = [anchors for mark, anchors in by_mark.items() if mark in marks]
    parts += [term_segments(term, int(mark[1:])) for mark in sorted(marks) if mark.startswith("%")]
    parts += [F.when(F.length(term) >= len(mark) - 1, F.array(_masked(term, mark[1:]))).otherwise(
        F.array().cast("array<string>")) for mark in sorted(marks) if mark.startswith("&")]
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *parts))


def _masked(text: Column, mask: str) -> Column:
    """The first letters of a text under a mask: ``x`` keeps a letter, ``?`` hides it."""
    return F.concat(F.lit(f"&{mask}|"), *[
        F.lit("?") if m == "?" else F.substring(text, i, 1) for i, m in enumerate(mask, 1)])


def _mask_anchor(pattern: Column) -> Column:
    """What a wildcard pattern says of the first letters of its terms, with the places it
    tells: ``f?r*`` gives ``&x?x|f?r``. Null where it tells none of them."""
    head = F.regexp_extract(pattern, r"^([^*]{1,3})", 1)
    anchor = F.concat(F.lit("&"), F.regexp_replace(head, r"[^?]", "x"), F.lit("|"), head)
    return F.when(F.regexp_replace(head, r"\?", "") != "", anchor)


def _wildcard_anchor(pattern: Column) -> Column:
    last = F.regexp_extract(pattern, r"([^*?]{1,2})$", 1)
    inner = F.regexp_extract(pattern, r"([^*?]{1,2})", 1)
    return (F.when(last != "", F.concat(F.lit("$"), last))
            .when(inner != "", F.concat(F.lit("~"), inner))
            .otherwise("*"))


def _segment_key(edits: Column, length: Column, number: Column, piece: Column) -> Column:
    return F.concat_ws("|", F.concat(F.lit("%"), edits.cast("string")), length.cast("string"),
                       number.cast("string"), piece)


def _bounds(number: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``number`` of ``edits + 1`` near equal ones."""
    start = F.floor(number * length / (edits + 1))
    return start.cast("int"), (F.floor((number + 1) * length / (edits + 1)) - start).cast("int")


def term_segments(term: Column, edits: int) -> Column:
    """Positional segments of a term for ``edits`` edits: (edits, length, number, piece) of
    each of ``edits + 1`` disjoint segments. A term of ``edits`` letters or fewer has one
    empty key of its length, since no segment need survive."""
    length, k = F.length(term), F.lit(edits)
    def piece(i: Column) -> Column:
        start, size = _bounds(i, length, k)
        return _segment_key(k, length, i, F.substring(term, start + 1, size))

    parts = F.transform(F.sequence(F.lit(0), k), piece)
    return F.when(length > k, parts).otherwise(F.array(_segment_key(k, length, F.lit(-1), F.lit(""))))


def _fuzzy_anchors(text: Column, edits: Column) -> Column:
    """Probes of a pattern: ``edits`` edits leave at least one of the ``edits + 1`` segments
    of a matching term whole, shifted by ``edits`` places at most. So, for every term length
    within ``edits`` of the pattern's, every segment is looked for at the substrings of the
    pattern that start within ``edits`` of its own start."""
    m = F.length(text)

    def of_length(n: Column) -> Column:
        def of_segment(i: Column) -> Column:
            start, size = _bounds(i, n, edits)
            low, high = F.greatest(F.lit(0), start - edits), F.least(m - size, start + edits)
            starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda at: _segment_key(edits, n, i, F.substring(text, at + 1, size)))
        every = F.flatten(F.transform(F.sequence(F.lit(0), edits), of_segment))
        return F.when(n > edits, every).otherwise(F.array(_segment_key(edits, n, F.lit(-1), F.lit(""))))

    lengths = F.sequence(F.greatest(F.lit(1), m - edits), m + edits)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def _range_anchors(low: Column, high: Column) -> Column:
    """Bounds with the same first letters hold only terms that begin with these."""
    first = F.coalesce(_page(low), F.lit(0))
    last = F.coalesce(_page(high), F.lit(256 + (0x10FFFF >> 8)))
    pages = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    by_page = F.transform(F.coalesce(pages, F.array().cast("array<int>")),
                          lambda n: F.concat(F.lit("@"), n.cast("string")))
    def shared(n: int) -> Column:
        return (F.length(low) >= n) & (F.left(low, F.lit(n)) == F.left(high, F.lit(n)))

    begins = F.when(shared(3), 3).when(shared(2), 2).when(shared(1), 1)
    return F.when(begins.isNotNull(), F.array(F.concat(F.lit("^"), F.left(low, begins)))) \
        .otherwise(by_page)


def clause_anchors() -> Column:
    """The anchors of a clause, of which a matching term has at least one."""
    text, slop = F.col("text"), F.col("slop")
    return (F.when(F.col("kind") == "prefix",
                   F.array(F.concat(F.lit("^"), F.left(text, F.lit(3)))))
            .when(F.col("kind") == "wildcard",
                  F.array(F.coalesce(_mask_anchor(text), _wildcard_anchor(text))))
            .when(F.col("kind") == "fuzzy", _fuzzy_anchors(text, slop))
            .otherwise(_range_anchors(text, F.col("text2"))))


def like_pattern(wildcard: Column) -> Column:
    """``?`` and ``*`` as LIKE wildcards; what LIKE would read specially is escaped."""
    escaped = F.regexp_replace(wildcard, r"([\\%_])", r"\\$1")
    return F.translate(escaped, "?*", "_%")


def matches_term(term: Column) -> Column:
    """Whether the clause of this row matches ``term``."""
    text, text2, slop = F.col("text"), F.col("text2"), F.col("slop")
    above = text.isNull() | (term >= text)
    below = text2.isNull() | (term <= text2)
    bounds = (text.isNull() | (term != text)) & (text2.isNull() | (term != text2))
    return (F.when(F.col("kind") == "prefix", term.startswith(text))
            .when(F.col("kind") == "wildcard", F.like(term, like_pattern(text)))
            .when(F.col("kind") == "fuzzy", F.call_function("levenshtein", term, text, slop) >= 0)
            .when(F.col("kind") == "range", above & below)
            .otherwise(above & below & bounds))


PATTERN = ["kind", "text", "text2", "slop"]


def with_pattern(clauses: DataFrame) -> DataFrame:
    """The pattern clauses with ``pattern``, a key that equal patterns share."""
    key = F.to_json(F.struct(*PATTERN))
    return clauses.filter(F.col("kind").isin(*EXPANDED)).withColumn("pattern", key)


def anchored(clauses: DataFrame) -> DataFrame:
    """Every distinct pattern, one row per anchor."""
    return with_anchors(with_pattern(clauses))


def with_anchors(patterns: DataFrame) -> DataFrame:
    """Rows of ``with_pattern``, whatever keys their patterns have: each once per anchor."""
    return patterns.select("pattern", *PATTERN).distinct().withColumn(
        "anchor", F.explode(clause_anchors()))


def anchor_mark(anchor: Column) -> Column:
    """The kind of an anchor: its first letter; segments carry their number of edits and
    masked letters their mask, of which there are 13."""
    return F.regexp_extract(anchor, r"^(%[0-9]+|&[x?]+|.)", 1)


def expand_patterns(asked: DataFrame, dictionary: DataFrame,
                    marks: frozenset[str] | None = None) -> DataFrame:
    """(pattern, term): the dictionary terms that the anchored patterns stand for. The
    marks are those of ``asked``, a handful, unless given. Where ``asked`` is broadcast, the
    pairs stay where their term is."""
    if marks is None:
        marks = frozenset(r[0] for r in asked.select(anchor_mark(F.col("anchor"))).distinct().collect())
    facts = dictionary.select(
        "term", F.explode(term_anchors(F.col("term"), marks)).alias("anchor"))
    found = facts.join(asked, "anchor").filter(matches_term(F.col("term"))).select(
        "pattern", "term")
    # Only fuzzy patterns have several anchors that one term may share.
    return found.distinct() if any(m.startswith("%") for m in marks) else found
