"""Text analysis as column expressions, the same at index time and at query time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# The English stop list.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the "
    "their then there these they this to was will with"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order. Null text has none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def positioned(text: Column) -> Column:
    """``array<struct<term, pos>>`` of the tokens that are not stop words. Positions
    count the stop words, so gaps stay where they were removed."""
    numbered = F.transform(
        tokens(text), lambda token, i: F.struct(token.alias("term"), i.alias("pos")))
    return F.filter(numbered, lambda t: ~t["term"].isin(STOP_WORDS))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inverted(text: Column) -> Column:
    """The inverted form of one text: ``array<struct<term, positions, dl>>``, one
    entry per distinct term.

    A document is one row, so its terms are grouped inside the row: sort the tokens by
    term, find where each run starts, cut the runs. Grouping the exploded tokens would
    give the same, after sending every token through a shuffle.
    """

    def entries(run):
        starts = F.filter(
            F.transform(run, lambda t, i: F.when(
                (i == 0) | (run[i - 1]["term"] != t["term"]), i)),
            lambda i: i.isNotNull())
        return let(starts, lambda start: F.transform(start, lambda first, k: F.struct(
            run[first]["term"].alias("term"),
            F.transform(
                F.sequence(first, F.coalesce(F.get(start, k + 1), F.size(run)) - 1),
                lambda j: run[j]["pos"]).alias("positions"),
            F.size(run).alias("dl"))))

    return let(F.sort_array(positioned(text)), entries)


def term_bucket(term: Column, buckets: int) -> Column:
    """Bucket of a term; the document list (the empty term) has its own, -1."""
    hashed = F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
    return F.when(term == "", F.lit(-1)).otherwise(hashed)
