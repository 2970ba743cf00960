"""From documents (volume, path, contents) to postings and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import inverted, let, positioned
from ..session import small_side, written


def tokenize(docs: DataFrame) -> DataFrame:
    """(volume, path, pos, term) of every token that is not a stop word."""
    return docs.select(
        "volume", "path", F.inline(positioned(F.col("contents")))) \
        .select("volume", "path", "pos", "term")


def build_postings(docs: DataFrame, list_documents: bool = False) -> DataFrame:
    """One row per document and distinct term, made without a shuffle.

    Every row carries the document's length, so scoring needs no join with a document
    table. With ``list_documents`` each document also gets a row with the empty term:
    that one pass over the texts then yields the document list too, with the documents
    that have no tokens.
    """
    entry = inverted(F.col("contents"))
    if list_documents:
        entry = let(entry, lambda found: F.concat(F.array(F.struct(
            F.lit("").alias("term"), F.array().cast("array<int>").alias("positions"),
            F.coalesce(F.get(found, F.lit(0))["dl"], F.lit(0)).alias("dl"))), found))
    return docs.select("volume", "path", F.inline(entry)).select(
        "volume", "term", "path", F.size("positions").alias("tf"), "dl", "positions")


def document_frequencies(postings: DataFrame) -> DataFrame:
    """Documents per volume and term. Postings have one row per document and term, so
    a count is enough."""
    return postings.filter(F.col("term") != "").groupBy("volume", "term").agg(
        F.count(F.lit(1)).alias("df"))


def document_lengths(docs: DataFrame) -> DataFrame:
    """Token count of every document, 0 for those without tokens."""
    return docs.select(
        "volume", "path", F.size(positioned(F.col("contents"))).alias("dl"))


def volume_sizes(doc_list: DataFrame) -> DataFrame:
    """Documents per volume, those without tokens included."""
    return doc_list.groupBy("volume").agg(F.count(F.lit(1)).alias("n_docs"))


def upsert_docs(docs: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace by path: everything with a path of the batch goes, then the batch is
    added, one row per path."""
    return delete_docs(docs, batch).unionByName(
        batch.select(*docs.columns).dropDuplicates(["volume", "path"]))


def delete_docs(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop all rows of the given paths; an unknown path is no error."""
    gone = small_side(written(keys.select("volume", "path").distinct()))
    return docs.join(gone, ["volume", "path"], "left_anti")
