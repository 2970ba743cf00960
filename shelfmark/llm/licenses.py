"""License scans: an exact containment join between license templates and text blocks.

Blocks are the lines of a text. A block matches a template if it holds at least eight tenths
of the template's distinct words. Words are ordered globally by frequency, rare ones first; a
matching block must share a word with the short rare prefix of the template (prefix filter),
hold enough template words at all (length filter), and have enough left behind the shared
word on both sides (positional filter). What passes is verified exactly.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, texts
from shelfmark.session import written

# The phrases of the base labels, and the wording of public license notices.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = [
    ("mit", "under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files"),
    ("apache", "under the Apache License"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License as published by the Free Software "
            "Foundation"),
    ("bsd", "under the BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, "
            "are permitted provided that the following conditions are met"),
    ("mpl", "Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under CC BY-NC"),
    ("cc-by", "Creative Commons Attribution"),
    ("reserved", "All rights reserved"),
]
SHARE = (8, 10)  # of the template's words, as a fraction

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and anything beyond ASCII."""
    return _WORD.findall(text.lower())


def need(size: int) -> int:
    """The least number of shared words for a template of ``size`` distinct words."""
    return -(-size * SHARE[0] // SHARE[1])


def scanned(docs: DataFrame, templates=None) -> DataFrame:
    """(row, doc_id, n_words, n_base, first_word, last_word, base_labels, blocks): per row the
    base places, and for every line with enough template words the sorted numbers of these
    words. Written once, as the row numbers must not change."""
    templates = TEMPLATES if templates is None else templates
    sets = [set(words_of(t.encode())) for _, t in templates]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
    fewest = min((need(len(s)) for s in sets), default=1)
    phrases = [(label, p.encode().split()) for label, p in BASE.items()]
    known = frozenset(vocabulary)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]

    def scan(text: bytes) -> tuple:
        n, places, labels, blocks = 0, [], set(), []
        for line in text.split(b"\n"):
            mine = words_of(line)
            shared = known.intersection(mine)
            if len(shared) >= fewest:
                blocks.append(sorted(vocabulary[w] for w in shared))
            n += len(mine)
        lower = text.lower()
        if b"license" in lower:
            mine = words_of(lower)
            for at, word in enumerate(mine):
                if word == b"license":
                    for label, phrase in phrases:
                        start = at - len(phrase) + 1
                        if start >= 0 and mine[start:at + 1] == phrase:
                            places.append(start)
                            labels.add(label)
        return (n, len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(labels)), blocks)

    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int32()))]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan(t) for t in texts(batch)]
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(map_batches(
        docs.select("doc_id", "text"), f"doc_id {kind}, n_words bigint, n_base bigint, "
        "first_word bigint, last_word bigint, base_labels string, blocks array<array<int>>",
        work).withColumn("row", F.monotonically_increasing_id()))


def matches(scan: DataFrame, templates=None) -> DataFrame:
    """(row, label, containment) for every block of ``scan`` that meets a template."""
    spark = scan.sparkSession
    templates = TEMPLATES if templates is None else templates
    sets = [set(words_of(t.encode())) for _, t in templates]
    vocabulary = sorted(set().union(*sets))
    blocks = scan.select("row", F.explode("blocks").alias("block"))
    # One number for each template word, so this is as small as the templates are.
    frequency = dict(blocks.select(F.explode("block").alias("w")).groupBy("w").count().collect())
    order = sorted(range(len(vocabulary)), key=lambda w: (frequency.get(w, 0), w))
    rank = {w: r for r, w in enumerate(order)}
    number = {w: i for i, w in enumerate(vocabulary)}
    prefixes = []
    for (label, _), words in zip(templates, sets):
        ranked = sorted(rank[number[w]] for w in words)
        least = need(len(ranked))
        prefixes += [(r, label, at, least, ranked)
                     for at, r in enumerate(ranked[:len(ranked) - least + 1])]
    prefix = spark.createDataFrame(
        prefixes, "rank int, label string, at int, least int, ranked array<int>")
    ranks = F.array(*[F.lit(rank[w]) for w in range(len(vocabulary))])
    ranked = blocks.select("row", F.array_sort(F.transform(
        "block", lambda w: F.get(ranks, w))).alias("block"))
    shared = ranked.select("row", "block", F.posexplode("block").alias("place", "rank"))
    behind = F.least(F.size("ranked") - F.col("at"), F.size("block") - F.col("place"))
    common = F.size(F.array_intersect("block", "ranked"))
    return shared.join(F.broadcast(prefix), "rank").where(  # as small as the templates are
        (F.size("block") >= F.col("least")) & (behind >= F.col("least"))).where(
        common >= F.col("least")).select(
        "row", "label", (common / F.size("ranked")).alias("containment"))


def scan_licenses(docs: DataFrame, templates=None) -> DataFrame:
    """One row for every row of documents (doc_id, text): doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    The base columns count the places where a phrase of BASE stands word by word; ``labels``
    adds those of the matching templates, distinct and sorted. The score is the greatest
    containment of a matching template, and 1 where a phrase stands whole. A null or empty
    text has no words and no labels (empty strings, score 0, null places). Repeated rows are
    judged alike, null ids come back, other columns are ignored, an empty table gives no rows.
    """
    scan = scanned(docs, templates)
    found = matches(scan, templates).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = F.filter(F.split("base_labels", ","), lambda s: s != "")
    both = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    return scan.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
