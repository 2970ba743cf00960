"""The license scan against SQL and against a plain containment count."""

import re

import pytest

from shelfmark.llm import licenses, oracle, queries
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


def test_whole_table_like_sql(spark):
    assert difference(spark, connect(FOLDER), FOLDER, queries.REGISTRY["op2_license_scan"],
                      oracle.SQL["op2_license_scan"]) is None


def plain_labels(text, templates):
    def words(t):
        return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    best = {}
    for line in text.split("\n"):
        for label, wording in templates:
            t = words(wording)
            share = len(t & words(line)) / len(t)
            if share >= 0.8:
                best[label] = max(best.get(label, 0), share)
    return best


def test_notices(spark, docs_of):
    long = dict((label, t) for label, t in licenses.TEMPLATES if len(t) > 60)
    cut = {label: " ".join(t.split()[:-2]) for label, t in long.items()}
    texts = [*long.values(), *cut.values(),
             "Under the GPL license", "x" * 50 + "\nReleased under the MIT License.\nand on",
             "mit\nlicense", "nothing here", "ALL RIGHTS\nreserved all rights",
             "the license is under apache rule", " ".join(["the under license"] * 30000)]
    found = {r.doc_id: r for r in licenses.scan_licenses(docs_of(texts)).collect()}
    for i, text in enumerate(texts):
        expected = plain_labels(text, licenses.TEMPLATES)
        base = set(filter(None, found[i].base_labels.split(",")))
        assert set(filter(None, found[i].labels.split(","))) == set(expected) | base, text[:60]
        assert found[i].score == pytest.approx(
            1.0 if found[i].n_base else max(expected.values(), default=0.0))
    assert found[len(texts) - 5].base_labels == "mit"  # a phrase goes on over the line end


def test_every_place_counts(spark, docs_of):
    text = "MIT License, mit license general Public LICENSE mit. license"
    (row,) = licenses.scan_licenses(docs_of([text])).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (
        9, 4, 0, 7, "gpl,mit")


def test_edges(spark, docs_of):
    docs = docs_of([(None, "mit license"), (1, None), (1, None), (2, ""), (3, "é MIT\tlicense")])
    docs = docs.selectExpr("*", "'x' AS labels", "1 AS row", "2 AS word", "3 AS block")
    found = sorted(map(tuple, licenses.scan_licenses(docs).collect()), key=repr)
    blank = [0, 0, None, None, "", "", 0.0]
    assert found == sorted([(1, *blank), (1, *blank), (2, *blank),
                            (3, 3, 1, 1, 1, "mit", "mit", 1.0),
                            (None, 2, 1, 0, 0, "mit", "mit", 1.0)], key=repr)
    assert licenses.scan_licenses(docs_of([])).collect() == []
