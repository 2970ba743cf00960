"""Quality rules: counts against plain versions, bounds against exact quantiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfmark.llm import queries, rules

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup,
            len(covered))


def test_counts():
    rng = random.Random(1)
    texts = ["", " \n", "a b c d e f g h i j", "a b " * 9, "x\nx\n\nx \ny\x0by z é🙂 #*$%&|<>",
             "A\r\nA\r\n", *(" ".join(rng.choices("abcde", k=rng.randint(0, 60))) for _ in range(200)),
             *("\n".join(rng.choices(["a b", "c", "", " "], k=9)) for _ in range(50))]
    for text in texts:
        assert rules.measures(text.encode())[:5] == plain(text), text


def test_whole_table(spark):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.REGISTRY["op5_quality_rules"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    # The bounds again, from exact quantiles; only rows right at a bound may differ.
    measured = {i: rules.measures((d.text or "").encode()) for i, d in docs.items()}
    by = {"source": defaultdict(list), "lang": defaultdict(list), "all": []}
    ratios = {}
    for i, (n, chars, symbols, dup, repeat, lines) in measured.items():
        ratios[i] = dict(symbol_ratio=symbols / max(n, 1), dup_line_ratio=dup / max(lines, 1),
                         repeat_ratio=repeat / max(n, 1), word_length=chars / max(n, 1))
        d = docs[i]
        by["source"][d.lang, d.source].append(ratios[i])
        by["lang"][d.lang].append(ratios[i])
        by["all"].append(ratios[i])
    differ = 0
    for r in rows:
        d, m = docs[r.doc_id], measured[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m[:5]
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        group = next(g for g in (by["source"][d.lang, d.source], by["lang"][d.lang], by["all"])
                     if g is by["all"] or len(g) >= rules.LEAST_ROWS)
        good = not r.base_failed
        for name, least in rules.SPREAD.items():
            q25, q50, q75 = np.quantile([x[name] for x in group], (.25, .5, .75))
            value = ratios[r.doc_id][name]
            good &= value <= q75 + rules.REACH * max(q75 - q50, least)
            if name in rules.TWO_SIDED:
                good &= value >= q25 - rules.REACH * max(q50 - q25, least)
        differ += good != r.kept
    assert differ <= len(rows) // 200


def test_clean_stay_and_junk_goes(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.REGISTRY["op5_quality_rules"](spark, FOLDER).collect()
    fine = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in fine) >= 0.99 * len(fine)
    assert sum(r.kept for r in junk) <= 0.2 * len(junk)


def test_small_groups_lean_on_their_language(spark, docs_of, monkeypatch):
    monkeypatch.setattr(rules, "LEAST_ROWS", 5)
    rows = [(i, f"word{i} " * 3 + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(30)]
    docs = docs_of(rows).selectExpr(
        "doc_id", "text", "CASE WHEN doc_id < 20 THEN 'en' WHEN doc_id < 28 THEN NULL ELSE 'xx' END "
        "AS lang", "CASE WHEN doc_id < 10 THEN 's' ELSE NULL END AS source")
    bounds = rules.thresholds(rules.measured_documents(docs, ["lang", "source"]).select(
        "_row.*", *rules.COUNTS)).collect()
    assert {(b.lang, b.source) for b in bounds} == {
        ("en", "s"), ("en", None), (None, None), ("xx", None)}
    assert rules.judge(docs).count() == 30


def test_keep_good_is_judge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in rules.judge(docs).where("kept").collect()}
    out = rules.keep_good(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_edges(spark, docs_of):
    docs = docs_of([(None, "a b"), (1, None), (1, None), (2, ""), (3, " ".join(
        f"w{i}" for i in range(150_000)))]).selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS `a.b`")
    rows = sorted(((r.doc_id or -1, r.n_words, r.kept) for r in rules.judge(docs).collect()))
    assert [r[:2] for r in rows] == [(-1, 2), (1, 0), (1, 0), (2, 0), (3, 150_000)]
    assert rules.keep_good(docs).columns == docs.columns
    assert rules.judge(docs_of([])).collect() == [] == rules.keep_good(docs_of([])).collect()
