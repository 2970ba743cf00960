"""op12: the rollup of padded windows against the SQL and against a plain count."""

import re
from collections import Counter

import pytest

from shelfmark import session
from shelfmark.llm import oracle, phrases, queries
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.01"


def test_whole_table_like_sql(spark):
    assert difference(spark, connect(FOLDER), FOLDER, queries.REGISTRY["op12_phrase_collocations"],
                      oracle.SQL["op12_phrase_collocations"]) is None


def plain(rows, top=phrases.TOP):
    by_lang = {}
    for text, lang in rows:
        text = (text or "").translate(str.maketrans(phrases.UPPER, phrases.LOWER))
        f, n = by_lang.setdefault(lang or "und", (Counter(), [0]))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[0] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[" ".join(w[i:i + k])] += 1
    out = []
    for lang, (f, n) in by_lang.items():
        cand = {p: a for p, a in f.items() if a >= 30 and len(p.split()) >= 2}
        found = []
        for p, a in cand.items():
            w = p.split()
            cuts = [(2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            inside = any(len(q.split()) > len(w) and f" {p} " in f" {q} " and 100 * b >= 80 * a
                         for q, b in cand.items())
            if not inside:
                found.append((score, a, p, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[0], s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def test_fixture_against_plain_count(spark):
    rows = ([("New York city. new york STATE; Ünïcode Wörds here", "en")] * 40
            + [("new york; the big apple of new york", None)] * 31
            + [(None, "en"), ("", "de"), ("a\tb c " * 3000, "de")]
            + [("x y z w. x y z w", "fr")] * 16 + [("x y", "fr")] * 20)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(tuple(r) for r in phrases.collocations(df).collect())
    assert got == plain(rows)
    assert got  # the fixture has candidates of two, three and four words


def test_top_and_empty(spark):
    rows = [(" ".join(f"w{i} w{i + 1}" for i in range(j, j + 3)), "en") for j in range(5)] * 30
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(df, top=2).collect()) == plain(rows, top=2)
    empty = spark.createDataFrame([], "text string, lang string, extra int")
    assert phrases.collocations(empty).count() == 0


ODD = ([(f"to be or not u{i} v{i} w{i} x{i} to be, or y{i} not", "en") for i in range(40)]
       + [("to be or not to", "fr")] * 29 + [(None, None), ("", "de")])


def test_windows_are_cut_before_what_is_seldom(spark):
    docs = spark.createDataFrame(ODD, "text string, lang string")
    rows = phrases.pruned_windows(docs)
    # Of 480 words in en only these begin a window: to be or not, be or not, or not, to be.
    assert sorted(r["count"] for r in rows.groupBy(*phrases.COLS).count().collect()) == [40] * 4
    assert phrases.counts(docs).count() == 6


@pytest.mark.parametrize("limit", [1, 2_000_000])
def test_cut_or_not_gives_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame(ODD, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == plain(ODD)


def test_texts_are_read_once_for_all_windows(spark, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame(ODD, "text string, lang string").write.parquet(path)
    rows = phrases.pruned_windows(spark.read.parquet(path))
    assert rows.inputFiles() and not any(path in f for f in rows.inputFiles())


def test_dictionary_counts_the_words_of_pieces(spark):
    rows = [("To be, OR\tnot!to  be. ÉTÉ été Été:\x0b\x0c A\xa0B İ", "en"), ("İ ÅB ÅB;;K K", None),
            (".,;:!?\n\x0b\x0c\r \t", "de"), (None, "de"), ("ONE", "en"), ("a\x85b\x1fc", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    expected = Counter()
    for text, lang in rows:
        text = (text or "").translate(str.maketrans(phrases.UPPER, phrases.LOWER))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            expected.update((lang or "und", w) for w in re.findall(r"[^\x20\x09]+", piece))
    assert {(r.lang, r.word): r.f for r in phrases.dictionary(docs).collect()} == expected


def test_windows_are_cut_however_many_pairs_are_frequent(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    rows = phrases.pruned_windows(spark.createDataFrame(ODD, "text string, lang string"))
    assert sorted(r["count"] for r in rows.groupBy(*phrases.COLS).count().collect()) == [40] * 4


@pytest.mark.parametrize("marks", [64, 256])
def test_shared_marks_give_the_same(spark, monkeypatch, marks):
    monkeypatch.setattr(phrases, "MARKS", marks)
    docs = spark.createDataFrame(ODD, "text string, lang string")
    assert phrases._marks(phrases.windows(phrases.coded(docs)), 2).count() <= marks // 64
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == plain(ODD)
