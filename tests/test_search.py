"""Search operators against brute force in Python over a small corpus."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas, search, search_text, view_of
from shelfmark.functions.analysis import STOP_WORDS
from shelfmark.operators import clauses as clause_ops, results

WORDS = ["alpha", "beta", "gamma", "delta", "alfa", "betas", "été", "x1", "the", "of", "a",
         "gamut", "al", "zeta", "b"]
BOUNDS = ("prefix", "wildcard", "fuzzy", "range", "range_exclusive")


def analyzed(text):
    tokens = re.findall(r"[^\W_]+", (text or "").lower())
    return [(t, i) for i, t in enumerate(tokens) if t not in STOP_WORDS]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    docs = [(f"v{i % 3}", f"p{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))))
            for i in range(60)]
    return docs + [("v0", "empty", ""), ("v0", "null", None), ("v1", "stops", "the of a")]


@pytest.fixture(scope="module")
def view(spark, corpus):
    return view_of(spark.createDataFrame(corpus, schemas.DOCS).cache())


def ask(spark, view, *rows, **options):
    """Paths found by query 1; each row is a dict of clause columns."""
    return {h["path"] for h in hits(spark, view, *rows, **options)}


def hits(spark, view, *rows, **options):
    columns = [c.split(" ") for c in schemas.CLAUSES.split(", ")]
    if not any("group_id" in row for row in rows):
        columns = [c for c in columns if not c[0].startswith("group")]
    data = [tuple({"query_id": 1, "clause_id": i, **row}.get(name) for name, _ in columns)
            for i, row in enumerate(rows)]
    frame = spark.createDataFrame(data, ", ".join(" ".join(c) for c in columns))
    return search(view, frame, **options).collect()


def containing(corpus, test):
    return {path for _, path, text in corpus if test([t for t, _ in analyzed(text)])}


def test_term_and_case(spark, view, corpus):
    expected = containing(corpus, lambda ts: "été" in ts)
    assert expected and ask(spark, view, {"text": "ÉTÉ"}) == expected


def test_nothing_to_look_for(spark, view):
    assert ask(spark, view, {"text": "the of"}) == set()
    assert ask(spark, view, {"text": ""}) == set()
    assert ask(spark, view, {"text": None}) == set()
    assert ask(spark, view, {"text": "alpha", "occur": "must_not"}) == set()
    assert ask(spark, view, {"kind": "prefix", "text": ""}) == set()


def test_any_all_not(spark, view, corpus):
    any_of = ask(spark, view, {"text": "alpha"}, {"text": "beta"})
    all_of = ask(spark, view, {"text": "alpha", "occur": "must"}, {"text": "beta", "occur": "must"})
    no_beta = ask(spark, view, {"text": "alpha"}, {"text": "beta", "occur": "must_not"})
    assert any_of == containing(corpus, lambda ts: "alpha" in ts or "beta" in ts)
    assert all_of == containing(corpus, lambda ts: "alpha" in ts and "beta" in ts)
    assert no_beta == containing(corpus, lambda ts: "alpha" in ts and "beta" not in ts)
    assert all_of < any_of


def test_required_term_that_nobody_has(spark, view):
    assert ask(spark, view, {"text": "alpha"}, {"text": "nowhere", "occur": "must"}) == set()


def test_optional_clauses_only_add_score(spark, view, corpus):
    rows = hits(spark, view, {"text": "alpha", "occur": "must"}, {"text": "beta"})
    assert {r["path"] for r in rows} == containing(corpus, lambda ts: "alpha" in ts)


def test_same_term_twice_counts_twice(spark, view):
    once = {r["path"]: r["score"] for r in hits(spark, view, {"text": "alpha"})}
    twice = {r["path"]: r["score"] for r in hits(spark, view, {"text": "alpha"}, {"text": "alpha"})}
    assert once.keys() == twice.keys()
    assert all(abs(twice[p] - 2 * once[p]) < 3e-6 for p in once)


def phrase_places(text, phrase):
    words, at = analyzed(phrase), {}
    for t, i in analyzed(text):
        at[i] = t
    return sum(all(at.get(i + p - words[0][1]) == t for t, p in words) for i in at)


@pytest.mark.parametrize("phrase", [
    "alpha beta", "beta alpha", "al al", "alpha the beta", "the alpha of a gamma of", "zeta",
    "alpha beta gamma"])
def test_phrase(spark, view, corpus, phrase):
    expected = {path for _, path, text in corpus if phrase_places(text, phrase)}
    found = ask(spark, view, {"kind": "phrase", "text": phrase})
    assert found == expected
    all_of = ask(spark, view, *[{"text": t, "occur": "must"} for t, _ in analyzed(phrase)])
    assert found <= all_of


def window_places(text, words, slop):
    terms = list(dict.fromkeys(t for t, _ in analyzed(words)))
    last, n = {}, 0
    for t, i in analyzed(text):
        if t in terms:
            last[t] = i
            n += len(last) == len(terms) and i - min(last.values()) - len(terms) + 1 <= slop
    return n


@pytest.mark.parametrize("words", ["alpha beta", "gamma beta alpha", "delta delta zeta x1"])
def test_proximity(spark, view, corpus, words):
    before = set()
    for slop in (0, 2, 8):
        found = ask(spark, view, {"kind": "proximity", "text": words, "slop": slop})
        assert found == {p for _, p, text in corpus if window_places(text, words, slop)}
        assert before <= found
        before = found


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def term_matches(kind, text, text2, slop, term):
    if kind == "prefix":
        return term.startswith(text)
    if kind == "wildcard":
        pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in text)
        return re.fullmatch(pattern, term) is not None
    if kind == "fuzzy":
        return distance(term, text) <= slop
    above = text is None or term >= text if kind == "range" else text is None or term > text
    below = text2 is None or term <= text2 if kind == "range" else text2 is None or term < text2
    return above and below


PATTERNS = [
    ("prefix", "al", None, 0), ("prefix", "b", None, 0), ("prefix", "ét", None, 0),
    ("wildcard", "?l*a", None, 0), ("wildcard", "*a", None, 0), ("wildcard", "*am*", None, 0),
    ("wildcard", "*", None, 0), ("wildcard", "??", None, 0), ("wildcard", "alpha", None, 0),
    ("wildcard", "?t?", None, 0), ("wildcard", "%_", None, 0),
    ("fuzzy", "alpha", None, 0), ("fuzzy", "alpha", None, 1), ("fuzzy", "alpha", None, 2),
    ("fuzzy", "bet", None, 1), ("fuzzy", "b", None, 1), ("fuzzy", "ete", None, 2),
    ("fuzzy", "xy", None, 3), ("range", "alfa", "beta", 0), ("range", None, "b", 0),
    ("range", "gamma", None, 0), ("range_exclusive", "alfa", "beta", 0),
    ("range_exclusive", "b", None, 0), ("range", "z", "a", 0), ("range", "y", "ü", 0),
]


def test_expansion_finds_exactly_the_terms(spark, view):
    """All patterns at once: anchors must not lose a term."""
    dictionary = [w for w in WORDS if w not in STOP_WORDS] + [
        "al%ha", "abcdefgh", "ab", "ba", "zzz", "üb", "日本", "日"]
    rng = random.Random(3)
    dictionary += ["".join(rng.choice("abé日") for _ in range(rng.randint(1, 7)))
                   for _ in range(300)]
    dictionary = sorted(set(dictionary))
    extra = [("fuzzy", t, None, k) for t in rng.sample(dictionary, 25) for k in (1, 2, 3)]
    extra += [("range", *sorted(rng.sample(dictionary, 2)), 0) for _ in range(10)]
    patterns = PATTERNS + extra
    rows = [(i, 0, "should", k, "contents", t, t2, s, 1.0)
            for i, (k, t, t2, s) in enumerate(patterns)]
    frame = spark.createDataFrame(
        rows, "query_id BIGINT, clause_id INT, occur STRING, kind STRING, field STRING, "
              "text STRING, text2 STRING, slop INT, boost DOUBLE")
    asked = clause_ops.anchored(clause_ops.analyze_clauses(frame))
    terms = spark.createDataFrame([(t,) for t in dictionary], "term STRING")
    found = {}
    for r in clause_ops.expand_patterns(asked, terms).collect():
        assert r["term"] not in found.setdefault(r["pattern"], set())
        found[r["pattern"]].add(r["term"])
    keys = {r["query_id"]: r["pattern"] for r in clause_ops.with_pattern(
        clause_ops.analyze_clauses(frame)).collect()}
    for i, pattern in enumerate(patterns):
        assert found.get(keys[i], set()) == {
            t for t in dictionary if term_matches(*pattern, t)}, pattern


@pytest.mark.parametrize("kind,text,text2,slop", [PATTERNS[i] for i in (0, 3, 13, 18)])
def test_expanded_search(spark, view, corpus, kind, text, text2, slop):
    expected = containing(
        corpus, lambda ts: any(term_matches(kind, text, text2, slop, t) for t in ts))
    rows = hits(spark, view, {"kind": kind, "text": text, "text2": text2, "slop": slop,
                              "boost": 2.0})
    assert {r["path"] for r in rows} == expected
    assert {r["score"] for r in rows} == {2.0}


def test_path_field(spark, view):
    assert ask(spark, view, {"field": "path", "text": "p7"}) == {"p7"}
    assert ask(spark, view, {"field": "path", "text": "P7"}) == set()
    assert ask(spark, view, {"field": "path", "text": "empty"}) == {"empty"}


def test_groups(spark, view, corpus):
    rows = [{"text": t, "group_id": g, "group_occur": o} for g, o, t in (
        (1, "must", "alpha"), (1, "must", "alfa"), (2, "must", "beta"), (2, "must", "zeta"),
        (3, "must_not", "x1"))]
    expected = containing(corpus, lambda ts: {"alpha", "alfa"} & set(ts)
                          and {"beta", "zeta"} & set(ts) and "x1" not in ts)
    assert ask(spark, view, *rows) == expected


def test_set_operations(spark, view, corpus):
    def one(text):
        return search_text(view, spark.createDataFrame([(1, text)], "query_id BIGINT, text STRING"))

    def paths(frame):
        return {r["path"] for r in frame.collect()}

    a, b = one("alpha"), one("beta")
    assert paths(results.both(a, b)) == paths(a) & paths(b)
    assert paths(results.either(a, b)) == paths(a) | paths(b)
    assert paths(results.without(a, b)) == paths(a) - paths(b)


@pytest.mark.parametrize("shared,limit", [(False, -1), (True, -1), (False, 10)])
def test_shuffle_joins_give_the_same(spark, view, monkeypatch, shared, limit):
    rows = [{"text": "alpha", "occur": "must"}, {"text": "gamma"},
            {"kind": "phrase", "text": "alpha beta"}, {"kind": "proximity", "text": "x1 beta",
                                                       "slop": 3},
            {"kind": "wildcard", "text": "*et*"}, {"field": "path", "text": "p9"},
            {"text": "b", "occur": "must_not"}]
    broadcast = {(r["path"], r["score"])
                 for r in hits(spark, view, *rows, shared_statistics=shared)}
    monkeypatch.setattr("shelfmark.session.BROADCAST_ROWS", limit)
    shuffled = {(r["path"], r["score"])
                for r in hits(spark, view, *rows, shared_statistics=shared)}
    assert broadcast and broadcast == shuffled


AT_DOCUMENTS = [
    [{"text": "alpha", "occur": "must"}, {"text": "gamma"}, {"text": "gamma", "boost": 0.3},
     {"text": "b", "occur": "must_not"}],
    [{"text": t, "group_id": g, "group_occur": o} for g, o, t in (
        (1, "must", "alpha"), (1, "must", "alfa"), (2, "should", "alpha"), (3, "must_not", "x1"))],
    [{"text": "alpha"}, {"kind": "phrase", "text": "alpha beta"}, {"field": "path", "text": "p9"}]]


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("rows", AT_DOCUMENTS)
def test_sums_at_documents_give_the_same(spark, view, monkeypatch, rows, shared):
    # A second query shares terms with the first.
    rows = rows + [{**row, "query_id": 2} for row in rows[1:]] + [{"query_id": 2, "text": "zeta"}]
    def found():
        return {(r["query_id"], r["volume"], r["path"]): r["score"]
                for r in hits(spark, view, *rows, shared_statistics=shared)}
    by_query = found()
    monkeypatch.setattr("shelfmark.operators.matching.SUMS_IN_A_TASK", 10)
    at_documents = found()
    assert {key[0] for key in by_query} == {1, 2}
    assert at_documents == pytest.approx(by_query, abs=1.5e-6)


def test_open_hits(spark, view, corpus):
    docs = spark.createDataFrame(corpus, schemas.DOCS)
    found = search_text(view, spark.createDataFrame([(1, "zeta")], "query_id BIGINT, text STRING"))
    opened = results.open_hits(results.top_k(found, 2), docs).collect()
    assert opened and all("zeta" in r["contents"] for r in opened)


def test_ranking_of_a_big_group(spark):
    """One group holds most rows, with many ties: numbers must equal a sorted list's."""
    rng = random.Random(1)
    rows = [(1 if i % 10 else i, "v", f"p{i}", float(rng.randint(0, 3))) for i in range(5000)]
    frame = spark.createDataFrame(rows, schemas.HITS).repartition(7)
    found = {(r["query_id"], r["path"]): r["rank"] for r in results.rank_hits(frame).collect()}
    for query, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        best_first = sorted(group, key=lambda r: (-r[3], r[2]))
        assert [found[query, r[2]] for r in best_first] == list(range(1, len(best_first) + 1))


def test_hits_are_computed_once_to_be_ranked(spark, tmp_path):
    """Ranges are drawn from a sample; what is ranked must not run again for it."""
    seen = str(tmp_path / "seen")

    def noted(batches):
        for batch in batches:
            with open(seen, "a") as file:
                file.write("x" * batch.num_rows)
            yield batch

    rows = [(i % 3, "v", f"p{i}", float(i % 7)) for i in range(500)]
    frame = spark.createDataFrame(rows, schemas.HITS).mapInArrow(noted, schemas.HITS)
    assert results.merged_ranking(frame).count() == 500
    assert len(open(seen).read()) == 500


def test_positions_follow_the_volume_order(spark):
    rows = [(1, "b", "x", 1.0), (1, "a", "y", 9.0), (1, "a", "z", 9.5), (2, "a", "x", 1.0)]
    order = spark.createDataFrame([("b", 1), ("a", 2)], "volume STRING, volume_order INT")
    ranked = results.rank_hits(spark.createDataFrame(rows, schemas.HITS))
    listed = results.hit_paths(results.concat_volumes(ranked, order)).orderBy(
        "query_id", "position").collect()
    assert [tuple(r) for r in listed] == [(1, 1, "x"), (1, 2, "z"), (1, 3, "y"), (2, 1, "x")]
    merged = results.merged_ranking(spark.createDataFrame(rows, schemas.HITS)).filter(
        "query_id = 1").orderBy("rank").collect()
    assert [r["path"] for r in merged] == ["z", "y", "x"]
    assert results.top_k(ranked.drop("rank"), 1).filter(F.col("rank") > 1).isEmpty()


def test_phrases_without_ids_stay_apart(spark):
    docs = spark.createDataFrame(
        [("v", "both", "new york and los angeles"), ("v", "mixed", "new angeles"),
         ("v", "one", "new york")], "volume STRING, path STRING, contents STRING")
    clauses = spark.createDataFrame(
        [(1, "phrase", "new york"), (1, "phrase", "los angeles")],
        "query_id BIGINT, kind STRING, text STRING")
    hits = {r["path"]: r["score"] for r in search(view_of(docs), clauses).collect()}
    assert set(hits) == {"both", "one"} and hits["both"] > hits["one"]
