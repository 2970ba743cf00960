"""Fingerprints and groups against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from shelfmark.llm import queries, simhash
from shelfmark.llm.components import components


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """The smallest index reachable from each, by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    groups = plain_groups(fps)
    expected = {d.doc_id: (f"{f:016x}", docs[g].doc_id)
                for d, f, g in zip(docs, fps, groups)}
    found = queries.REGISTRY["op1_simhash"](spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == expected
    assert len(found) == len(docs)


@pytest.mark.parametrize("block", [1 << 21, 5000])
@pytest.mark.parametrize("crowd", [1 << 15, 16])
def test_links_connect_like_all_pairs(spark, monkeypatch, crowd, block):
    """Random clouds of near fingerprints, chains at distance four, in split prefixes and in
    blocks too."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(12):
            fps.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4, 4, 5])))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    expected = [fps[g] for g in plain_groups(fps)]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    mine = [found.get(f, f) for f in signed]
    assert len(set(zip(mine, expected))) == len(set(mine)) == len(set(expected))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame(chain + [(7, 7), (None, 3)], "a bigint, b bigint")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_edges(spark, docs_of):
    long = " ".join(f"w{i % 977}" for i in range(70000))
    texts = [(5, "A b c"), (3, "a B c"), (9, None), (8, ""), (7, " \n\t"), (1, long), (2, long),
             (2, long), (None, "a b c"), (4, "nothing like it at all, é")]
    docs = docs_of(texts)
    found = {(r.doc_id, r.fingerprint): r.component_id
             for r in simhash.near_duplicates(docs).collect()}
    zero = "0" * 16
    assert found[(9, zero)] == found[(8, zero)] == found[(7, zero)] == 7
    abc = f"{plain_fingerprint('a b c'):016x}"
    assert found[(5, abc)] == found[(3, abc)] == found[(None, abc)] == 3
    assert found[(1, f"{plain_fingerprint(long):016x}")] == 1
    assert simhash.near_duplicates(docs).count() == len(texts)
    assert sorted(r.doc_id or -1 for r in simhash.keep_first(docs).collect()) == [-1, 1, 3, 4, 7]
    assert simhash.keep_first(docs).columns == docs.columns


def test_rows_of_one_id_are_judged_by_row(spark, docs_of):
    """Distinct texts under one id all stay; a copy of an older group under it goes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (2, b), (3, c), (3, b), (4, None), (4, ""), (None, c)]
    for docs in (docs_of(rows), docs_of(rows[::-1]).coalesce(1)):
        found = sorted(((r.doc_id or 0, r.text or "") for r in simhash.keep_first(docs).collect()))
        assert found == [(0, c), (1, a), (2, b), (3, c), (4, "")]
    same = simhash.keep_first(docs_of([(7, a), (7, b), (7, c), (7, a)])).collect()
    assert sorted(r.text for r in same) == [a, b, c]


def test_empty_and_clashing_columns(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    docs = docs_of(["a b c d e"]).selectExpr(
        "doc_id", "text", "1 AS fp", "2 AS prefix", "3 AS root", "4 AS component_id")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [0]
    assert simhash.keep_first(docs).count() == 1
