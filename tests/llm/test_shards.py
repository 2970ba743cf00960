"""Shards: exact balance, numbers without gaps, and copies that stay together."""

import zlib
from collections import Counter, defaultdict

import pytest

from shelfmark.llm import queries, shards


def check(rows, texts, n_shards):
    """The law, the slots and the digests; returns how many groups are spread over shards."""
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(n_shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    digests = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8)
                      for i, t in texts)
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in rows) == digests
    return sum(len(w) > 1 for w in where.values())


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = queries.REGISTRY["op9_sharding"](spark, folder).collect()
    groups = [n for n in Counter(d.text for d in docs).values() if 1 < n <= len(docs) // 48]
    assert check(rows, [(d.doc_id, d.text) for d in docs], 24) <= max(3, len(groups) // 5)


@pytest.mark.parametrize("task_rows", [50_000, 10])
def test_hot_group(spark, docs_of, monkeypatch, task_rows):
    """A third of the rows are equal, the others come in pairs or alone."""
    monkeypatch.setattr(shards, "TASK_ROWS", task_rows)
    texts = [(i, "hot" if i % 3 == 0 else f"t{i // 4}" if i % 2 else f"s{i}") for i in range(1203)]
    rows = shards.assign(docs_of(texts), shards=6).collect()
    spread = check(rows, texts, 6)
    hot = Counter(r.shard for r in rows if r.text_crc32 == zlib.crc32(b"hot"))
    pairs = sum(n > 1 for n in Counter(t for _, t in texts).values())
    assert spread <= pairs // 20
    assert sum(n for _, n in hot.most_common(4)) > 0.9 * sum(hot.values())


def test_grants_keep_the_balance():
    asked = {(0, 1): 10, (1, 0): 3, (2, 1): 9, (1, 2): 1, (0, 2): 4}
    for free in ({}, {0: 2, 1: 5, 2: 1}, {0: 99, 1: 99, 2: 99}):
        granted, upto = shards.grant(asked, free, 3)
        net = [0] * 3
        for a in range(3):
            for b in range(3):
                assert granted[a * 3 + b] <= asked.get((a, b), 0)
                filler = upto[b * 3 + a] - (upto[b * 3 + a - 1] if a else 0)
                net[a] += filler - granted[a * 3 + b]
                net[b] += granted[a * 3 + b] - filler
            assert upto[a * 3 + 2] <= free.get(a, 0)
        assert net == [0, 0, 0]


def test_plan_is_native(spark, docs_of):
    plan = shards.assign(docs_of(["a", "a", "b"]))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_edges(spark, docs_of):
    texts = [(None, "x"), (1, None), (1, ""), (1, None), (2, "x")]
    docs = docs_of(texts).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS row", "4 AS n")
    check(shards.assign(docs).collect(), texts, 24)
    assert shards.assign(docs_of([])).collect() == []
