"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from shelfmark.llm import oracle, queries, vectors
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    """{vec_id: (n_links, component_id)} by all pairs, in double precision."""
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            a, b = np.array(a, float), np.array(b, float)
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], links[i], min(least[find(i)])) for i in range(n))


def found(df):
    rows = vectors.near_duplicates(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in rows)


def test_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = queries.REGISTRY["op8_embedding_dedup"](spark, FOLDER).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain(rows)


def test_whole_table_like_sql(spark):
    assert difference(spark, connect(FOLDER), FOLDER, queries.REGISTRY["op8_embedding_dedup"],
                      oracle.SQL["op8_embedding_dedup"]) is None


@pytest.mark.parametrize("block", [512, 7])
def test_clouds_and_chains(spark, monkeypatch, block):
    """Dense clouds over several blocks, chains, pairs just above and below the threshold."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []

    def add(v, label=1):
        rows.append((len(rows), [float(x) for x in np.float32(v)], int(label)))

    for dim in (3, 16, 64):
        for size in (1, 2, 30):
            centre = rng.normal(size=dim)
            for _ in range(size):
                add(centre + .05 * rng.normal(size=dim) * np.abs(centre).mean())
                add(2 * centre if size == 2 else centre, rng.integers(0, 2))
        for degrees in (11.3, 11.47, 11.49, 11.6):
            for _ in range(6):
                a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
                t = math.radians(degrees)
                add(a), add(math.cos(t) * a + math.sin(t) * b)
        at = rng.normal(size=dim)
        for _ in range(12):
            add(at)
            at = at + .17 * np.linalg.norm(at) / math.sqrt(dim) * rng.normal(size=dim)
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    u, v = (vectors.unit(rng.normal(size=(4000, 64))) for _ in range(2))
    v = vectors.unit(u + rng.uniform(0, 2, (4000, 1)) * v)
    signs, factor = vectors.codes(u)
    estimate = ((2. * signs - 1) * (v @ vectors.rotation(64, 0).T)).sum(1) / 8 / factor
    error = estimate - (u * v).sum(1)
    doubt = vectors.CONFIDENCE * np.sqrt((1 - factor ** 2) / factor ** 2 / 63)
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) < doubt).all()


def test_bands_reach_the_threshold():
    for n in (1, 1000, 10 ** 9):
        bits, bands = vectors.bands_for(n)
        assert (1 - (1 - math.acos(.98) / math.pi) ** bits) ** bands <= vectors.MISS
        assert bits >= math.log2(n)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0., 0.], 0), (4, [1., None], 0), (5, [nan, 1.], 0),
            (6, [inf, 1.], 0), (7, [1., 2.], None), (8, [1., 2.], None), (9, [1., 2.], 3),
            (10, [2., 4.], 3), (10, [2., 4.], 3), (11, [1., 2., 0.], 3), (12, [-0., 1.], 3),
            (13, [0., 1.], 3), (14, [1e-30, 2e-30], 3), (15, [1e30, 2e30], 3)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    table = spark.createDataFrame([(None, [1., 2.], 3), (4, [1., 2.], 3)], SCHEMA).selectExpr(
        "*", "1 AS node", "2 AS band", "3 AS keys", "4 AS copies")
    rows = vectors.near_duplicates(table).collect()
    assert sorted((r.n_links, r.component_id, r.kept) for r in rows) == [
        (1, 4, False), (1, 4, True)]
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
