"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector u is rotated at random; its code is the signs of R u, read as the vector
s = sign(R u) / sqrt(D), and its correction factor is f = <s, R u>. For another vector v,
<s, R v> / f is an unbiased estimate of <u, v>, and with high probability it is off by no more
than CONFIDENCE * sqrt((1 - f^2) / f^2 / (D - 1)). A pair is computed exactly, in double
precision, where estimate plus bound reach the threshold.

Pairs are looked for where codes agree in a band of bits. The number of bits grows with the
logarithm of the table, and there are as many bands as leave a pair at the threshold a chance
of MISS of sharing none. Equal vectors are one node. What shares a band is compared in blocks,
and only each vector's count of links and its local group leave a block, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, map_stream
from shelfmark.llm.components import components
from shelfmark.session import written

COSINE = 0.98
CONFIDENCE = 5.0
MISS = 1e-7
BLOCK = 512  # vectors of a block
CHUNK = 1 << 14  # pairs at a time


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def bands_for(n: int) -> tuple[int, int]:
    """(bits, bands) for ``n`` vectors that may be compared with each other."""
    bits = min(40, max(8, n.bit_length() + 4))
    same = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors ** 2).sum(1, keepdims=True))


def codes(units: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signs (as booleans) and correction factors."""
    turned = units @ rotation(units.shape[1], number).T
    return turned >= 0, np.abs(turned).sum(1) / math.sqrt(units.shape[1])


def band_keys(units: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """One number for every vector and band."""
    dim = units.shape[1]
    signs = np.concatenate([codes(units, r)[0] for r in range(-(-bits * bands // dim))], 1)
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs[:, :bits * bands].reshape(len(units), bands, bits) @ weights


def index(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    """Nodes (node, embedding, ...) with code (packed signs), factor and keys (one per band)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column("embedding").to_pylist()
        out = [None] * len(vectors)
        lengths = np.array([len(v) for v in vectors], int)
        for dim in np.unique(lengths):
            mine = np.flatnonzero(lengths == dim)
            units = unit(np.array([vectors[i] for i in mine], float))
            signs, factors = codes(units)
            for i, row in zip(mine, zip(np.packbits(signs, axis=1), factors,
                                        band_keys(units, bits, bands))):
                out[i] = row
        columns = [pa.array([o[0].tobytes() for o in out], pa.binary()),
                   pa.array([o[1] for o in out], pa.float64()),
                   pa.array([o[2] for o in out], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *columns], [*batch.schema.names, "code", "factor", "keys"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return map_batches(nodes, f"{schema}, code binary, factor double, keys array<bigint>", work)


def compare(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs of rows of equal length, sorted by group, that this group
    is to count: by estimate, bound and exact recomputation. Rows of one block meet each
    other, rows of two blocks meet across, and pairs that share an earlier band are left out."""
    u = unit(rows["embedding"])
    dim = u.shape[1]
    signs = 2.0 * np.unpackbits(rows["code"], axis=1, count=dim) - 1
    turned = u @ rotation(dim, 0).T
    scale = 1 / (math.sqrt(dim) * rows["factor"])
    doubt = CONFIDENCE * np.sqrt(np.maximum(1 - rows["factor"] ** 2, 0)
                                 / rows["factor"] ** 2 / max(dim - 1, 1))
    group, block, across = rows["group"], rows["block"], rows["low"] != rows["high"]
    found, apart = [], 1
    near = np.flatnonzero(group[1:] == group[:-1])
    while len(near):  # rows that are ``apart`` places from each other in one group
        i = near[~across[near] | (block[near] != block[near + apart])]
        for at in range(0, len(i), CHUNK):
            a, b = i[at:at + CHUNK], i[at:at + CHUNK] + apart
            estimate = np.einsum("ij,ij->i", signs[a], turned[b]) * scale[a]
            maybe = estimate + doubt[a] >= COSINE
            a, b = a[maybe], b[maybe]
            same = np.einsum("ij,ij->i", u[a], u[b]) >= COSINE
            a, b = a[same], b[same]
            earlier = (rows["keys"][a] == rows["keys"][b]) & (
                np.arange(rows["keys"].shape[1]) < rows["band"][a][:, None])
            found.append((a[~earlier.any(1)], b[~earlier.any(1)]))
        apart += 1
        near = near[near + apart < len(group)]
        near = near[group[near] == group[near + apart]]
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return tuple(np.concatenate(side) for side in zip(*found))


def _tally(nodes: np.ndarray, copies: np.ndarray, i: np.ndarray,
           j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, links) from linked pairs of positions: the smallest node each node is
    connected with by these pairs, and the number of vectors it is linked to by them."""
    own, a = np.unique(nodes[np.concatenate([i, j])], return_inverse=True)
    a, b = a[:len(i)], a[len(i):]
    links, label = np.zeros(len(own), np.int64), np.arange(len(own))
    np.add.at(links, a, copies[j])
    np.add.at(links, b, copies[i])
    while True:
        least, after = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            return own, own[label], links
        label = after


_GROUP = ["label", "dim", "band", "key", "low", "high"]


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows again, in tables that hold whole groups."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        last = np.ones(held.num_rows, bool)
        for name in _GROUP:
            values = held.column(name).to_numpy()
            last &= values == values[-1]
        whole = held.num_rows - int(last.sum())
        if whole:
            yield held.slice(0, whole)
            held = held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def linked(indexed: DataFrame) -> DataFrame:
    """(node, root, links) in parts: nodes with links, the smallest node each is connected with
    in a part, and the number of vectors it is linked to there. A pair that shares several
    bands counts in the first of them. No pair leaves the place where it is compared."""
    keys = ["label", "dim", "band", "key"]
    banded = indexed.select("node", "label", F.size("embedding").alias("dim"),
                            F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy(*keys).count().where("count > 1").select(
        *keys, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = banded.join(shared, keys).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets itself and every other one; a pair of blocks is a group.
    met = members.select("node", *keys, "block", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "node", *keys, "block", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"))
    rows = met.join(indexed.select("node", "copies", "embedding", "code", "factor", "keys"), "node")

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        column = table.column(name).combine_chunks()
        return column.flatten().to_numpy().reshape(len(column), -1)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in _groups(batches):
            for dim in np.unique(every.column("dim").to_numpy()):
                table = every.filter(pa.compute.equal(every.column("dim"), int(dim)))
                plain = {n: table.column(n).to_numpy() for n in
                         [*_GROUP, "node", "copies", "factor", "block"]}
                start = np.zeros(table.num_rows, bool)
                for name in _GROUP:
                    start[1:] |= plain[name][1:] != plain[name][:-1]
                code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8)
                i, j = compare(plain | {
                    "group": np.cumsum(start), "embedding": matrix(table, "embedding"),
                    "keys": matrix(table, "keys"), "code": code.reshape(table.num_rows, -1)})
                found = _tally(plain["node"], plain["copies"], i, j)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found],
                                                 ["node", "root", "links"])

    dealt = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return map_stream(dealt, "node bigint, root bigint, links bigint", work)


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings (vec_id, embedding,
    label).

    Vectors with equal labels that are not null are linked from a cosine of 0.98 on; equal
    vectors are linked, however many there are. A vector that is null, empty, zero or holds a
    null or non-finite component links with nothing, and vectors of different lengths do not
    link. ``component_id`` is the smallest vec_id reachable, the own one included; kept tells
    whether it is the own one. A null vec_id is never the smallest. Repeated rows are vectors
    of their own, other columns are ignored, an empty table gives no rows.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    usable = F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0), F.lit(False))
    base = embeddings.select("vec_id", x.cast("array<double>"), "label").withColumn(
        "usable", usable & F.col("label").isNotNull())
    nodes = written(base.where("usable").groupBy("label", "embedding").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")).withColumn(
        "node", F.monotonically_increasing_id()))
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    found = written(linked(written(index(nodes, *bands_for(most)))))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # Both written, so that a large group's rows can be split in the join of the two.
    named = written(nodes.join(roots, "node", "left").join(links, "node", "left").select(
        "label", "embedding", "least_id", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    classes = written(named.groupBy("root").agg(F.min("least_id").alias("component")))
    named = named.join(classes, "root").select("label", "embedding", "links", "component")
    rows = base.where("usable").join(named, ["label", "embedding"]).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = base.where("NOT usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
