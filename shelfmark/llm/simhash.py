"""Near-duplicates by 64-bit fingerprints, linked by meet-in-the-middle ball hashing.

Two fingerprints at distance four or less have a 64-bit value that is at most two bits away
from both. So every fingerprint emits all values of its ball of radius two, values that meet
are brought together, and whoever shares a value is at distance four or less.

The 2,081 values of a fingerprint are not sent through the shuffle one by one. They are dealt
by their leading bits: a fingerprint goes once to each prefix that its ball touches and its
values are unfolded there. Crowded prefixes (many near copies) are split by a linear hash of
the *value*, which spreads even a single dense cloud evenly, and each task unfolds one bounded
block of values at a time.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, texts
from shelfmark.llm.components import components
from shelfmark.session import written

WORDS = 4
SEED = 42
HALF = 2  # half of the greatest distance, 4
FEW = 2048  # fingerprints for which one prefix is meant
CROWD = 1 << 15  # fingerprints in a prefix above which it is split
BLOCK = 1 << 21  # values unfolded at a time
CHUNK = 1 << 16  # shingles hashed at a time

_CODES = np.random.default_rng(7).integers(0, 1 << 16, 64, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text as a signed integer; 0 for a text without words."""
    words = text.lower().split()  # A-Z only, and \x20 \x09-\x0D only, as these are bytes
    if not words:
        return 0
    whole = b" ".join(words)
    size = min(WORDS, len(words))
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    starts, ends = [e + 1 for e in ends[:len(words) - size + 1]], ends[size:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(whole[a:b], SEED) for a, b in
                           zip(starts[at:at + CHUNK], ends[at:at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of documents (doc_id, text)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([fingerprint(t) for t in texts(batch)], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), found],
            ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", text_hash().alias("text_hash"), "text"),
                       f"doc_id {kind}, text_hash bigint, fp bigint", work)


def text_hash() -> Column:
    """A hash of the text that tells rows of one doc_id apart; a null text is empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in chosen) for r in range(radius + 1)
            for chosen in combinations(range(bits), r)]


def _codes(values: np.ndarray) -> np.ndarray:
    """A linear hash: the code of ``x ^ y`` is the code of x ^ the code of y."""
    out = np.zeros(len(values), np.uint64)
    for i in range(64):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * _CODES[i]
    return out


def _shared(values: np.ndarray, owners: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Pairs (owner, owner) that share a value: each to the first of its run, verified."""
    order = np.argsort(values)
    values = values[order]
    same = np.flatnonzero(values[1:] == values[:-1]) + 1
    if not len(same):
        return np.empty((0, 2), np.int64)
    first = np.arange(len(values))
    first[same] = 0
    first = np.maximum.accumulate(first)[same]
    a, b = owners[order[same]], owners[order[first]]
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    near = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 2 * HALF
    return pairs[near & (pairs[:, 0] != pairs[:, 1])]


def meet(fps: np.ndarray, prefix: int, bits: int, salt: int, salts: int) -> np.ndarray:
    """Links between the fingerprints whose balls meet at values that start with ``prefix``
    and have the linear code ``salt`` modulo ``salts`` (a power of two). Returns pairs of
    indices that connect whatever those values connect, at most one for a fingerprint."""
    low = 64 - bits
    radius = HALF - np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix)).astype(int)
    tails = fps & np.uint64((1 << low) - 1)
    parts = 1
    while len(fps) * len(_masks(low, HALF)) > BLOCK * parts * salts:
        parts *= 2
    span = np.uint64(parts * salts - 1)
    codes = _codes(tails) & span
    groups = []
    for r in range(HALF + 1):
        masks = np.array(_masks(low, r), np.uint64)
        kinds = _codes(masks) & span
        mine = np.flatnonzero(radius == r)
        by_mask = {int(k): masks[kinds == k] for k in np.unique(kinds)}
        by_code = {int(k): mine[codes[mine] == k] for k in np.unique(codes[mine])}
        groups.append((by_mask, by_code))
    found = [np.empty((0, 2), np.int64)]
    for part in range(parts):
        target = salt + part * salts
        values, owners = [], []
        for by_mask, by_code in groups:
            for code, mine in by_code.items():
                masks = by_mask.get(code ^ target)
                if masks is not None:
                    values.append((tails[mine][:, None] ^ masks[None, :]).ravel())
                    owners.append(np.repeat(mine, len(masks)))
        if values:
            found.append(_shared(np.concatenate(values), np.concatenate(owners), fps))
    pairs = np.unique(np.concatenate(found), axis=0)
    label = np.arange(len(fps))
    while True:  # the smallest index of each local group
        least = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], least)
        np.minimum.at(new, pairs[:, 1], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    hung = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([hung, label[hung]], 1)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) over distinct fingerprints (fp) that connect exactly those which chains
    of distances of four or less connect."""
    n = fps.count()
    bits = min(24, max(8, (n // FEW).bit_length()))
    masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(bits, HALF)])
    own = F.shiftrightunsigned("fp", 64 - bits)
    touched = F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m)))
    sizes = fps.select(own.alias("own")).groupBy("own").count().select(
        "count", touched.alias("prefix")).groupBy("prefix").agg(F.sum("count").alias("size"))
    salts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("size") / CROWD, F.lit(1.0)))))
    sizes = sizes.select("prefix", F.least(salts, F.lit(1 << 12)).cast("int").alias("salts"))
    dealt = fps.select("fp", own.alias("own")).select("fp", touched.alias("prefix")).join(
        sizes, "prefix").select("fp", "prefix", "salts", F.explode(
            F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fp"].to_numpy(np.int64)
        pairs = meet(values.view(np.uint64), int(key[0]), bits, int(key[1]), int(key[2]))
        return pd.DataFrame({"a": values[pairs[:, 0]], "b": values[pairs[:, 1]]})

    return dealt.groupBy("prefix", "salt", "salts").applyInPandas(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents (doc_id, text).

    Shingles are four words, repeats included; a text of fewer words is one shingle; a null,
    empty or blank text has fingerprint zero and links like any other. Equal fingerprints are
    linked, however many there are: they are one node. ``component_id`` is the smallest
    doc_id reachable, the own one included; a null doc_id is never the smallest, and a
    component of null ids only has a null one. Repeated rows come back repeatedly, other
    columns are ignored, and an empty table gives no rows.
    """
    known = written(fingerprints(docs).drop("text_hash"))
    nodes = written(known.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(nodes.select("fp")))
    # Both written, so that a large group's rows can be split in the join of the two.
    labelled = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")))
    classes = written(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = labelled.join(classes, "root").select("fp", "component_id")
    return known.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, with one row of each group of near-duplicates: the one with the smallest
    doc_id, and of rows with that id the one with the smallest hash of the text. Rows of one id
    in several groups stay once for each. Rows without an id all stay."""
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    nodes = written(fingerprints(docs).groupBy("fp").agg(F.min(row).alias("least")))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    first = nodes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(
        F.min("least").alias("least")).where("least IS NOT NULL").select(
        "least.doc_id", F.col("least.text_hash").alias("_text_hash"))
    key = ["doc_id", "_text_hash"]
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_text_hash", text_hash())
    return named.join(first, key, "left_semi").dropDuplicates(key).select(
        docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
