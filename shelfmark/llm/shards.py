"""Shards of equal size that keep linked documents together: balanced label propagation.

Documents with equal texts are linked. Every round, each group of linked documents looks at
the shards its members are in and its members ask to move to the commonest one. Moves are
granted under quotas that keep every shard's number of rows what it was: as many rows leave a
shard for another as come back from there, and where the other side has too few that want to
come, documents without links fill the gap. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import written

SHARDS = 24
ROUNDS = 5  # at most; it stops when nothing asks to move
LANES = 64  # for numbering all rows
TASK_ROWS = 50_000  # rows that are numbered together, at most about
LEAST_PARTS = 16  # a shard is dealt to so many parts at least
LAW = "rows"  # counts of rows differ by one at most


def numbered(rows: DataFrame, keys: list[str], parts: int, name: str) -> DataFrame:
    """``rows`` with their number within ``keys``, gapless from 0. Each key is dealt into
    ``parts`` by a hash of the row, so that no task numbers a whole key; the parts' offsets
    come from their counts."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_part").count().select(
        *keys, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("row")) - 1
    return dealt.withColumn("_within", within).join(offsets, [*keys, "_part"]).withColumn(
        name, F.col("_offset") + F.col("_within")).drop("_part", "_offset", "_within")


def grant(asked: dict[tuple[int, int], int], free: dict[int, int],
          shards: int) -> tuple[list[int], list[int]]:
    """Quotas from the counts of rows that ask to move from a to b, and of rows without links
    in each shard: how many a -> b moves are granted, and for every shard b up to which number
    its rows without links go to each a (running sums); both as flat shards x shards lists."""
    granted, upto = [0] * shards ** 2, [0] * shards ** 2
    for b in range(shards):
        lack = [max(0, asked.get((a, b), 0) - asked.get((b, a), 0)) for a in range(shards)]
        total, supply, run = sum(lack), free.get(b, 0), 0
        for a in range(shards):
            filled = lack[a] if total <= supply else lack[a] * supply // total
            granted[a * shards + b] = min(asked.get((a, b), 0), asked.get((b, a), 0)) + filled
            run += filled
            upto[b * shards + a] = run
    return granted, upto


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def propagate(rows: DataFrame, shards: int, parts: int) -> DataFrame | None:
    """One round over (row, community, shard), where community is null for rows without
    links; None if nothing can move. Counts of every shard stay the same."""
    linked = rows.where("community IS NOT NULL")
    free = dict(rows.where("community IS NULL").groupBy("shard").count().collect())
    room = F.get(_literal([free.get(s, 0) for s in range(shards)]), F.col("shard"))
    # Ties go by a hash, rather to shards with many rows that can make way.
    tie = room * (F.pmod(F.xxhash64("community", "shard"), F.lit(1000)) + 1)
    weight = F.struct("count", tie.alias("tie"), "shard")
    aims = written(linked.groupBy("community", "shard").count().groupBy("community").agg(
        F.max(weight).alias("w")).select("community", F.col("w.shard").alias("aim")))
    aimed = linked.join(aims, "community").select("row", "community", "shard", "aim").unionByName(
        rows.where("community IS NULL").withColumn("aim", F.col("shard")))
    state = written(aimed.withColumn("key", F.when(
        F.col("community").isNull(), F.col("shard")).when(
        F.col("aim") != F.col("shard"), shards + F.col("shard") * shards + F.col("aim"))))
    counts = dict(state.where("key IS NOT NULL").groupBy("key").count().collect())
    asked = {divmod(k - shards, shards): n for k, n in counts.items() if k >= shards}
    granted, upto = grant(asked, free, shards)
    if not any(granted):  # counts of pairs of shards, so at most shards * shards numbers
        return None
    moving = numbered(state.where("key IS NOT NULL"), ["key"], parts, "n")
    limits = F.slice(_literal(upto), F.col("shard") * shards + 1, shards)
    goes_to = F.size(F.filter(limits, lambda x: x <= F.col("n")))
    filler = F.col("community").isNull() & (goes_to < shards)
    wins = F.col("community").isNotNull() & (
        F.col("n") < F.get(_literal(granted), F.col("key") - shards))
    moved = moving.select("row", "community", F.when(filler, goes_to).when(
        wins, F.col("aim")).otherwise(F.col("shard")).cast("int").alias("shard"))
    return written(moved.unionByName(
        state.where("key IS NULL").select("row", "community", "shard")))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row for every row of documents (doc_id, text): doc_id, size (UTF-8 bytes of the text
    and 8), text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null: the
    law is ``rows``).

    Counts of rows differ by one at most between shards. A group of equal texts that is larger
    than half a shard is cut into pieces of about that size first. A null text has size 8 and
    equals an empty one. Repeated rows are rows of their own, null ids are allowed, ties go by
    a hash, other columns are ignored, an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    base = written(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("text_md5")).withColumn(
        "row", F.monotonically_increasing_id()))
    n = base.count()
    parts = -(-n // TASK_ROWS)
    half = max(1, n // (2 * shards))
    # Written, so that the rows of a hot text can be split in the join.
    groups = written(base.groupBy("text_md5").count().where("count > 1").select(
        "text_md5", F.ceil(F.col("count") / half).alias("cuts")))
    piece = F.pmod(F.xxhash64("row", F.lit(1)), F.col("cuts"))
    linked = base.select("row", "text_md5").join(groups, "text_md5", "left").select(
        "row", F.when(F.col("cuts").isNotNull(), F.xxhash64("text_md5", piece)).alias("community"))
    lanes = linked.withColumn("lane", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(LANES)))
    lanes = written(numbered(lanes, ["lane"], max(1, parts // LANES), "n"))
    sizes, heads = dict(lanes.groupBy("lane").count().collect()), [0]  # LANES numbers
    for lane in range(LANES - 1):
        heads.append(heads[-1] + sizes.get(lane, 0))
    place = F.get(_literal(heads), F.col("lane").cast("int")) + F.col("n")
    rows = lanes.select("row", "community", F.pmod(place, F.lit(shards)).cast("int").alias("shard"))
    per_shard = max(LEAST_PARTS, parts // shards)
    for _ in range(rounds):
        moved = propagate(rows, shards, per_shard)
        if moved is None:
            break
        rows = moved
    slots = numbered(rows.select("row", "shard"), ["shard"], per_shard, "slot")
    return base.join(slots, "row").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
