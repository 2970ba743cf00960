"""Session helpers: the shared folder, written steps and the size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it is counted and lies under both bounds.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach; a local one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = "file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there. It is computed
    once, and stays what it is when an executor is lost, also where its values depend on
    the physical layout. The files stay until the folder is cleaned."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Size:
    """Rows and bytes, measured or proven as an upper bound."""

    rows: int
    bytes: int

    def times(self, other: Size) -> Size:
        """Bound for a join of the two sides."""
        return Size(self.rows * other.rows,
                    self.bytes * other.rows + other.bytes * self.rows)

    def fits(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES


def size_columns(df: DataFrame) -> list[Column]:
    """Aggregates for the rows of ``df`` and their bytes, written as JSON."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")]


def measured(df: DataFrame) -> Size:
    return Size(*df.agg(*size_columns(df)).first())


def broadcast_within(df: DataFrame, size: Size) -> DataFrame:
    """``df`` with a broadcast hint if ``size`` is small. Otherwise without one: the join
    is a shuffle join then, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if size.fits() else df


PAIRS_IN_A_TASK = 5_000_000


def by_document(rows: DataFrame, pairs: int, in_a_task: int = PAIRS_IN_A_TASK) -> DataFrame:
    """``rows`` laid out by document (volume, path): what is grouped by document and more
    stays there. The number of partitions is fixed, since the bytes shuffled do not tell the
    ``pairs`` of queries and documents that the rows grow to; these bound it."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, min(pairs // in_a_task, 20 * usual)), "volume", "path")


def small_side(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it is measured to be small. Measuring runs ``df``: meant for
    the query side, the change side and dimension tables, never for the corpus or the
    postings."""
    return broadcast_within(df, measured(df))
