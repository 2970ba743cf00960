"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Texts are handed to Python in batches of at most so many bytes, so that a run of very
# long texts does not fill a worker.
BATCH_BYTES = 32 << 20


def map_batches(df: DataFrame, schema: str | StructType,
                work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``work`` applied to every Arrow batch of ``df``, without a shuffle."""
    return map_stream(df, schema, lambda batches: (work(b) for b in batches))


def map_stream(df: DataFrame, schema: str | StructType, work: Callable[[Iterator], Iterator]) -> DataFrame:
    """``work`` applied to the stream of Arrow batches of every partition."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(work, schema)


def _filled(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; a null text is empty."""
    return _filled(batch.column(name))


def with_columns_from_text(docs: DataFrame, keep: list[str], added: list[tuple[str, str]],
                           work: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """(_row, added...): the columns ``keep`` of every row as a struct, whatever their names
    are, and columns (name, type) that ``work`` makes from the texts. Nothing is shuffled and
    each text is handed over once."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                       *([] if "text" in keep else [F.col("text").alias("_text")]))
    schema = StructType([rows.schema["_row"]])
    for name, kind in added:
        schema = schema.add(name, kind)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column("_row")
        found = texts(batch, "_text") if "_text" in batch.schema.names else _filled(row.field("text"))
        return pa.RecordBatch.from_arrays([row, *work(found)], ["_row", *(n for n, _ in added)])

    return map_batches(rows, schema, one)
