"""The change feed as a batch table or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def changes_since(changes: DataFrame, start: str | Column) -> DataFrame:
    """Changes after ``start``. A plain comparison, so parquet applies it to row groups.
    Works on a batch table and on a stream."""
    moment = F.lit(start).cast(changes.schema["ts"].dataType) if isinstance(start, str) \
        else start
    return changes.filter(F.col("ts") > moment)


def follow_table(spark: SparkSession, folder: str, schema: str | StructType,
                 file_glob: str | None = None, files_per_batch: int | None = None
                 ) -> DataFrame:
    """Stream over a folder of parquet files: first what is there, then what arrives.
    The checkpoint of the query remembers what was read, also across restarts."""
    reader = spark.readStream.schema(schema)
    if file_glob is not None:
        reader = reader.option("pathGlobFilter", file_glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
