"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(table: DataFrame) -> DataFrame:
    """Give every core work when a plain scan has fewer splits than there are cores, as
    a single small file has. Anything bigger stays as it is scanned, unshuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
