"""Tables of texts, spread over all cores even if they lie in few large pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores is dealt out evenly; any other stays as it is.

    A small table is often one file with one row group, which one task reads
    whatever the number of splits; its rows would be worked on by one core.
    Large tables have more splits than cores, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
