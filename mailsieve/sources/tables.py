"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cluster if the scan alone cannot occupy it.

    Text functions are bound by CPU. Input that is read in fewer tasks than there are cores, or of which a task
    reads twice its share (a file is split by bytes, but its rows come in whole row groups, so that tasks
    may get none), is shuffled once so that all cores work; other input, however few its files, stays put.
    """
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if tasks >= cores:
        read = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"))  # reads no column
        rows = read.agg(F.max("rows").alias("most"), F.sum("rows").alias("all")).first()
        if not rows["all"] or rows["most"] * cores < 2 * rows["all"]:
            return df
    return df.repartition(max(cores, tasks))
