"""Inputs of few files over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes from fewer files than there are cores and is small for them.

    A file may be a single row group, which is one task whatever its splits; larger inputs have enough of them.
    """
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * split or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
