"""How rows are spread before work that is heavy on the CPU."""

from __future__ import annotations

from pyspark.sql import DataFrame


def on_all_cores(rows: DataFrame) -> DataFrame:
    """A small input, by the size that the plan estimates, spread over the cores; a larger one has splits enough and stays as it
    is. Nothing runs to decide."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    estimate = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if int(str(estimate)) < cores * split else rows
