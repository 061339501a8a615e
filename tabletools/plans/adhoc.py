"""Ad-hoc questions on loaded tables, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ask_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """The answer as a table. ``{name}`` in the SQL stands for a table; no view outlives the query."""
    return spark.sql(sql, **tables)
