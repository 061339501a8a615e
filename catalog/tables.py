"""The given tables, and tables derived from them, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the order of a distributed sum decides its last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ``events`` with nulls, duplicates, a sparse column and dates in text
DIRTY = """
b AS (
  SELECT event_id, user_id,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 3 = 0 THEN value END AS sparse,
    CASE WHEN event_id % 2 = 0 THEN value END AS half,
    CASE WHEN event_id % 10 = 1 THEN 'n/a' ELSE substr(cast(ts AS varchar(40)), 1, 10) END AS d_ok,
    CASE WHEN event_id % 10 < 3 THEN 'n/a' ELSE substr(cast(ts AS varchar(40)), 1, 10) END AS d_rate,
    CASE WHEN event_id % 4 = 0 THEN '2024-13-01' ELSE substr(cast(ts AS varchar(40)), 1, 10) END AS d_fail
  FROM {events}),
dirty AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE event_id % 50 = 0)"""

DIRTY_SQL = "WITH" + DIRTY.format(events="events")
CLEAN_DIRTY_SQL = DIRTY_SQL + ",\nd AS (SELECT DISTINCT * FROM dirty)"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = DIRTY.replace("varchar(40)", "string")
    return spark.sql("WITH" + text + " SELECT * FROM dirty", events=read(spark, sf_dir, "events"))


def summary_sql(table: str, columns: list[str], with_sql: str = "") -> str:
    """numeric_summary in DuckDB, one SELECT per column. Rounded twice: first away from noise."""
    def metric(expr: str) -> str:
        return f"round(round({expr}, 9), 3)"

    parts = []
    for c in columns:
        moment = "CASE WHEN count({c}) < {n} THEN NULL WHEN min({c}) = max({c}) THEN 0.0 ELSE {f}({c}) END"
        parts.append(f"""SELECT '{c}' AS "column", {metric(f'avg({c})')} AS mean, {metric(f'stddev_samp({c})')} AS std,
  round(min({c})::DOUBLE, 3) AS min, round(max({c})::DOUBLE, 3) AS max,
  {metric(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median,
  {metric(moment.format(c=c, n=3, f='skewness'))} AS skew,
  {metric(moment.format(c=c, n=4, f='kurtosis'))} AS kurtosis,
  {metric(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q25, {metric(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q75,
  count({c}) AS non_null_count FROM {table}""")
    return with_sql + "\n" + "\nUNION ALL\n".join(parts)


def pearson_sql(a: str, b: str) -> str:
    """corr over the complete rows, NULL where either side is constant."""
    return f"CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END"
