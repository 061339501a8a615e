"""One SQL statement on a database, read as a table.

Without a partition column one task reads the whole result over one connection, ``FETCH_ROWS`` rows at a time; give
one (with bounds and a number of slices) for a result that one task should not read alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabletools.sources.staging import stage


FETCH_ROWS = 10_000
LOGIN_SECONDS = 10


def postgres_url(host: str, port: str | int, database: str) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def jdbc_options(url: str, query: str, user: str = "", password: str = "",
                 partition_column: str | None = None, lower=None, upper=None,
                 partitions: int | None = None, **extra: str) -> dict[str, str]:
    """Reader options. With a partition column the query is read in parallel slices."""
    statement = query.strip().rstrip(";").strip()
    if not url or not statement:
        raise ValueError("A JDBC URL and a query are needed.")
    options = {"url": url, "fetchsize": str(FETCH_ROWS), "loginTimeout": str(LOGIN_SECONDS), **extra}
    if user:
        options |= {"user": user, "password": password}
    if partition_column is None:
        return options | {"query": statement}
    if lower is None or upper is None or not partitions:
        raise ValueError("A partition column needs lower, upper and partitions.")
    return options | {
        "dbtable": f"({statement}) t", "partitionColumn": partition_column,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}


def read_sql_query(spark: SparkSession, url: str, query: str, staged: bool = True, **options) -> DataFrame:
    """The result of the statement; loading resolves the schema, so it also tests the connection.

    The rows are fetched once and staged, so that later jobs do not run the query again.
    """
    table = spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
    return stage(table, "queried") if staged else table
