"""Source and sink queries: each writes a given table to the shared folder and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tabletools as tt
from catalog.cleaning import CLEANED, FILLED
from catalog.tables import dirty, pearson_sql, read
from tabletools.sources.staging import staging_path


def _csv(s, df, label):
    path = staging_path(s, label) + ".csv"
    tt.write_csv_table(df, path)
    return path


def _large_files_csv(s, d):
    """Files of more than one split each. A task writes a file, so it gets two splits of the given table: a small table is one file, a
    larger one several, and no task reads more than these."""
    table = read(s, d, "documents")
    split = s._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return _csv(s, table.select("doc_id", "text", "source").coalesce(max(1, -(-size // (2 * split)))), "one-file")


def _orders_csv(s, d):
    return _csv(s, read(s, d, "orders"), "orders")


def _gapped_csv(s, d):
    """Whole numbers, booleans and texts with several words for a missing value."""
    return _csv(s, s.sql(GAPPED, events=read(s, d, "events")), "gapped")


def _two_encodings(s, d):
    """One folder, half of its customers in UTF-8 and half in Latin-1, some records over two lines in the second."""
    path = staging_path(s, "encodings") + ".csv"
    named = s.sql(ACCENTED.replace("@text", "string"), customer=read(s, d, "customer"))
    for rest, charset in ((0, "UTF-8"), (1, "ISO-8859-1")):
        named.where(F.col("c_custkey") % 2 == rest).write.mode("append").csv(
            path, header=True, quote='"', escape='"', encoding=charset)
    return tt.read_csv_table(s, path)


ACCENTED = """SELECT c_custkey, concat('café ', c_name, CASE WHEN c_custkey % 10 = 1 THEN concat(chr(10), 'ü') ELSE '' END) AS c_name,
  c_mktsegment FROM {customer}"""


GAPPED = """SELECT CAST(event_id AS {t}) AS event_id,
  CASE event_id % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '#N/A' ELSE CAST(user_id AS {t}) END AS user_id,
  CASE WHEN event_id % 5 = 0 THEN 'NaN' ELSE CAST(value AS {t}) END AS value,
  CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'True' ELSE 'false' END AS flag,
  CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE props END AS props,
  'None' AS nothing FROM {events}""".replace("{t}", "string")


def _analysed(s, d):
    """All steps on one table, with a model; a row per result table and the charts that were chosen."""
    result = tt.analyse_table(dirty(s, d), "dirty", target="event_type", task="classification", keys=["event_id"])
    tables = {name: table for name, table in result.tables().items() if name not in ("charts", "metrics")}
    sizes = [t.agg(F.count("*").cast("int").alias("rank")).select("rank", F.lit("table").alias("chart_type"), F.lit(None).cast("string").alias("x_axis"),
                                                    F.lit(None).cast("string").alias("y_axis"), F.lit(name).alias("title"))
             for name, t in tables.items() if name in ("cleaned", "importances", "analytics_shape")]
    model = result.metrics.select((F.col("train_samples") + F.col("test_samples")).cast("int"), F.lit("model"), "target_column",
                                  F.col("error"), F.lit("metrics"))
    return reduce(DataFrame.union, [result.charts.select("rank", "chart_type", "x_axis", "y_axis", "title"), *sizes, model])


def _saved(s, d):
    """A whole run saved and read back: a row per column of each small result table."""
    path = staging_path(s, "results")
    tt.analyse_table(read(s, d, "part"), "part").save(path)
    return s.read.parquet(f"{path}/analytics_null_counts").unionByName(
        s.read.parquet(f"{path}/cleaned").agg(F.lit("rows").alias("column"), F.count("*").alias("n_null")))


def _published(s, d):
    """Two runs under one path and a third that fails before its last table: readers see the second."""
    path, part = staging_path(s, "published"), read(s, d, "part")
    tt.publish_results({"rows": part.limit(0), "sizes": part.groupBy("p_size").count()}, path)
    tt.publish_results({"rows": part, "sizes": part.groupBy("p_size").count()}, path)
    try:
        tt.publish_results({"rows": part.limit(1), "sizes": part.select(F.raise_error(F.lit("fails")).alias("e"))}, path)
    except Exception:
        pass
    tables = tt.read_results(s, path)
    return tables["sizes"].select(F.lit("sizes").alias("part"), F.col("count").alias("n")).unionByName(
        tables["rows"].agg(F.lit("rows").alias("part"), F.count("*").alias("n")))


def _loaded(s, d, suffix):
    path = staging_path(s, "nation-customers") + "." + suffix
    getattr(read(s, d, "customer").write, suffix)(path)
    return tt.load_table(s, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


QUERIES = {
    "read_csv_table_encodings": _two_encodings,
    "read_csv_table": lambda s, d: tt.read_csv_table(s, _orders_csv(s, d)),
    "read_csv_table_lines": lambda s, d: tt.read_csv_table(
        s, _csv(s, read(s, d, "documents").select("doc_id", "text"), "documents")),
    "read_csv_table_one_file": lambda s, d: tt.read_csv_table(s, _large_files_csv(s, d)),
    "load_table_lines": lambda s, d: tt.load_table(s, _csv(s, read(s, d, "conversations"), "conversations")),
    "infer_types": lambda s, d: tt.infer_types(tt.read_csv_table(s, _gapped_csv(s, d))),
    "dtype_map": lambda s, d: tt.dtype_map(tt.infer_types(tt.read_csv_table(s, _gapped_csv(s, d)))),
    "load_table_csv": lambda s, d: tt.load_table(s, _orders_csv(s, d)),
    "load_table_json": lambda s, d: _loaded(s, d, "json"),
    "load_table_orc": lambda s, d: _loaded(s, d, "orc"),
    "load_table_parquet": lambda s, d: tt.load_table(s, f"{d.rstrip('/')}/part.parquet"),
    "write_csv_table": lambda s, d: tt.load_table(s, _csv(s, read(s, d, "lineitem"), "lineitem")),
    "save_results": _saved,
    "publish_results": _published,
    "preview": lambda s, d: tt.preview(read(s, d, "part"), 5, ["p_partkey"]),
    "ask_sql": lambda s, d: tt.ask_sql(s, {"data": read(s, d, "customer"), "nation": read(s, d, "nation"),
                                           "region": read(s, d, "region")}, ASK),
    "analyse_table": _analysed,
}

ASK = """SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM {data} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY r_name, n_name"""

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"

_NUMBERS = ["event_id", "user_id", "value", "half"]
_PAIRS = " UNION ALL ".join(
    f"SELECT {4 * i + j} AS i, '{a}' AS a, '{b}' AS b, {pearson_sql(a, b)} AS r FROM c"
    for i, a in enumerate(_NUMBERS) for j, b in enumerate(_NUMBERS) if i < j)

ORACLES = {
    "read_csv_table_encodings": "SELECT c_custkey::VARCHAR AS c_custkey, * EXCLUDE (c_custkey) FROM ("
        + ACCENTED.format(customer="customer") + ")",
    "analyse_table": FILLED + ", c AS (" + CLEANED.format(rows="f") + "), p AS (" + _PAIRS + """)
SELECT 1 AS rank, 'histogram' AS chart_type, 'event_id' AS x_axis, NULL AS y_axis, 'Distribution of event_id' AS title
UNION ALL SELECT 2, 'bar', 'event_type', 'event_id', 'event_id by event_type'
UNION ALL SELECT 3, 'heatmap', NULL, NULL, 'Numeric Correlation Heatmap'
UNION ALL SELECT 4, 'scatter', a, b, a || ' vs ' || b FROM (SELECT * FROM p WHERE r IS NOT NULL ORDER BY abs(r) DESC, i LIMIT 1)
UNION ALL SELECT 5, 'box', 'event_type', 'user_id', 'user_id Distribution by event_type'
UNION ALL SELECT 6, 'line', 'd_ok', 'event_id', 'event_id Over Time (d_ok)'
UNION ALL SELECT count(*)::INTEGER, 'table', NULL, NULL, 'cleaned' FROM c
UNION ALL SELECT (SELECT count(*) FROM (SELECT unnest([count(DISTINCT d_rate), count(DISTINCT d_fail)]) AS n FROM c) WHERE n <= 50)::INTEGER + 4,
  'table', NULL, NULL, 'importances'
UNION ALL SELECT 1, 'table', NULL, NULL, 'analytics_shape'
UNION ALL SELECT count(*)::INTEGER, 'model', 'event_type', NULL, 'metrics' FROM c""",
    "read_csv_table": """SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
  o_totalprice::VARCHAR AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate, o_orderpriority FROM orders""",
    "read_csv_table_one_file": "SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text, source FROM documents",
    "read_csv_table_lines": "SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text FROM documents",
    "load_table_lines": "SELECT * FROM conversations",
    "infer_types": """SELECT event_id, CASE WHEN event_id % 4 > 1 THEN user_id END AS user_id,
  CASE WHEN event_id % 5 > 0 THEN value END AS value,
  CASE event_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS flag,
  CASE WHEN event_id % 6 > 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 > 0 THEN props END AS props, NULL::DOUBLE AS nothing FROM events""",
    "dtype_map": """SELECT * FROM (VALUES (0, 'event_id', 'bigint', 'numeric'), (1, 'user_id', 'bigint', 'numeric'),
  (2, 'value', 'double', 'numeric'), (3, 'flag', 'boolean', 'boolean'), (4, 'event_type', 'string', 'categorical'),
  (5, 'props', 'string', 'categorical'), (6, 'nothing', 'double', 'numeric')) v("position", "column", dtype, kind)""",
    "load_table_csv": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::VARCHAR AS o_orderdate,
  o_orderpriority FROM orders""",
    "load_table_json": _CUSTOMER,
    "load_table_orc": _CUSTOMER,
    "load_table_parquet": "SELECT * FROM part",
    "write_csv_table": "SELECT * REPLACE (l_shipdate::VARCHAR AS l_shipdate) FROM lineitem",
    "publish_results": "SELECT 'sizes' AS part, count(*) AS n FROM part GROUP BY p_size UNION ALL SELECT 'rows', count(*) FROM part",
    "save_results": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null FROM part"""
        for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
        + " UNION ALL SELECT 'rows', count(*) FROM part",
    "preview": "SELECT * FROM part ORDER BY p_partkey LIMIT 5",
    "ask_sql": ASK.format(data="customer", nation="nation", region="region"),
}
