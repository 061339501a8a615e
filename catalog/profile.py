"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabletools as tt
from tabletools.sources.staging import stage
from catalog.tables import CLEAN_DIRTY_SQL, DIRTY_SQL, dirty, pearson_sql, read, summary_sql, tidy

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
PART = ["p_partkey", "p_size", "p_retailprice"]
GAPPED = ["event_id", "user_id", "value", "sparse", "half"]


def analytics_long(parts: tt.operators.profile.Analytics):
    """(part, name, metric, value) of the scalar parts of an analytics bundle."""
    shape = parts.shape.select(F.lit("shape").alias("part"), F.lit("table").alias("name"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("rows", "columns")])).alias("m"))
    metrics = [c for c in parts.numeric_summary.columns if c != "column"]
    numbers = parts.numeric_summary.select(F.lit("numeric").alias("part"), F.col("column").alias("name"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])).alias("m"))
    nulls = parts.null_counts.select(F.lit("nulls").alias("part"), F.col("column").alias("name"), F.struct(
        F.lit("n_null").alias("metric"), F.col("n_null").cast("double").alias("value")).alias("m"))
    top = parts.categories.select(F.lit("category").alias("part"), F.col("column").alias("name"), F.struct(
        F.col("value").alias("metric"), F.col("n").cast("double").alias("value")).alias("m"))
    return shape.union(numbers).union(nulls).union(top).select("part", "name", "m.metric", "m.value")


def _analytics_sql(with_sql: str, table: str, columns: int, numbers: list[str], texts: list[str],
                   everything: list[str], metrics: list[str]) -> str:
    summary = summary_sql(table, numbers)
    casts = ", ".join(f"{m}::DOUBLE AS {m}" for m in metrics)
    nulls = " UNION ALL ".join(
        f"SELECT 'nulls', '{c}', 'n_null', count(*) FILTER ({c} IS NULL)::DOUBLE FROM {table}" for c in everything)
    return f"""{with_sql}, s AS ({summary}),
n AS (SELECT "column", {casts} FROM s)
SELECT 'shape' AS part, 'table' AS name, 'rows' AS metric, count(*)::DOUBLE AS value FROM {table}
UNION ALL SELECT 'shape', 'table', 'columns', {columns}
{" ".join(f"""UNION ALL SELECT 'numeric', "column", '{m}', {m} FROM n""" for m in metrics)}
UNION ALL {nulls}
UNION ALL SELECT 'category', "column", value, n::DOUBLE FROM ({topk_sql(table, texts)})"""


def topk_sql(table: str, columns: list[str], k: int = 5) -> str:
    counts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in columns)
    return f"""SELECT "column", value, n, rank FROM (SELECT *, row_number() OVER
(PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS rank FROM ({counts})) WHERE rank <= {k}"""


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def _matrix_sql(table: str, columns: list[str], with_sql: str = "") -> str:
    return with_sql + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round({pearson_sql(a, b)}, 6) AS r FROM {table}" for a, b in _pairs(columns))


def _ranked_sql(columns: list[str], table: str) -> str:
    return "WITH m AS (" + " UNION ALL ".join(
        f"SELECT {i} AS pos, '{a}' AS a, '{b}' AS b, {pearson_sql(a, b)} AS r FROM {table}"
        for i, (a, b) in enumerate(_pairs(columns))) + \
        "), ranked AS (SELECT a, b, r, row_number() OVER (ORDER BY round(abs(r), 12) DESC, pos)::INTEGER AS rank FROM m WHERE r IS NOT NULL)"


def _null_rows_sql(table: str, columns: list[str], with_sql: str = "") -> str:
    return with_sql + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_null FROM {table}""" for c in columns)


DIRTY_COLUMNS = ["event_id", "user_id", "value", "event_type", "sparse", "half", "d_ok", "d_rate", "d_fail"]
_SUMMARY = ["mean", "std", "min", "max", "median", "skew", "kurtosis", "q25", "q75", "non_null_count"]
_RAW_SUMMARY = ["mean", "std", "min", "max", "median", "skew", "non_null_count"]

# more numeric columns than go by single sums
WIDE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                "o_custkey", "o_totalprice", "p_size", "p_retailprice", "gapped", "spread"]
WIDE = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, o_custkey, o_totalprice,
  p_size, p_retailprice, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity * l_discount END AS gapped, l_extendedprice - p_retailprice AS spread
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"""


def _wide(s, d):
    return tt.stage(s.sql(WIDE, **{t: read(s, d, t) for t in ("lineitem", "orders", "part")}), "wide")


# two hundred numbers for each part
MANY = [f"CAST((p_partkey * {i + 3}) % {i + 101} + p_size * {i % 5} AS DOUBLE) + p_retailprice * {i % 3} AS c{i}" for i in range(200)]


def _many(s, d):
    return tt.stage(s.sql("SELECT " + ", ".join(MANY) + " FROM {part}", part=read(s, d, "part")), "many")


_MANY_SQL = "WITH many AS (SELECT row_number() OVER () AS nth, " + ", ".join(MANY) + """ FROM part),
long AS (SELECT nth, c[2:]::INTEGER AS i, v FROM (UNPIVOT many ON COLUMNS(* EXCLUDE nth) INTO NAME c VALUE v)),
pairs AS (SELECT x.i, y.i AS j, corr(x.v, y.v) AS r FROM long x JOIN long y ON x.nth = y.nth AND x.i < y.i GROUP BY ALL)
"""


QUERIES = {
    "numeric_summary": lambda s, d: tt.numeric_summary(read(s, d, "lineitem")),
    "numeric_summary_documents": lambda s, d: tt.numeric_summary(read(s, d, "documents")),
    "numeric_summary_gaps": lambda s, d: tt.numeric_summary(dirty(s, d)),
    "raw_numeric_summary": lambda s, d: tt.raw_numeric_summary(dirty(s, d)),
    "table_shape": lambda s, d: tt.table_shape(read(s, d, "lineitem")),
    "select_kind_numeric": lambda s, d: tt.select_kind(read(s, d, "part"), "numeric"),
    "select_kind_categorical": lambda s, d: tt.select_kind(read(s, d, "orders"), "categorical"),
    "null_counts": lambda s, d: tt.null_counts(dirty(s, d)),
    "null_counts_nested": lambda s, d: tt.null_counts(read(s, d, "embeddings")),
    "missing_profile": lambda s, d: tt.missing_profile(dirty(s, d)),
    "correlation_matrix": lambda s, d: tidy(tt.correlation_matrix(read(s, d, "lineitem"))),
    "correlation_matrix_wide": lambda s, d: tidy(tt.correlation_matrix(_wide(s, d))),
    "correlation_matrix_many": lambda s, d: tidy(tt.correlation_matrix(_many(s, d))),
    "correlation_pairs_many": lambda s, d: tt.correlation_pairs(_many(s, d), 0.45).select("a", "b", "r"),
    "correlation_matrix_gaps": lambda s, d: tidy(tt.correlation_matrix(dirty(s, d))),
    "correlation_pairs": lambda s, d: tt.correlation_pairs(read(s, d, "part")),
    "strongest_pair": lambda s, d: tt.strongest_pair(read(s, d, "part")),
    "category_topk": lambda s, d: tt.category_topk(read(s, d, "customer")),
    "category_topk_pages": lambda s, d: tt.category_topk(read(s, d, "pages").select("url")),
    "category_topk_texts": lambda s, d: tt.category_topk(read(s, d, "conversations")),
    "category_topk_documents": lambda s, d: tt.category_topk(read(s, d, "documents"), 20),
    "category_topk_html": lambda s, d: tt.category_topk(read(s, d, "pages")),
    "anomaly_flags": lambda s, d: tt.anomaly_flags(dirty(s, d)),
    "profile_text": lambda s, d: tt.profile_text(read(s, d, "part"), "part"),
    "compute_analytics": lambda s, d: analytics_long(tt.compute_analytics(stage(tt.drop_exact_duplicates(dirty(s, d)), "dirty"))),
    "raw_analytics": lambda s, d: analytics_long(tt.raw_analytics(dirty(s, d))),
    "kpi_summary": lambda s, d: tt.kpi_summary(read(s, d, "part")),
}

_anomalies = " UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", 'high_skew' AS flag FROM dirty HAVING count({c}) > 2 AND min({c}) < max({c}) AND abs(skewness({c})) > 1
""" for c in GAPPED]
    + [f"SELECT '{c}', 'constant' FROM dirty HAVING min({c}) = max({c})" for c in DIRTY_COLUMNS]
    + [f"SELECT '{c}', 'has_nulls' FROM dirty HAVING count({c}) < count(*)" for c in DIRTY_COLUMNS])

_profile_text = _ranked_sql(PART, "part") + """, s AS (""" + summary_sql("part", PART) + """),
strong AS (SELECT a, b, r, rank FROM ranked WHERE abs(r) > 0.3),
top AS (""" + topk_sql("part", ["p_name", "p_brand", "p_type"]) + """),
parts(block, seq, line) AS (
  SELECT 1, 1, '=== Data Context: part ===' UNION ALL SELECT 1, 2, ''
  UNION ALL SELECT 2, 1, 'Shape: ' || count(*) || ' rows × 6 columns' FROM part
  UNION ALL SELECT 2, 2, 'Columns: p_partkey, p_name, p_brand, p_type, p_size, p_retailprice' UNION ALL SELECT 2, 3, ''
  UNION ALL SELECT 3, 1, 'Data Types:' UNION ALL SELECT 3, 2, '  p_partkey: bigint' UNION ALL SELECT 3, 3, '  p_name: string'
  UNION ALL SELECT 3, 4, '  p_brand: string' UNION ALL SELECT 3, 5, '  p_type: string' UNION ALL SELECT 3, 6, '  p_size: int'
  UNION ALL SELECT 3, 7, '  p_retailprice: double' UNION ALL SELECT 3, 8, ''
  UNION ALL SELECT 4, 0, 'Numeric Summary (mean | std | min | max | skew):'
  UNION ALL SELECT 4, list_position(['p_partkey', 'p_size', 'p_retailprice'], "column"),
    '  ' || "column" || ': mean=' || mean || ' | std=' || std || ' | min=' || min || ' | max=' || max || ' | skew=' || (skew + 0.0) FROM s
  UNION ALL SELECT 4, 9, ''
  UNION ALL SELECT 5, 1, 'Missing Values: none' UNION ALL SELECT 5, 2, ''
  UNION ALL SELECT 6, 0, CASE WHEN count(*) = 0 THEN 'Correlations: no pairs with |r| > 0.3' ELSE 'Correlations (|r| > 0.30):' END FROM strong
  UNION ALL SELECT 6, rank, '  ' || a || ' × ' || b || ': r=' || round(r, 3) FROM strong
  UNION ALL SELECT 6, 99, ''
  UNION ALL SELECT 7, 0, 'Categorical Columns (top 5 values each):'
  UNION ALL SELECT 7, list_position(['p_name', 'p_brand', 'p_type'], "column"),
    '  ' || "column" || ': ' || string_agg('''' || value || ''':' || n, ', ' ORDER BY rank) FROM top GROUP BY "column"
  UNION ALL SELECT 7, 99, ''
  UNION ALL SELECT 8, 1, '=== End of Data Context ===')
SELECT row_number() OVER (ORDER BY block, seq)::INTEGER AS line_no, line FROM parts"""

_kpis = _ranked_sql(PART, "part") + """, strong AS (SELECT a, b, r, rank FROM ranked WHERE abs(r) > 0.3)
SELECT 1 AS seq, 'dataset' AS section, 'Rows' AS label, format('{:,}', count(*)) AS value FROM part
UNION ALL SELECT 2, 'dataset', 'Columns', '6' UNION ALL SELECT 3, 'dataset', 'Numeric Cols', '3'
UNION ALL SELECT 4, 'dataset', 'Missing Values', '0'
UNION ALL SELECT 4 + rank, 'correlation', a || '×' || b, format('{:+.3f}', r) FROM strong"""

ORACLES = {
    "numeric_summary": summary_sql("lineitem", LINEITEM),
    "numeric_summary_documents": summary_sql("documents", ["doc_id", "n_chars"]),
    "numeric_summary_gaps": summary_sql("dirty", GAPPED, DIRTY_SQL),
    "raw_numeric_summary": DIRTY_SQL + ' SELECT "column", mean, std, min, max, median, skew, non_null_count FROM ('
        + summary_sql("dirty", GAPPED) + ")",
    "table_shape": 'SELECT count(*) AS "rows", 11::BIGINT AS "columns" FROM lineitem',
    "select_kind_numeric": "SELECT p_partkey, p_size, p_retailprice FROM part",
    "select_kind_categorical": "SELECT o_orderstatus, o_orderpriority FROM orders",
    "null_counts": _null_rows_sql("dirty", DIRTY_COLUMNS, DIRTY_SQL + " "),
    "null_counts_nested": _null_rows_sql("embeddings", ["vec_id", "embedding", "label"]),
    "missing_profile": DIRTY_SQL + " SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_null,
round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 1) AS pct FROM dirty""" for c in DIRTY_COLUMNS) + ") WHERE n_null > 0",
    "correlation_matrix": _matrix_sql("lineitem", LINEITEM),
    "correlation_matrix_wide": _matrix_sql("wide", WIDE_COLUMNS, "WITH wide AS (" + WIDE.format(
        lineitem="lineitem", orders="orders", part="part") + ")"),
    "correlation_matrix_many": _MANY_SQL + "SELECT 'c' || i AS a, 'c' || j AS b, round(r, 6) AS r FROM pairs",
    "correlation_pairs_many": _MANY_SQL + "SELECT 'c' || i AS a, 'c' || j AS b, round(r, 3) AS r FROM pairs WHERE abs(r) > 0.45",
    "correlation_matrix_gaps": _matrix_sql("dirty", GAPPED, DIRTY_SQL),
    "correlation_pairs": _ranked_sql(PART, "part") + " SELECT rank, a, b, round(r, 3) AS r FROM ranked WHERE abs(r) > 0.3",
    "strongest_pair": _ranked_sql(PART, "part") + " SELECT a, b FROM ranked WHERE rank = 1",
    "category_topk": topk_sql("customer", ["c_name", "c_mktsegment"]),
    "category_topk_pages": topk_sql("pages", ["url"]),
    "category_topk_texts": topk_sql("conversations", ["role", "text"]),
    "category_topk_documents": topk_sql("documents", ["text", "lang", "source"], 20),
    "category_topk_html": topk_sql("pages", ["url", "html"]),
    "anomaly_flags": DIRTY_SQL + " " + _anomalies,
    "profile_text": _profile_text,
    "compute_analytics": _analytics_sql(CLEAN_DIRTY_SQL, "d", 9, GAPPED, ["event_type", "d_ok", "d_rate", "d_fail"],
                                        DIRTY_COLUMNS, _SUMMARY),
    "raw_analytics": _analytics_sql(DIRTY_SQL, "dirty", 9, GAPPED, ["event_type", "d_ok", "d_rate", "d_fail"],
                                    DIRTY_COLUMNS, _RAW_SUMMARY),
    "kpi_summary": _kpis,
}
