"""Chart choice and chart data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabletools as tt
from catalog.tables import pearson_sql, read, tidy

# one chart spec per part: some of an unknown type, some on a column that does not exist
SPECS = """SELECT p_partkey AS id,
  CASE p_partkey % 4 WHEN 0 THEN ' Bar ' WHEN 1 THEN 'PIE' WHEN 2 THEN 'radar' ELSE 'violin' END AS chart_type,
  CASE p_partkey % 3 WHEN 0 THEN 'p_brand' WHEN 1 THEN '' ELSE p_name END AS x_axis,
  CASE p_partkey % 5 WHEN 0 THEN 'p_size' WHEN 1 THEN 'p_retailprice' END AS y_axis,
  CASE WHEN p_partkey % 7 > 0 THEN p_type END AS title FROM {part}"""
_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _specs(s, d):
    return s.sql(SPECS, part=read(s, d, "part"))


def _chosen(s, d):
    parsed = tt.validate_chart_specs(_specs(s, d), _COLUMNS)
    rules = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit("bar").alias("chart_type"),
                                      F.lit("p_brand").alias("x_axis"), F.lit("p_size").alias("y_axis"),
                                      F.lit("p_size by p_brand").alias("title"))
    return tt.choose_charts(parsed, rules)


def _text_x(df):
    return df.withColumn("x", F.col("x").cast("string")).withColumn("y", F.round("y", 9))


def _dense(df):
    """Densities by the million, those that are not next to nothing."""
    return df.select("x", "point", F.round("y", 4).alias("y"), F.round(1e6 * F.col("density"), 6).alias("density")).where("density > 0.01")


def _orders(s, d):
    return read(s, d, "orders")


QUERIES = {
    "recommend_charts": lambda s, d: tt.recommend_charts(read(s, d, "part")),
    "recommend_charts_dates": lambda s, d: tt.recommend_charts(
        _orders(s, d).select("o_totalprice", "o_orderdate", "o_custkey")),
    "validate_chart_specs": lambda s, d: tt.validate_chart_specs(_specs(s, d), _COLUMNS),
    "validate_chart_specs_drawn": lambda s, d: tt.validate_chart_specs(
        _specs(s, d), types=tt.constants.DRAWN_CHART_TYPES),
    "choose_charts": _chosen,
    "histogram_data": lambda s, d: tidy(tt.histogram_data(read(s, d, "lineitem"), "l_extendedprice")),
    "histogram_data_total": lambda s, d: tidy(tt.histogram_data(read(s, d, "documents"), "n_chars", "doc_id"), 3),
    "bar_data": lambda s, d: tidy(tt.bar_data(read(s, d, "lineitem"), "l_returnflag", "l_extendedprice"), 2),
    "bar_data_count": lambda s, d: tt.bar_data(read(s, d, "events"), "event_type"),
    "heatmap_data": lambda s, d: tidy(tt.heatmap_data(read(s, d, "part"))),
    "scatter_data": lambda s, d: tt.scatter_data(read(s, d, "part"), "p_size", "p_retailprice"),
    "scatter_data_sample": lambda s, d: tt.scatter_data(
        read(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 500),
    "scatter_bins": lambda s, d: tt.scatter_bins(read(s, d, "lineitem"), "l_quantity", "l_extendedprice"),
    "box_data": lambda s, d: tidy(tt.box_data(read(s, d, "events"), "event_type", "value")),
    "box_data_customers": lambda s, d: tidy(tt.box_data(_orders(s, d), "o_custkey", "o_totalprice")),
    "box_data_hot": lambda s, d: tidy(tt.box_data(_orders(s, d), "o_orderpriority", "o_totalprice", group_values=500)),
    "violin_data": lambda s, d: tidy(tt.violin_data(_orders(s, d), "o_orderpriority", "o_totalprice")),
    "violin_density": lambda s, d: _dense(tt.violin_density(_orders(s, d), "o_orderpriority", "o_totalprice")),
    "line_data_thinned": lambda s, d: tidy(_text_x(tt.line_data(
        _orders(s, d), "o_orderkey", "o_totalprice", agg="max", max_points=400))),
    "area_data_thinned": lambda s, d: tidy(_text_x(tt.area_data(_orders(s, d), "o_orderdate", "o_totalprice", max_points=200)), 2),
    "line_data": lambda s, d: tidy(_text_x(tt.line_data(_orders(s, d), "o_orderdate", "o_totalprice", agg="max"))),
    "line_data_month": lambda s, d: tidy(_text_x(tt.line_data(_orders(s, d), "o_orderdate", "o_totalprice", "month"))),
    "pie_data": lambda s, d: tidy(tt.pie_data(_orders(s, d), "o_orderpriority", "o_totalprice"), 2),
    "pie_data_count": lambda s, d: tidy(tt.pie_data(read(s, d, "documents"), "lang")),
    "area_data_stacked": lambda s, d: tidy(_text_x(tt.area_data(
        _orders(s, d), "o_orderdate", "o_totalprice", "month", "o_orderpriority")), 2),
    "area_data": lambda s, d: tidy(_text_x(tt.area_data(_orders(s, d), "o_orderdate", "o_totalprice", "month")), 2),
}


def _validated_sql(types: str, known: bool) -> str:
    def axis(c):
        return f"CASE WHEN {c} IN ('{chr(39).join(_COLUMNS).replace(chr(39), chr(39) + ', ' + chr(39))}') THEN {c} END" \
            if known else f"nullif({c}, '')"

    return f"""SELECT id, lower(trim(chart_type)) AS chart_type, {axis('x_axis')} AS x_axis, {axis('y_axis')} AS y_axis,
coalesce(title, 'Chart') AS title FROM ({SPECS.format(part='part')}) WHERE lower(trim(chart_type)) IN ({types})"""


_BINS = 20


def _bin_sql(v: str, lo: str, hi: str) -> str:
    return f"least(floor(({v} - {lo}) / ({hi} - {lo}) * {_BINS}), {_BINS - 1})::INTEGER"


def _histogram_sql(table: str, x: str, total: str = "") -> str:
    return f"""WITH r AS (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {table}),
b AS (SELECT {_bin_sql(x, 'lo', 'hi')} AS bin, lo, hi, * EXCLUDE (lo, hi) FROM {table}, r)
SELECT bin, count(*) AS n{total}, round(lo + bin * ((hi - lo) / {_BINS}), {{digits}}) AS lower,
round(lo + (bin + 1) * ((hi - lo) / {_BINS}), {{digits}}) AS upper FROM b GROUP BY bin, lo, hi"""


def _box_sql(table: str, x: str, y: str) -> str:
    return f"""WITH b AS (SELECT {x} AS x, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS median,
quantile_cont({y}, 0.75) AS q3 FROM {table} GROUP BY 1),
p AS (SELECT x, q1, median, q3, {y} AS y, {y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM {table} t JOIN b ON t.{x} = b.x)
SELECT x, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
round(min(y) FILTER (inside), 6) AS lower_whisker, round(max(y) FILTER (inside), 6) AS upper_whisker,
count(*) FILTER (NOT inside) AS n_outliers FROM p GROUP BY ALL"""


def _line_sql(agg: str, unit: str | None, digits: int) -> str:
    x = f"date_trunc('{unit}', o_orderdate)" if unit else "o_orderdate"
    return f"SELECT ({x})::TIMESTAMP::VARCHAR AS x, round(round({agg}(o_totalprice), 9), {digits}) AS y FROM orders GROUP BY 1"


_PAIRS = [("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice")]
_BEST = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS)) + ") v(i, a, b) " \
    "JOIN (" + " UNION ALL ".join(f"SELECT {i} AS i, {pearson_sql(a, b)} AS r FROM part" for i, (a, b) in enumerate(_PAIRS)) \
    + ") USING (i) WHERE r IS NOT NULL ORDER BY round(abs(r), 12) DESC, i LIMIT 1)"

_VALIDATED = _validated_sql("'bar', 'line', 'scatter', 'histogram', 'box', 'heatmap', 'pie', 'area'", True)

def _thin_sql(x: str, agg: str, place: str, most: int, digits: int) -> str:
    return f"""WITH l AS (SELECT {x} AS x, {agg}(o_totalprice) AS y FROM orders GROUP BY 1),
r AS (SELECT min({place}) AS low, max({place}) AS high, count(*) AS n FROM l),
p AS (SELECT x, y, CASE WHEN n <= {most} THEN row_number() OVER () ELSE
  least(floor(({place} - low) / (high - low) * {most // 4}), {most // 4 - 1}) END AS pixel FROM l, r),
e AS (SELECT arg_min({{'x': x, 'y': y}}, x) AS a, arg_max({{'x': x, 'y': y}}, x) AS b, min({{'y': y, 'x': x}}) AS c, max({{'y': y, 'x': x}}) AS d
  FROM p GROUP BY pixel),
u AS (SELECT a.x, a.y FROM e UNION SELECT b.x, b.y FROM e UNION SELECT c.x, c.y FROM e UNION SELECT d.x, d.y FROM e)
SELECT x::VARCHAR AS x, round(y, {digits}) AS y FROM u"""


ORACLES = {
    "recommend_charts": f"""SELECT 1 AS rank, 'histogram' AS chart_type, 'p_partkey' AS x_axis, NULL AS y_axis, 'Distribution of p_partkey' AS title
UNION ALL SELECT 2, 'bar', 'p_name', 'p_partkey', 'p_partkey by p_name'
UNION ALL SELECT 3, 'heatmap', NULL, NULL, 'Numeric Correlation Heatmap'
UNION ALL SELECT 4, 'scatter', a, b, a || ' vs ' || b FROM {_BEST}
UNION ALL SELECT 5, 'box', 'p_name', 'p_size', 'p_size Distribution by p_name'""",
    "recommend_charts_dates": """SELECT 1 AS rank, 'histogram' AS chart_type, 'o_totalprice' AS x_axis, NULL AS y_axis, 'Distribution of o_totalprice' AS title
UNION ALL SELECT 2, 'scatter', 'o_totalprice', 'o_custkey', 'o_totalprice vs o_custkey'
UNION ALL SELECT 3, 'line', 'o_orderdate', 'o_totalprice', 'o_totalprice Over Time (o_orderdate)'""",
    "validate_chart_specs": _VALIDATED,
    "validate_chart_specs_drawn": _validated_sql(
        "'bar', 'line', 'scatter', 'histogram', 'box', 'heatmap', 'pie', 'area', 'violin'", False),
    "choose_charts": f"""WITH v AS ({_VALIDATED}) SELECT * FROM v UNION ALL
SELECT p_partkey, 'bar', 'p_brand', 'p_size', 'p_size by p_brand' FROM part WHERE p_partkey NOT IN (SELECT id FROM v)""",
    "histogram_data": _histogram_sql("lineitem", "l_extendedprice").format(digits=6),
    "histogram_data_total": _histogram_sql(
        "documents", "n_chars", ", round(sum(doc_id)::DOUBLE, 3) AS total").format(digits=3),
    "bar_data": """SELECT l_returnflag AS x, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1""",
    "bar_data_count": "SELECT event_type AS x, count(*) AS n FROM events GROUP BY 1",
    "heatmap_data": "WITH m AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round({pearson_sql(a, b)}, 6) AS r FROM part" for a, b in _PAIRS) + """)
SELECT a, b, r FROM m UNION ALL SELECT b, a, r FROM m
UNION ALL SELECT c, c, 1.0::DOUBLE FROM (VALUES ('p_partkey'), ('p_size'), ('p_retailprice')) v(c)""",
    "scatter_data": "SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part",
    "scatter_data_sample": """SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem
ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey)), l_quantity, l_extendedprice LIMIT 500""",
    "scatter_bins": f"""WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
SELECT {_bin_sql('l_quantity', 'x0', 'x1')} AS x_bin, {_bin_sql('l_extendedprice', 'y0', 'y1')} AS y_bin, count(*) AS n
FROM lineitem, r GROUP BY 1, 2""",
    "box_data": _box_sql("events", "event_type", "value"),
    "box_data_customers": _box_sql("orders", "o_custkey", "o_totalprice"),
    "box_data_hot": _box_sql("orders", "o_orderpriority", "o_totalprice"),
    "violin_data": f"""WITH r AS (SELECT o_orderpriority AS x, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS size FROM orders GROUP BY 1),
b AS (SELECT x, lo, hi, size, {_bin_sql('o_totalprice', 'lo', 'hi')} AS bin FROM orders JOIN r ON o_orderpriority = x)
SELECT x, bin, count(*) AS n, round(count(*) / size, 6) AS share, round(lo + bin * ((hi - lo) / {_BINS}), 6) AS lower,
round(lo + (bin + 1) * ((hi - lo) / {_BINS}), 6) AS upper FROM b GROUP BY x, bin, lo, hi, size""",
    "violin_density": """WITH v AS (SELECT o_orderpriority AS x, o_totalprice AS y FROM orders),
f AS (SELECT x, count(*) AS n, min(y) AS lo, max(y) AS hi, stddev(y) * pow(count(*), -0.2) AS h FROM v GROUP BY x HAVING max(y) > min(y)),
g AS (SELECT x, n, h, lo - 4 * h AS start, least((hi - lo + 8 * h) / 127, h / 4) AS step FROM f),
p AS (SELECT v.x, n, h, start, step, (y - start) / step AS place FROM v JOIN g USING (x)),
e AS (SELECT x, n, h, start, step, floor(place)::BIGINT AS cell, 1 - (place - floor(place)) AS w FROM p
  UNION ALL SELECT x, n, h, start, step, floor(place)::BIGINT + 1, place - floor(place) FROM p),
c AS (SELECT x, n, h, start, step, cell, sum(w) AS w FROM e GROUP BY ALL),
k AS (SELECT x, h, step, unnest(range(-floor(4 * h / step)::BIGINT, floor(4 * h / step)::BIGINT + 1)) AS o FROM g),
m AS (SELECT x, o, exp(-0.5 * (o * step / h) ** 2) / sum(exp(-0.5 * (o * step / h) ** 2)) OVER (PARTITION BY x) AS share FROM k),
d AS (SELECT x, cell + o AS point, start, step, sum(w * share) / (n * step) AS density FROM c JOIN m USING (x) GROUP BY x, n, cell + o, start, step)
SELECT x, point, round(start + point * step, 4) AS y, round(1e6 * density, 6) AS density FROM d WHERE round(1e6 * density, 6) > 0.01""",
    "line_data_thinned": _thin_sql("o_orderkey", "max", "x::DOUBLE", 400, 9),
    "area_data_thinned": _thin_sql("o_orderdate", "sum", "epoch_us(x)::DOUBLE", 200, 2),
    "line_data": _line_sql("max", None, 6),
    "line_data_month": _line_sql("avg", "month", 6),
    "pie_data": """SELECT o_orderpriority AS x, round(sum(o_totalprice), 2) AS value,
round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 2) AS share FROM orders GROUP BY 1""",
    "pie_data_count": """SELECT lang AS x, count(*) AS value, round(count(*) / (SELECT count(*) FROM documents), 6) AS share
FROM documents GROUP BY 1""",
    "area_data_stacked": """WITH t AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x, o_orderpriority AS g, sum(o_totalprice) AS y
  FROM orders GROUP BY 1, 2), c AS (SELECT *, sum(y) OVER (PARTITION BY x ORDER BY g ROWS UNBOUNDED PRECEDING) AS u FROM t)
SELECT x::VARCHAR AS x, g AS "group", round(y, 2) AS y, round(u - y, 2) AS lower, round(u, 2) AS upper FROM c""",
    "area_data": _line_sql("sum", "month", 2),
}
