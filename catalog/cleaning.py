"""Cleaning queries, mostly on ``dirty``, which has what each rule looks for."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabletools as tt
from tabletools.sources.staging import staging_path
from catalog.tables import CLEAN_DIRTY_SQL, DIRTY_SQL, dirty, read, tidy

_KEYS = ["event_id"]


def _labelled(s, d):
    documents = read(s, d, "documents").select("doc_id", "lang", "n_chars")
    return documents.join(read(s, d, "labels"), "doc_id", "left")


def _as_text(df, column):
    return df.withColumn(column, F.col(column).cast("string"))


def _streamed(s, d):
    """The same rows arriving as a stream, cleaned by the rules fitted on them."""
    arrivals, cleaned = staging_path(s, "arrivals"), staging_path(s, "cleaned-stream")
    dirty(s, d).write.parquet(arrivals)
    table = s.read.parquet(arrivals)
    stream = s.readStream.schema(table.schema).parquet(arrivals)
    tt.append_clean_stream(tt.fit_cleaning(table), stream, cleaned).awaitTermination()
    return s.read.parquet(cleaned)


def _repeated(s, d):
    return read(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


# dates in forms that a column may have as a whole: zone, offset, minutes only, nine digits, day with slashes and time
FORMS = """SELECT event_id, @f(ts, '@day@T@time') || 'Z' AS zulu, @f(ts, '@day@T@time') || '+02:00' AS offset_,
  @f(ts, '@day@ @minute') AS minutes, @f(ts, '@day@ @time') || '.123456789' AS nano, @f(ts, '@slash @time') AS slashed,
  @f(ts, '@day@T@minute') || '-0130' AS short_offset, CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE @f(ts, '@day@ @time') || 'Z' END AS mixed
FROM {events}"""
_FORMS_SPARK = FORMS.replace("@f", "date_format").replace("@day@T", "yyyy-MM-dd''T''").replace("@day@ ", "yyyy-MM-dd ") \
    .replace("@slash", "yyyy/M/d").replace("@time", "HH:mm:ss").replace("@minute", "HH:mm")
_FORMS_DUCK = FORMS.replace("@f", "strftime").replace("@day@T", "%Y-%m-%dT").replace("@day@ ", "%Y-%m-%d ") \
    .replace("@slash", "%Y/%-m/%-d").replace("@time", "%H:%M:%S").replace("@minute", "%H:%M").format(events="events")
_FORM_COLUMNS = ["zulu", "offset_", "minutes", "nano", "slashed", "short_offset"]


def _parsed_forms(s, d):
    parsed = tt.parse_datetimes(s.sql(_FORMS_SPARK.replace("''T''", "\\'T\\'"), events=read(s, d, "events")))
    return parsed.select("event_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in _FORM_COLUMNS],
                         "mixed")


def _refitted(s, d):
    """Three parts that share rows arrive one after the other, each of any number of files and taken in whole before the next one; what has come
    is cleaned by rules fitted on all of it."""
    arrivals, folder, checkpoint = (staging_path(s, label) for label in ("arrivals", "refit", "refit-state"))
    table = dirty(s, d)
    for i in range(3):
        table.where(F.pmod(F.col("event_id"), F.lit(3)).isin(i, (i + 1) % 3)).write.mode("append").parquet(arrivals)
        stream = s.readStream.schema(table.schema).parquet(arrivals)
        tt.append_distinct_stream(stream, folder, checkpoint).awaitTermination()
    return tt.refit_cleaning(s, folder, table.schema).cleaned()


QUERIES = {
    "parse_datetimes_forms": _parsed_forms,
    "duplicate_count": lambda s, d: tt.duplicate_count(dirty(s, d)),
    "duplicate_count_frequent": lambda s, d: tt.duplicate_count(_repeated(s, d)),
    "drop_exact_duplicates": lambda s, d: tt.drop_exact_duplicates(dirty(s, d)),
    "drop_exact_duplicates_frequent": lambda s, d: tt.drop_exact_duplicates(_repeated(s, d)),
    "null_profile": lambda s, d: tidy(tt.null_profile(tt.drop_exact_duplicates(dirty(s, d)))),
    "drop_sparse_columns": lambda s, d: tt.drop_sparse_columns(tt.drop_exact_duplicates(dirty(s, d))),
    "drop_sparse_columns_joined": lambda s, d: tt.drop_sparse_columns(_labelled(s, d)),
    "fill_median": lambda s, d: tidy(tt.fill_median(dirty(s, d), ["value", "half"])),
    "fill_mode": lambda s, d: tt.fill_mode(dirty(s, d)),
    "iqr_fences": lambda s, d: tidy(tt.iqr_fences(read(s, d, "documents"))),
    "iqr_fences_lineitem": lambda s, d: tidy(tt.iqr_fences(read(s, d, "lineitem"))),
    "outlier_counts": lambda s, d: tt.outlier_counts(read(s, d, "events"), tt.iqr_fences(read(s, d, "events"))),
    "outlier_counts_documents": lambda s, d: tt.outlier_counts(
        read(s, d, "documents"), tt.iqr_fences(read(s, d, "documents"))),
    "clip_outliers": lambda s, d: tidy(tt.clip_outliers(
        read(s, d, "events").select("event_id", "value"), tt.iqr_fences(read(s, d, "events")))),
    "clip_outliers_documents": lambda s, d: tidy(tt.clip_outliers(
        read(s, d, "documents").select("doc_id", "n_chars"), tt.iqr_fences(read(s, d, "documents").select("n_chars")))),
    "date_pattern_rate": lambda s, d: tidy(tt.date_pattern_rate(dirty(s, d))),
    "date_pattern_rate_first": lambda s, d: tidy(tt.date_pattern_rate(
        tt.drop_exact_duplicates(dirty(s, d)), order_by=_KEYS)),
    "parse_datetimes": lambda s, d: _as_text(tt.parse_datetimes(
        dirty(s, d).select("event_id", "event_type", "d_ok", "d_rate", "d_fail")), "d_ok"),
    "cleaning_report": lambda s, d: tt.cleaning_report(tt.fit_cleaning(dirty(s, d))),
    "run_cleaning": lambda s, d: tidy(_as_text(tt.run_cleaning(dirty(s, d))[0], "d_ok")),
    "clean_stream": lambda s, d: tidy(_as_text(_streamed(s, d), "d_ok")),
    "refit_stream": lambda s, d: tidy(_as_text(_refitted(s, d), "d_ok")),
    "run_cleaning_orders": lambda s, d: tidy(_as_text(tt.run_cleaning(
        read(s, d, "orders").withColumn("o_orderdate", F.substring(F.col("o_orderdate").cast("string"), 1, 10)))[0],
        "o_orderdate")),
}


def _fence_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
FROM (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {table}) WHERE q3 <> q1"""


def _fences_sql(table: str, columns: list[str]) -> str:
    rows = " UNION ALL ".join(_fence_sql(table, c) for c in columns)
    return 'SELECT "column", ' + ", ".join(
        f"round({m}, 6) AS {m}" for m in ("q1", "q3", "iqr", "lower", "upper")) + f" FROM ({rows})"


def _outliers_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT count(*) FROM {table} WHERE {c} < f.lower OR {c} > f.upper) AS n_outliers
FROM ({_fence_sql(table, c)}) f""" for c in columns)


def _mode_sql(table: str, column: str) -> str:
    return f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


_RATE = "avg((regexp_matches({c}, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}'))::INTEGER)"
_TEXTS = ["event_type", "d_ok", "d_rate", "d_fail"]
_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax"]

_FILL = f"""SELECT event_id, user_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM d)) AS value,
  coalesce(event_type, {_mode_sql('d', 'event_type')}) AS event_type,
  coalesce(half, (SELECT quantile_cont(half, 0.5) FROM d)) AS half, d_ok, d_rate, d_fail FROM """
FILLED = f"""{CLEAN_DIRTY_SQL},
f AS ({_FILL}d), arrived AS ({_FILL}dirty),
fv AS ({_fence_sql('f', 'value')}), fh AS ({_fence_sql('f', 'half')})"""

_REPORT = FILLED + """,
n AS (SELECT (SELECT count(*) FROM dirty) - count(*) AS dup, count(*) AS total, count(*) - count(value) AS value,
  count(*) - count(event_type) AS event_type, count(*) - count(sparse) AS sparse, count(*) - count(half) AS half FROM d),
o AS (SELECT (SELECT count(*) FROM f, fv WHERE f.value < lower OR f.value > upper) AS value,
  (SELECT count(*) FROM f, fh WHERE f.half < lower OR f.half > upper) AS half),
r(block, kind, "column", message, amount) AS (
  SELECT 1, 'issue', NULL, 'Found ' || dup || ' duplicate rows.', dup FROM n
  UNION ALL SELECT 2, 'action', NULL, 'Dropped ' || dup || ' exact duplicate rows.', dup FROM n
  UNION ALL SELECT 3, 'issue', 'value', format('Column ''value'' has {} missing value(s) ({:.1f}%).', value, 100.0 * value / total), value FROM n
  UNION ALL SELECT 4, 'action', 'value', 'Filled ' || value || ' null(s) in numeric column ''value'' with median ('
    || (SELECT round(quantile_cont(value, 0.5), 4) FROM d) || ').', value FROM n
  UNION ALL SELECT 5, 'issue', 'event_type', format('Column ''event_type'' has {} missing value(s) ({:.1f}%).', event_type, 100.0 * event_type / total), event_type FROM n
  UNION ALL SELECT 6, 'action', 'event_type', 'Filled ' || event_type || ' null(s) in categorical column ''event_type'' with mode ('''
    || """ + _mode_sql("d", "event_type") + """ || ''').', event_type FROM n
  UNION ALL SELECT 7, 'issue', 'sparse', format('Column ''sparse'' has {:.0f}% missing values — will be dropped.', 100.0 * sparse / total), sparse FROM n
  UNION ALL SELECT 8, 'action', 'sparse', format('Dropped column ''sparse'' ({:.0f}% null).', 100.0 * sparse / total), sparse FROM n
  UNION ALL SELECT 9, 'issue', 'half', format('Column ''half'' has {} missing value(s) ({:.1f}%).', half, 100.0 * half / total), half FROM n
  UNION ALL SELECT 10, 'action', 'half', 'Filled ' || half || ' null(s) in numeric column ''half'' with median ('
    || (SELECT round(quantile_cont(half, 0.5), 4) FROM d) || ').', half FROM n
  UNION ALL SELECT 11, 'issue', 'value', 'Column ''value'' has ' || o.value || ' outlier(s) beyond IQR fence.', o.value FROM o WHERE o.value > 0
  UNION ALL SELECT 12, 'action', 'value', 'Clipped ' || o.value || ' outlier(s) in ''value'' to fence [' || round(lower, 3) || ', ' || round(upper, 3) || '].', o.value FROM o, fv WHERE o.value > 0
  UNION ALL SELECT 13, 'issue', 'half', 'Column ''half'' has ' || o.half || ' outlier(s) beyond IQR fence.', o.half FROM o, fh WHERE o.half > 0
  UNION ALL SELECT 14, 'action', 'half', 'Clipped ' || o.half || ' outlier(s) in ''half'' to fence [' || round(lower, 3) || ', ' || round(upper, 3) || '].', o.half FROM o, fh WHERE o.half > 0
  UNION ALL SELECT 15, 'action', 'd_ok', format('Parsed column ''d_ok'' as datetime ({:.0f}% pattern match rate).', 100.0 * r), 1
    FROM (SELECT """ + _RATE.format(c="d_ok") + """ AS r FROM f)
  UNION ALL SELECT 16, 'summary', NULL, 'rows_removed', dup FROM n
  UNION ALL SELECT 17, 'summary', NULL, 'columns_removed', 1
  UNION ALL SELECT 18, 'summary', NULL, 'nulls_filled', value + event_type + half FROM n
  UNION ALL SELECT 19, 'summary', NULL, 'outliers_clipped', value + CASE WHEN EXISTS (FROM fh) THEN half ELSE 0 END FROM o)
SELECT row_number() OVER (ORDER BY block)::INTEGER AS seq, kind, "column", message, amount::BIGINT AS amount FROM r"""

CLEANED = """ SELECT event_id, user_id, round(greatest(fv.lower, least(value, fv.upper)), 6) AS value, event_type,
  round(CASE WHEN EXISTS (FROM fh) THEN greatest((SELECT lower FROM fh), least(half, (SELECT upper FROM fh))) ELSE half END, 6) AS half,
  try_strptime(d_ok, '%Y-%m-%d')::VARCHAR AS d_ok, d_rate, d_fail FROM {rows}, fv"""

_MICROS = "strftime({t}, '%Y-%m-%d %H:%M:%S.%f')"

ORACLES = {
    "parse_datetimes_forms": f"""WITH e AS (SELECT event_id, date_trunc('second', ts::TIMESTAMP) AS s, date_trunc('minute', ts::TIMESTAMP) AS m FROM events),
x AS ({_FORMS_DUCK})
SELECT event_id, {_MICROS.format(t='s')} AS zulu, {_MICROS.format(t="s - INTERVAL 2 HOUR")} AS offset_, {_MICROS.format(t='m')} AS minutes,
  {_MICROS.format(t="s + INTERVAL 123456 MICROSECOND")} AS nano, {_MICROS.format(t='s')} AS slashed,
  {_MICROS.format(t="m + INTERVAL 90 MINUTE")} AS short_offset, mixed FROM e JOIN x USING (event_id)""",
    "duplicate_count": DIRTY_SQL + " SELECT (SELECT count(*) FROM dirty) - count(*) AS n_duplicates FROM (SELECT DISTINCT * FROM dirty)",
    "duplicate_count_frequent": """SELECT (SELECT count(*) FROM lineitem) - count(*) AS n_duplicates
FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)""",
    "drop_exact_duplicates": DIRTY_SQL + " SELECT DISTINCT * FROM dirty",
    "drop_exact_duplicates_frequent": "SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem",
    "null_profile": CLEAN_DIRTY_SQL + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*), 6) AS pct_null FROM d"""
        for c in ["event_id", "user_id", "value", "event_type", "sparse", "half", "d_ok", "d_rate", "d_fail"]),
    "drop_sparse_columns": CLEAN_DIRTY_SQL + " SELECT * EXCLUDE (sparse) FROM d",
    "drop_sparse_columns_joined": "SELECT doc_id, lang, n_chars FROM documents",
    "fill_median": DIRTY_SQL + """ SELECT * REPLACE (
  round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty)), 6) AS value,
  round(coalesce(half, (SELECT quantile_cont(half, 0.5) FROM dirty)), 6) AS half, round(sparse, 6) AS sparse) FROM dirty""",
    "fill_mode": DIRTY_SQL + f" SELECT * REPLACE (coalesce(event_type, {_mode_sql('dirty', 'event_type')}) AS event_type) FROM dirty",
    "iqr_fences": _fences_sql("documents", ["doc_id", "n_chars"]),
    "iqr_fences_lineitem": _fences_sql("lineitem", _LINEITEM),
    "outlier_counts": _outliers_sql("events", ["event_id", "user_id", "value"]),
    "outlier_counts_documents": _outliers_sql("documents", ["doc_id", "n_chars"]),
    "clip_outliers": f"""SELECT event_id, round(greatest(lower, least(value, upper)), 6) AS value
FROM events, ({_fence_sql('events', 'value')})""",
    "clip_outliers_documents": f"""SELECT doc_id, round(greatest(lower, least(n_chars, upper)), 6) AS n_chars
FROM documents, ({_fence_sql('documents', 'n_chars')})""",
    "date_pattern_rate": DIRTY_SQL + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round({_RATE.format(c=c)}, 6) AS match_rate FROM dirty""" for c in _TEXTS),
    "date_pattern_rate_first": CLEAN_DIRTY_SQL + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round({_RATE.format(c=c)}, 6) AS match_rate
FROM (SELECT {c} FROM d WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 20)""" for c in _TEXTS),
    "parse_datetimes": DIRTY_SQL + """ SELECT event_id, event_type, try_strptime(d_ok, '%Y-%m-%d')::VARCHAR AS d_ok, d_rate, d_fail
FROM dirty""",
    "cleaning_report": _REPORT,
    "run_cleaning": FILLED + CLEANED.format(rows="f"),
    "refit_stream": FILLED + CLEANED.format(rows="f"),
    "clean_stream": FILLED + CLEANED.format(rows="arrived"),
    "run_cleaning_orders": """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
  o_orderdate::VARCHAR AS o_orderdate, o_orderpriority FROM orders""",
}
