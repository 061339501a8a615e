"""Baseline model queries. Forests have no SQL equivalent; everything around them has."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabletools as tt
from catalog.tables import DIRTY_SQL, dirty, read, tidy
from tabletools.operators.forest import fit_forest

FEATURES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ROW_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]

# predictions by rule over every row of ``lineitem``
PREDICTIONS = """SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y2,
  CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS yhat2,
  l_linenumber % 3 AS y3, l_suppkey % 4 AS yhat3,
  l_extendedprice AS y, l_quantity * 2000 AS yhat FROM {lineitem}"""


def _predictions(s, d):
    return s.sql(PREDICTIONS, lineitem=read(s, d, "lineitem"))


def _split(s, d, **options):
    train, test = tt.train_test_split(read(s, d, "orders"), ["o_orderkey"], **options)
    return train.select("o_orderkey", F.lit("train").alias("part")).union(
        test.select("o_orderkey", F.lit("test").alias("part")))


def _encoded(df, key, target):
    train, test = tt.train_test_split(df, [key])
    train, test = tt.encode_target(train, test, target)
    return train.union(test).select(key, "label")


def _lineitem_split(s, d, target):
    columns = list(dict.fromkeys([*ROW_KEYS, *FEATURES, target]))
    return tt.train_test_split(read(s, d, "lineitem").select(*columns), ROW_KEYS)


# a class that the features decide, so that a forest has something to learn
_SIZED = "CASE WHEN l_quantity > 35 THEN 'large' WHEN l_extendedprice > 20000 THEN 'dear' ELSE 'small' END"


def _classifier(s, d):
    rows = read(s, d, "lineitem").withColumn("size", F.expr(_SIZED)).select(*dict.fromkeys([*ROW_KEYS, *FEATURES, "size"]))
    train, test = tt.encode_target(*tt.train_test_split(rows, ROW_KEYS), "size")
    return tt.forest_classify(train, FEATURES, "label"), train, test


def _classified(s, d):
    """What must hold of any good classifier: every test row gets a known class, more often the right one than by the most frequent class."""
    model, train, test = _classifier(s, d)
    pred = model.transform(test).select("label", "prediction")
    most = test.groupBy("label").count().agg(F.max("count")).first()[0]
    sizes = pred.agg(F.count("*").alias("predicted"), F.count_if(F.col("prediction").isin(0.0, 1.0, 2.0)).alias("known"),
                     F.count_if(F.col("label") == F.col("prediction")).alias("hits"))
    return sizes.select(F.lit(train.count()).cast("bigint").alias("train_rows"), "predicted", "known",
                        F.lit(most).cast("bigint").alias("most_frequent"), (F.col("hits") >= most).alias("beats_most_frequent"))


def _regressor(s, d):
    columns = list(dict.fromkeys([*ROW_KEYS, *FEATURES]))
    train, test = tt.train_test_split(read(s, d, "lineitem").select(*columns).withColumn("due", F.expr(_DUE)), ROW_KEYS)
    return tt.forest_regress(train, ["l_quantity", "l_discount", "l_tax"], "due"), train, test


_DUE = "l_quantity * (1 - l_discount)"


def _regressed(s, d):
    """Every test row gets a value inside the range of the training rows, better than their mean."""
    model, train, test = _regressor(s, d)
    low, high = train.agg(F.min("due"), F.max("due")).first()
    pred = model.transform(test).select("due", "prediction")
    fit = tt.regression_metrics(pred, "due", "prediction").select((F.col("r2_score") > 0.5).alias("better_than_mean"))
    inside = pred.agg(F.count("*").alias("predicted"), F.count_if(F.col("prediction").between(low, high)).alias("inside"))
    return inside.select(F.lit(train.count()).cast("bigint").alias("train_rows"), "*", F.lit(fit.first()[0]).alias("better_than_mean"))


def _importances(s, d):
    rows = tt.feature_importances(_classifier(s, d)[0])
    total = rows.agg(F.sum("importance")).first()[0]
    return rows.select("feature", (F.col("importance") >= 0).alias("not_negative"), F.lit(abs(total - 1) < 0.001).alias("sum_is_one"))


def _automl(s, d, target, task):
    result = tt.run_automl(read(s, d, "lineitem"), target, task, ROW_KEYS)[0]
    scores = {"classification": F.col("accuracy").between(0, 1) & F.col("f1_score").between(0, 1) & F.col("rmse").isNull(),
              "regression": (F.col("rmse") >= 0) & (F.col("r2_score") <= 1) & F.col("accuracy").isNull()}[task]
    return result.select("task_type", "target_column", "model", "train_samples", "test_samples", scores.alias("scores_in_range"),
                         "skipped", "error", "left_out")


def _learnt(s, d, target, task):
    """Scores of a run whose target follows from the features: over those of the most frequent class, and of the mean."""
    columns = [F.col(c) for c in dict.fromkeys([*ROW_KEYS, *FEATURES])]
    rows = read(s, d, "lineitem").select(*columns, F.expr(target).alias("y"))
    result, importances = tt.run_automl(rows, "y", task, ROW_KEYS)
    leaders = {r.feature for r in importances.orderBy(F.desc("importance")).limit(2).collect()}
    good = F.col("accuracy") >= 0.98 if task == "classification" else F.col("r2_score") >= 0.95
    return result.select("task_type", "train_samples", "test_samples", good.alias("learnt"), "error",
                         F.lit(", ".join(sorted(leaders))).alias("deciding_features"))


def _as_fit(s, d):
    """A forest without a draw of rows repeats the training labels wherever the features tell rows apart."""
    rows = read(s, d, "lineitem").withColumn("y", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)).cast("double"))
    model = fit_forest(rows, ["l_orderkey", "l_partkey", "l_linenumber"], "y", 3, 3, 42, 1, drawn=False)
    pred = model.transform(rows.select("l_orderkey", "l_partkey", "l_linenumber", "y"))
    hits = pred.groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(
        F.count_distinct("y").alias("classes"), F.count_if(F.col("y") != F.col("prediction")).alias("wrong"))
    return hits.agg(F.count("*").alias("groups"), F.count_if((F.col("classes") == 1) & (F.col("wrong") > 0)).alias("wrong"))


def _gated(s, d):
    """One row too few, and just enough."""
    few = read(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey").orderBy("c_custkey")
    runs = [tt.run_automl(few.limit(n), "c_acctbal", "regression", ["c_custkey"], trees=2, depth=2)[0] for n in (19, 20)]
    return runs[0].union(runs[1]).select((F.col("train_samples") + F.col("test_samples")).alias("rows"), "error")


QUERIES = {
    "feature_columns": lambda s, d: tt.feature_columns(
        tt.parse_datetimes(dirty(s, d)), "value"),
    "feature_columns_unknown": lambda s, d: tt.feature_columns(
        tt.drop_sparse_columns(dirty(s, d)), "sparse"),
    "cardinality_gate": lambda s, d: tt.cardinality_gate(read(s, d, "part")),
    "cardinality_gate_customers": lambda s, d: tt.cardinality_gate(read(s, d, "customer")),
    "cardinality_gate_documents": lambda s, d: tt.cardinality_gate(read(s, d, "documents")),
    "label_encode": lambda s, d: tt.label_encode(read(s, d, "part"), ["p_brand", "p_type"]),
    "label_encode_gaps": lambda s, d: tt.label_encode(dirty(s, d).select("event_id", "event_type"), ["event_type"]),
    "fill_features": lambda s, d: tidy(tt.fill_features(dirty(s, d).select("event_id", "value"), ["value"])),
    "train_test_split": _split,
    "train_test_split_exact": lambda s, d: _split(s, d, exact=True),
    "encode_target": lambda s, d: _encoded(read(s, d, "orders"), "o_orderkey", "o_orderpriority"),
    "encode_target_numeric": lambda s, d: _encoded(read(s, d, "customer"), "c_custkey", "c_nationkey"),
    "encode_target_unseen": lambda s, d: _encoded(read(s, d, "customer"), "c_custkey", "c_name"),
    "accuracy": lambda s, d: tt.accuracy(_predictions(s, d), "y3", "yhat3"),
    "f1_score_binary": lambda s, d: tt.f1_score(_predictions(s, d), "y2", "yhat2", 2),
    "f1_score_weighted": lambda s, d: tt.f1_score(_predictions(s, d), "y3", "yhat3", 3),
    "rmse": lambda s, d: tt.rmse(_predictions(s, d), "y", "yhat"),
    "r2_score": lambda s, d: tt.r2_score(_predictions(s, d), "y", "yhat"),
    "classification_metrics": lambda s, d: tt.classification_metrics(_predictions(s, d), "y3", "yhat3", 3),
    "regression_metrics": lambda s, d: tt.regression_metrics(_predictions(s, d), "y", "yhat"),
    "forest_classify": _classified,
    "forest_regress": _regressed,
    "feature_importances": _importances,
    "label_encode_many": lambda s, d: tt.label_encode(read(s, d, "customer").select("c_custkey", "c_name"), ["c_name"]),
    "min_rows_gate": _gated,
    "run_automl_classification": lambda s, d: _automl(s, d, "l_returnflag", "classification"),
    "run_automl_regression": lambda s, d: _automl(s, d, "l_extendedprice", "regression"),
    "run_automl_learns_classes": lambda s, d: _learnt(s, d, _SIZED, "classification"),
    "run_automl_learns_numbers": lambda s, d: _learnt(s, d, _DUE, "regression"),
    "forest_grows_to_the_end": _as_fit,
    "run_automl_error": lambda s, d: tt.run_automl(read(s, d, "lineitem"), "l_returnflag", "regression", ROW_KEYS)[0],
}


def _split_sql(cutoff: str) -> str:
    return f"SELECT o_orderkey, CASE WHEN {cutoff} THEN 'test' ELSE 'train' END AS part FROM orders"


_MARK = "substr(md5(concat_ws('|', '42', {k})), 1, 8) < '33333333'"


def _encoded_sql(table: str, key: str, target: str) -> str:
    mark = _MARK.format(k=key)
    return f"""WITH c AS (SELECT {target} AS t, dense_rank() OVER (ORDER BY {target}) - 1 AS label
  FROM {table} WHERE NOT ({mark}) GROUP BY 1)
SELECT {key}, coalesce(label, 0)::DOUBLE AS label FROM {table} LEFT JOIN c ON {target} = t"""


_P = f"WITH p AS ({PREDICTIONS.format(lineitem='lineitem')})"


def _gate_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct,
count(DISTINCT {c}) <= 50 AS kept FROM {table}""" for c in columns)


_TESTED = "(SELECT *, " + _MARK.format(k="l_orderkey, l_linenumber, l_partkey") + " AS test FROM lineitem)"


def _automl_sql(target: str, task: str) -> str:
    return f"""SELECT '{task}' AS task_type, '{target}' AS target_column, 'RandomForest' AS model,
  count(*) FILTER (NOT test) AS train_samples, count(*) FILTER (test) AS test_samples, true AS scores_in_range,
  false AS skipped, NULL::VARCHAR AS error, NULL::VARCHAR AS left_out FROM {_TESTED}"""


def _learnt_sql(task: str, features: str) -> str:
    return f"""SELECT '{task}' AS task_type, count(*) FILTER (NOT test) AS train_samples, count(*) FILTER (test) AS test_samples,
  true AS learnt, NULL::VARCHAR AS error, '{features}' AS deciding_features FROM {_TESTED}"""


ORACLES = {
    "forest_classify": f"""WITH t AS (SELECT *, {_SIZED} AS size FROM {_TESTED})
SELECT count(*) FILTER (NOT test) AS train_rows, count(*) FILTER (test) AS predicted, count(*) FILTER (test) AS known,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM t WHERE test GROUP BY size)) AS most_frequent, true AS beats_most_frequent FROM t""",
    "forest_regress": f"""SELECT count(*) FILTER (NOT test) AS train_rows, count(*) FILTER (test) AS predicted,
  count(*) FILTER (test) AS inside, true AS better_than_mean FROM {_TESTED}""",
    "feature_importances": "SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, true AS not_negative, true AS sum_is_one",
    "run_automl_classification": _automl_sql("l_returnflag", "classification"),
    "run_automl_regression": _automl_sql("l_extendedprice", "regression"),
    "run_automl_learns_classes": _learnt_sql("classification", "l_extendedprice, l_quantity"),
    "run_automl_learns_numbers": _learnt_sql("regression", "l_discount, l_quantity"),
    "forest_grows_to_the_end": """SELECT count(*) AS groups, 0::BIGINT AS wrong
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem)""",
    "min_rows_gate": """SELECT 0::BIGINT AS rows, 'Dataset has only ' || count(*) || ' rows after preprocessing — too few for a reliable train/test split.' AS error
  FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 19)
UNION ALL SELECT count(*), NULL FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 20)""",
    "label_encode_many": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer",
    "feature_columns": """SELECT * FROM (VALUES ('event_id', 'numeric', true, NULL), ('user_id', 'numeric', true, NULL),
  ('value', 'numeric', false, 'target'), ('event_type', 'categorical', true, NULL), ('sparse', 'numeric', true, NULL),
  ('half', 'numeric', true, NULL), ('d_ok', 'datetime', false, 'datetime'), ('d_rate', 'categorical', true, NULL),
  ('d_fail', 'categorical', true, NULL)) v("column", kind, used, reason)""",
    "feature_columns_unknown": """SELECT 'sparse' AS "column", NULL::VARCHAR AS kind, false AS used, 'unknown target' AS reason""",
    "cardinality_gate": _gate_sql("part", ["p_name", "p_brand", "p_type"]),
    "cardinality_gate_customers": _gate_sql("customer", ["c_name", "c_mktsegment"]),
    "cardinality_gate_documents": _gate_sql("documents", ["text", "lang", "source"]),
    "label_encode": """SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand,
  dense_rank() OVER (ORDER BY p_type) - 1 AS p_type, p_size, p_retailprice FROM part""",
    "label_encode_gaps": DIRTY_SQL + """ SELECT event_id, dense_rank() OVER (ORDER BY coalesce(event_type, 'nan')) - 1 AS event_type
FROM dirty""",
    "fill_features": DIRTY_SQL + """ SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty)), 6) AS value
FROM dirty""",
    "train_test_split": _split_sql(_MARK.format(k="o_orderkey")),
    "train_test_split_exact": """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', o_orderkey)))
  <= ceil(0.2 * (SELECT count(*) FROM orders)) THEN 'test' ELSE 'train' END AS part FROM orders""",
    "encode_target": _encoded_sql("orders", "o_orderkey", "o_orderpriority"),
    "encode_target_numeric": _encoded_sql("customer", "c_custkey", "c_nationkey"),
    "encode_target_unseen": _encoded_sql("customer", "c_custkey", "c_name"),
    "accuracy": _P + " SELECT round(avg((y3 = yhat3)::INTEGER), 4) AS accuracy FROM p",
    "f1_score_binary": _P + """ SELECT round(2 * count(*) FILTER (y2 = 1 AND yhat2 = 1)
  / (count(*) FILTER (y2 = 1) + count(*) FILTER (yhat2 = 1)), 4) AS f1_score FROM p""",
    "f1_score_weighted": _P + """, k AS (SELECT DISTINCT y3 AS c FROM p),
f AS (SELECT c, 2 * count(*) FILTER (y3 = c AND yhat3 = c) / (count(*) FILTER (y3 = c) + count(*) FILTER (yhat3 = c)) AS f1,
  count(*) FILTER (y3 = c) AS support FROM p, k GROUP BY c)
SELECT round(sum(f1 * support) / sum(support), 4) AS f1_score FROM f""",
    "rmse": _P + " SELECT round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse FROM p",
    "r2_score": _P + " SELECT round(1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)), 4) AS r2_score FROM p",
    "classification_metrics": _P + """, k AS (SELECT DISTINCT y3 AS c FROM p),
f AS (SELECT c, 2 * count(*) FILTER (y3 = c AND yhat3 = c) / (count(*) FILTER (y3 = c) + count(*) FILTER (yhat3 = c)) AS f1,
  count(*) FILTER (y3 = c) AS support FROM p, k GROUP BY c)
SELECT (SELECT round(avg((y3 = yhat3)::INTEGER), 4) FROM p) AS accuracy, round(sum(f1 * support) / sum(support), 4) AS f1_score FROM f""",
    "regression_metrics": _P + """ SELECT round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse,
  round(1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)), 4) AS r2_score FROM p""",
    "run_automl_error": """SELECT 'regression' AS task_type, 'l_returnflag' AS target_column, 'RandomForest' AS model,
  count(*) FILTER (NOT test) AS train_samples, count(*) FILTER (test) AS test_samples, NULL::DOUBLE AS accuracy, NULL::DOUBLE AS f1_score,
  NULL::DOUBLE AS rmse, NULL::DOUBLE AS r2_score, false AS skipped, 'Target column ''l_returnflag'' is not numeric. '
  || 'Choose a numeric column for Regression or switch to Classification.' AS error, NULL::VARCHAR AS left_out
  FROM (SELECT """ + _MARK.format(k="l_orderkey, l_linenumber, l_partkey") + """ AS test FROM lineitem)""",
}
