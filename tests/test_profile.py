import numpy as np
import pandas as pd
import pytest

import tabletools as tt
import tabletools.operators.profile as profile


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def random_frame(n=500, columns=6, gaps=0.2, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, columns)) * 10.0 ** rng.integers(-2, 4, columns)
    base[:, 1] += base[:, 0] * 3
    base[rng.random((n, columns)) < gaps] = np.nan
    return pd.DataFrame(base, columns=[f"c.{i} x" for i in range(columns)])


@pytest.mark.parametrize("partitions", [1, 7])
def test_summary_equals_pandas(spark, partitions):
    frame = random_frame()
    found = by_column(tt.numeric_summary(spark.createDataFrame(frame).repartition(partitions), 6))
    for c in frame:
        s = frame[c]
        expected = {"mean": s.mean(), "std": s.std(), "min": s.min(), "max": s.max(), "median": s.median(),
                    "skew": s.skew(), "kurtosis": s.kurt(), "q25": s.quantile(.25), "q75": s.quantile(.75)}
        for metric, value in expected.items():
            assert found[c][metric] == pytest.approx(value, abs=2e-6), (c, metric)
        assert found[c]["non_null_count"] == s.count()


@pytest.mark.parametrize("narrow", [12, 2])
def test_correlations_equal_pandas_on_both_paths(spark, monkeypatch, narrow):
    monkeypatch.setattr(profile, "NARROW_COLUMNS", narrow)
    for gaps in (0.0, 0.3):
        frame = random_frame(gaps=gaps).assign(constant=4.2)
        expected = frame.corr()
        rows = tt.correlation_matrix(spark.createDataFrame(frame).repartition(3)).collect()
        assert len(rows) == 21
        for a, b, r in rows:
            if "constant" in (a, b):
                assert r is None
            else:
                assert r == pytest.approx(expected.loc[a, b], abs=1e-10)


def test_pairwise_complete(spark):
    df = spark.createDataFrame([(1., 2.), (2., None), (3., 1.), (4., 9.), (None, 3.)], "x double, y double")
    assert tt.correlation_matrix(df).first().r == pytest.approx(0.6758453353343745)


@pytest.mark.parametrize("n,known", [(1, ()), (2, ("std",)), (3, ("std", "skew")), (4, ("std", "skew", "kurtosis"))])
def test_few_rows(spark, n, known):
    row = tt.numeric_summary(spark.createDataFrame([(float(i * i),) for i in range(n)], "x double")).first()
    assert {m for m in ("std", "skew", "kurtosis") if row[m] is not None} == set(known)


def test_constant_and_skewed(spark):
    df = spark.createDataFrame([(7.5, v) for v in (1., 2., 2., 3., 9., 4.5, 7.)], "c double, s double")
    found = by_column(tt.numeric_summary(df, 8))
    assert (found["c"]["std"], found["c"]["skew"], found["c"]["kurtosis"]) == (0, 0, 0)
    assert found["s"]["skew"] == pytest.approx(0.88103735) and found["s"]["kurtosis"] == pytest.approx(-0.52718406)
    assert [r.flag for r in tt.anomaly_flags(df).collect()] == ["constant"]
    kinds = spark.sql("SELECT 's' AS s, DATE'2024-01-01' AS d, true AS b, CAST(NULL AS string) AS n, CAST(id AS string) AS v FROM range(5)")
    assert {(r["column"], r.flag) for r in tt.anomaly_flags(kinds).collect()} == {
        ("s", "constant"), ("d", "constant"), ("b", "constant"), ("n", "has_nulls")}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert tt.null_counts(df).first().n_null == 2
    assert tt.numeric_summary(df).first()["mean"] == 2.0
    assert tt.missing_profile(df).first().pct == 50.0


def test_empty_and_textless_tables(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert tt.numeric_summary(empty).count() == 0 and tt.table_shape(empty).first()["rows"] == 0
    assert tt.category_topk(empty).count() == 0
    numbers = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert tt.category_topk(numbers).count() == 0
    texts = spark.createDataFrame([("a",)], "s string")
    assert tt.correlation_pairs(texts).count() == 0 and tt.strongest_pair(texts).count() == 0
    lines = [r.line for r in tt.profile_text(texts, "t").orderBy("line_no").collect()]
    assert "Numeric Summary: none" in lines and "Correlations: insufficient numeric columns" in lines
    lines = [r.line for r in tt.profile_text(numbers, "t").collect()]
    assert "Categorical Columns: none" in lines and "Correlations: no pairs with |r| > 0.3" in lines


def test_strongest_pair_falls_back_to_the_first_two(spark):
    df = spark.createDataFrame([(1., 1., 1.), (1., 1., 1.)], "a double, b double, c double")
    assert tuple(tt.strongest_pair(df).first()) == ("a", "b")


def test_topk_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([(c,) for c in "gfedcbagfedcba"] + [(None,)], "s string")
    assert [(r.value, r.n) for r in tt.category_topk(df).orderBy("rank").collect()] == [(c, 2) for c in "abcde"]


def test_kpis_name_the_model_metrics(spark):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(5)], "a double, b double")
    rows = {(r.section, r.label): r.value for r in tt.kpi_summary(df, {"f1_score": 0.5}).collect()}
    assert rows["model", "F1 SCORE"] == "0.5000" and rows["correlation", "a×b"] == "-1.000"


def test_topk_limits_each_task_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "b")], "s string, t string")
    plan = tt.category_topk(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
