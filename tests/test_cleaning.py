import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabletools as tt
import tabletools.operators.cleaning as cleaning


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def make(spark, values, schema):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_dedup_treats_null_and_nan_as_equal(spark, monkeypatch, bound):
    monkeypatch.setattr(cleaning, "BROADCAST_FINGERPRINTS", bound)
    nan = float("nan")
    data = [(1, "a", nan), (1, "a", nan), (None, "a", 0.0), (None, "a", -0.0), (2, None, 1.0), (None, "2", 1.0)]
    df = make(spark, data, "k int, s string, x double").repartition(3)
    assert tt.duplicate_count(df).first()[0] == 2
    once = tt.drop_exact_duplicates(df)
    assert once.count() == 4
    assert tt.drop_exact_duplicates(once).count() == 4


def test_hot_duplicates(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k")).repartition(5)
    assert tt.duplicate_count(df).first()[0] == 299
    assert tt.drop_exact_duplicates(df).count() == 601


def test_half_null_stays(spark):
    df = make(spark, [(1, None, None), (None, None, None), (2, 3, 1), (None, None, 2)], "h int, m int, k int")
    assert tt.drop_sparse_columns(df).columns == ["h", "k"]


def test_fills(spark):
    df = make(spark, [(1, "b", True), (2, "a", None), (None, "b", True), (4, "a", False), (None, "c", None), (5, None, None)],
              "x bigint, s string, b boolean")
    assert [r.x for r in tt.fill_median(df).collect()] == [1, 2, 3, 4, 3, 5]
    assert dict(tt.fill_median(df).dtypes)["x"] == "double"
    filled = tt.fill_mode(df)
    assert filled.where("s IS NULL OR b IS NULL").count() == 0 and dict(filled.dtypes)["b"] == "boolean"
    assert filled.where("x = 5").first().s == "a"
    empty = make(spark, [None, None], "s string")
    assert [r.s for r in tt.fill_mode(empty).collect()] == ["Unknown"] * 2
    dates = make(spark, ["2024-01-02", "2024-01-02", "2024-01-03", None], "s string").select(F.to_timestamp("s").alias("t"))
    assert rows(tt.fill_mode(dates).groupBy(F.col("t").cast("string")).count()) == [("2024-01-02 00:00:00", 3), ("2024-01-03 00:00:00", 1)]


def test_fences_and_clip_equal_pandas(spark):
    values = [1., 2., 2., 3., 100., -50., 2.5, None, 4.]
    df = make(spark, [(v, i) for i, v in enumerate(values)], "x double, i int")
    s = pd.Series(values)
    q1, q3 = s.quantile(.25), s.quantile(.75)
    lower, upper = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    fence = [r for r in tt.iqr_fences(df).collect() if r["column"] == "x"][0]
    assert (fence.lower, fence.upper) == (lower, upper)
    clipped = tt.clip_outliers(df, tt.iqr_fences(df))
    assert [r.x for r in clipped.orderBy("i").collect()] == [None if pd.isna(v) else v for v in s.clip(lower, upper)]
    assert dict(clipped.dtypes)["i"] == "int"
    assert {r["column"]: r.n_outliers for r in tt.outlier_counts(df, tt.iqr_fences(df)).collect()} == {"x": 2, "i": 0}
    assert tt.iqr_fences(make(spark, [5.] * 9 + [80.], "x double")).count() == 0


@pytest.mark.parametrize("texts,kind", [
    (["2024-01-02"] * 8 + ["2024-1-2", "2024/01/02"], "timestamp"),
    (["2024/1/2", "2024/01/02"], "timestamp"),
    (["2024-01-02 10:00:00", "2024-01-02 10:00:00.25"], "timestamp"),
    (["2024-13-01", "2024-01-02"], "string"),
    (["2024-01-02", "x", "y"], "string"),
    ([None, None], "string"),
])
def test_dates(spark, texts, kind):
    df = make(spark, [(t, i) for i, t in enumerate(texts)], "s string, i int")
    assert dict(tt.parse_datetimes(df).dtypes)["s"] == kind


@pytest.mark.parametrize("text", [
    "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05-0130", "2024-01-02 03:04",
    "2024-01-02 03:04:05.123456789", "2024-01-02T03:04:05.5Z", "2024/01/02 03:04:05", "2024-01-02T03:04", "2024-01-02 03:04Z",
    "2024-01-02", "2024/01/02"])
def test_date_forms_as_pandas_reads_them(spark, text):
    parsed = tt.parse_datetimes(make(spark, [(text,)] * 3, "s string"))
    found = parsed.selectExpr("date_format(s, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS s").first().s
    expected = pd.to_datetime(pd.Series([text]), utc=True)[0].floor("us")
    assert found == expected.strftime("%Y-%m-%d %H:%M:%S.%f")


def test_all_texts_decide_on_dates(spark):
    df = make(spark, [(f"2024-01-{i + 1:02d}" if i < 20 else "word", i) for i in range(60)], "s string, i int").coalesce(1)
    assert dict(tt.parse_datetimes(df).dtypes)["s"] == "string" and not tt.fit_cleaning(df).formats


def test_report_of_an_empty_mode_and_of_a_boolean(spark):
    df = make(spark, [("", True)] * 5 + [("a", None), (None, False)], "s string, b boolean")
    messages = [r.message for r in tt.cleaning_report(tt.fit_cleaning(df.withColumn("i", F.monotonically_increasing_id()))).collect()]
    assert "Filled 1 null(s) in categorical column 's' with mode ('')." in messages
    assert "Filled 1 null(s) in categorical column 'b' with mode (True)." in messages


def test_date_rate_of_the_first_texts(spark):
    df = make(spark, [(f"2024-01-{i + 1:02d}" if i < 20 else "word", i) for i in range(28)], "s string, i int").repartition(4)
    assert tt.date_pattern_rate(df, ["i"]).first().match_rate == 1.0
    assert tt.date_pattern_rate(df).first().match_rate == pytest.approx(20 / 28)


def test_run_cleaning(spark):
    data = [(i, None if i % 4 == 0 else float(i % 7), None if i % 3 else "x", f"2024-01-{i % 28 + 1:02d}") for i in range(40)]
    df = make(spark, data + data[:5], "i int, x double, sparse string, d string").repartition(3)
    model = tt.fit_cleaning(df)
    cleaned = model.cleaned()
    assert cleaned.count() == 40 and cleaned.columns == ["i", "x", "d"]
    assert dict(cleaned.dtypes)["d"] == "timestamp"
    assert cleaned.where("x IS NULL OR d IS NULL").count() == 0
    assert rows(model.transform(df)) == rows(cleaned)
    again = tt.fit_cleaning(cleaned)
    assert rows(again.cleaned()) == rows(cleaned)
    report = {(r.kind, r.column, r.message): r.amount for r in tt.cleaning_report(model).collect()}
    assert report["summary", None, "rows_removed"] == 5 and report["summary", None, "columns_removed"] == 1
    assert report["action", None, "Dropped 5 exact duplicate rows."] == 5


def test_cleaning_a_table_without_findings_reads_it_in_place(spark):
    df = make(spark, [(1, "a"), (2, "b")], "k int, s string")
    model = tt.fit_cleaning(df)
    assert model.source is df
    assert [r.amount for r in tt.cleaning_report(model).collect()] == [0, 0, 0, 0]


def test_cleaning_an_empty_table(spark):
    cleaned, report = tt.run_cleaning(make(spark, [], "x double, s string"))
    assert cleaned.count() == 0 and report.count() == 4


def test_stream(spark, tmp_path):
    data = [(i, None if i % 4 == 0 else float(i)) for i in range(20)]
    df = make(spark, data, "i int, x double")
    model = tt.fit_cleaning(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    tt.append_clean_stream(model, stream, str(tmp_path / "out")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(model.cleaned())


def test_transform_is_one_projection(spark):
    df = make(spark, [(i, float(i) if i % 3 else None, "a" if i % 5 else None) for i in range(30)], "i int, x double, s string")
    plan = tt.fit_cleaning(df).cleaned()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
