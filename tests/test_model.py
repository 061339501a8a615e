import pytest
from pyspark.sql import functions as F

import tabletools as tt
import tabletools.functions.joins as joins
import tabletools.operators.model as model
from tabletools.operators.model import class_index, mark_test_rows


def numbers(spark, n, extra="id % 3"):
    return spark.range(n).withColumn("f", (F.col("id") % 10).cast("double")).withColumn("y", F.expr(extra)).repartition(3)


def test_gate_counts_exactly(spark):
    df = spark.range(400).select((F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).cast("string").alias("more"),
                                 F.col("id").cast("string").alias("unique"), F.lit(None).cast("string").alias("none"))
    found = {r["column"]: (r.n_distinct, r.kept) for r in tt.cardinality_gate(df).collect()}
    assert found == {"fifty": (50, True), "more": (51, False), "unique": (400, False), "none": (0, True)}


@pytest.mark.parametrize("size", [2 ** 20, 0])
def test_label_encode(spark, monkeypatch, size):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", size)
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("z", 4)], "s string, i int")
    assert [tuple(r) for r in tt.label_encode(df, ["s"]).orderBy("i").collect()] == [(1, 1), (0, 2), (2, 3), (3, 4)]
    wide = spark.range(600).select(F.format_string("%04d", "id").alias("s"), "id").repartition(5)
    assert all(r.s == r.id for r in tt.label_encode(wide, ["s"]).collect())


def test_split_needs_keys(spark):
    with pytest.raises(ValueError, match="keys"):
        tt.train_test_split(spark.range(9), [])
    row = tt.run_automl(numbers(spark, 200), "y", "regression", trees=2, depth=2)[0].first()
    assert row.train_samples and row.test_samples


def test_left_out_columns_are_named(spark):
    df = numbers(spark, 200).withColumn("s", F.col("id").cast("string"))
    assert tt.run_automl(df, "y", "regression", ["id"], trees=2, depth=2)[0].first().left_out == "s"
    assert tt.run_automl(df, "y", "regression", ["id"], trees=2, depth=2, max_cardinality=200)[0].first().left_out is None


@pytest.mark.parametrize("n", [1, 5, 20, 101, 1000])
@pytest.mark.parametrize("sort_rows", [100_000, 1])
def test_exact_split(spark, monkeypatch, n, sort_rows):
    monkeypatch.setattr(model, "SORT_ROWS", sort_rows)
    df = spark.range(n)
    for partitions in (1, 4):
        marked = mark_test_rows(df.repartition(partitions), ["id"], exact=True)
        assert marked.where("is_test").count() == -(-n // 5)
    train, test = tt.train_test_split(df, ["id"], exact=True)
    assert train.intersect(test).count() == 0 and train.union(test).distinct().count() == n


def test_split_does_not_depend_on_partitioning(spark):
    sides = [{r.id for r in tt.train_test_split(spark.range(500).repartition(p), ["id"])[1].collect()} for p in (1, 6)]
    assert sides[0] == sides[1] and 60 < len(sides[0]) < 140


def test_classes_of_numbers_sort_as_numbers(spark):
    train = spark.createDataFrame([(10,), (9,), (100,), (9,)], "y int")
    expected = [(9, 0), (10, 1), (100, 2)]
    assert sorted(tuple(r) for r in class_index(train, "y").collect()) == expected
    assert sorted(tuple(r) for r in class_index(train, "y", bound=1).collect()) == expected


@pytest.mark.parametrize("size", [2 ** 20, 0])
def test_unseen_class_becomes_class_zero(spark, monkeypatch, size):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", size)
    train = spark.createDataFrame([(1.0, "b"), (2.0, "c")], "f double, y string")
    test = spark.createDataFrame([(1.0, "c"), (3.0, "new")], "f double, y string")
    _, encoded = tt.encode_target(train, test, "y")
    assert {r.y: r.label for r in encoded.collect()} == {"c": 1.0, "new": 0.0}


def test_metrics(spark):
    multi = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "y int, p int")
    assert tt.accuracy(multi, "y", "p").first()[0] == 0.6667
    # F1 per class: 2/3, 1/2, 4/5 with support 2, 1, 3
    assert tt.f1_score(multi, "y", "p", 3).first()[0] == pytest.approx((2 * 2 / 3 + 1 / 2 + 3 * 4 / 5) / 6, abs=1e-4)
    binary = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    assert tt.f1_score(binary, "y", "p", 2).first()[0] == pytest.approx(2 / 3, abs=1e-4)
    none = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    assert tt.f1_score(none, "y", "p", 2).first()[0] == 0.0
    real = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    assert tt.rmse(real, "y", "p").first()[0] == pytest.approx((1.25 / 3) ** 0.5, abs=1e-4)
    assert tt.r2_score(real, "y", "p").first()[0] == pytest.approx(1 - 1.25 / (14 / 3), abs=1e-4)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert tt.r2_score(flat, "y", "p").first()[0] == 1.0


def error_of(result):
    return result[0].first().error


def test_row_gate(spark):
    assert "only 19 rows" in error_of(tt.run_automl(numbers(spark, 19), "y", "regression", ["id"]))
    assert error_of(tt.run_automl(numbers(spark, 20), "y", "regression", ["id"], trees=2, depth=2)) is None


def test_errors_are_values(spark):
    df = numbers(spark, 30)
    assert "Could not prepare" in error_of(tt.run_automl(df, "absent", "classification", ["id"]))
    assert "Could not prepare" in error_of(tt.run_automl(df.select("y"), "y", "regression", ["y"]))
    assert "not numeric" in error_of(tt.run_automl(numbers(spark, 30, "cast(id as string)"), "y", "regression", ["id"]))
    assert "missing values" in error_of(tt.run_automl(numbers(spark, 30, "nullif(id, 3)"), "y", "regression", ["id"]))
    flag = numbers(spark, 60, "f < 5")
    assert tt.run_automl(flag, "y", "regression", ["id"], trees=3, depth=3)[0].first().r2_score > 0.9
    skipped = tt.run_automl(df, None, None, ["id"])[0].first()
    assert skipped.skipped and skipped.error is None


def test_forest_learns_a_rule(spark):
    df = spark.range(1500).select("id", (F.hash("id") % 100).cast("double").alias("a"),
                                  F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("s"),
                                  F.current_timestamp().alias("t")) \
        .withColumn("y", F.when((F.col("a") > 10) & (F.col("s") == "x"), "yes").otherwise("no"))
    metrics, importances = tt.run_automl(df, "y", "classification", ["id"], trees=15, depth=5)
    row = metrics.first()
    assert row.error is None and row.accuracy > 0.95 and row.f1_score > 0.95
    assert row.train_samples + row.test_samples == 1500
    top = [r.feature for r in importances.collect()]
    assert set(top) == {"id", "a", "s"} and set(top[:2]) == {"a", "s"}
    squared = df.withColumn("y", F.col("a") * F.col("a"))
    row = tt.run_automl(squared, "y", "regression", ["id"], trees=15, depth=7, exact_split=True)[0].first()
    assert row.r2_score > 0.95 and row.test_samples == 300


def test_many_classes(spark):
    df = numbers(spark, 600, "id % 150")
    row = tt.run_automl(df, "y", "classification", ["id"], trees=2, depth=2)[0].first()
    assert row.error is None and row.accuracy is not None
