import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabletools as tt
import tabletools.functions.joins as joins


def test_rules(spark):
    def types(schema):
        return [r.chart_type for r in tt.recommend_charts(spark.createDataFrame([], schema)).orderBy("rank").collect()]

    assert types("s string") == [] and types("t timestamp") == []
    assert types("a int") == ["histogram"]
    assert types("a int, t date") == ["histogram", "line"]
    assert types("a int, s string, t date") == ["histogram", "bar", "box", "line"]
    assert types("a int, b int, s string, t date") == ["histogram", "bar", "scatter", "box", "line"]
    assert types("a int, b int, c int, s string, t date") == ["histogram", "bar", "heatmap", "scatter", "box", "line"]


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 3 + [(None,)], "x double")
    assert [(r.bin, r.n) for r in tt.histogram_data(df, "x").collect()] == [(0, 3)]


def test_histogram_maximum_falls_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(11)], "x double, y double")
    rows = {r.bin: (r.n, r.total) for r in tt.histogram_data(df, "x", "y", 5).collect()}
    assert rows == {0: (2, 2.0), 1: (2, 2.0), 2: (2, 2.0), 3: (2, 2.0), 4: (3, 3.0)}


@pytest.mark.parametrize("size,hot", [(2 ** 20, 100), (0, 20), (0, 0), (0, 10 ** 6)])
def test_box_on_all_join_paths(spark, monkeypatch, size, hot):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", size)
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    data = [("hot", float(v)) for v in [*range(60), 500]] + [("cold", 1.0), ("cold", 2.0), (None, 9.0), ("cold", None)]
    rows = {r.x: r for r in tt.box_data(spark.createDataFrame(data, "g string, v double").repartition(4), "g", "v").collect()}
    hot = pd.Series([v for g, v in data if g == "hot"])
    assert (rows["hot"].q1, rows["hot"].median, rows["hot"].q3) == tuple(hot.quantile([.25, .5, .75]))
    assert (rows["hot"].lower_whisker, rows["hot"].upper_whisker, rows["hot"].n_outliers) == (0.0, 59.0, 1)
    assert rows["cold"].n == 2 and set(rows) == {"hot", "cold"}


def test_violin_shares_add_up(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    df = spark.createDataFrame([("a", float(i % 17)) for i in range(200)] + [("b", 1.0)], "g string, v double")
    shares = tt.violin_data(df, "g", "v").groupBy("x").sum("share").collect()
    assert all(r[1] == pytest.approx(1.0) for r in shares) and len(shares) == 2


def test_pie_of_nothing(spark):
    df = spark.createDataFrame([("a", 0.0)], "g string, v double")
    assert tt.pie_data(df, "g", "v").first().share is None


def test_specs(spark):
    specs = spark.createDataFrame([("Bar ", "x", "", None), ("radar", "x", "y", "t"), ("violin", "q", None, "v")],
                                  "chart_type string, x_axis string, y_axis string, title string")
    assert [tuple(r) for r in tt.validate_chart_specs(specs).collect()] == [("bar", "x", None, "Chart")]
    drawn = tt.validate_chart_specs(specs, ["x"], tt.constants.DRAWN_CHART_TYPES).collect()
    assert [tuple(r) for r in drawn] == [("bar", "x", None, "Chart"), ("violin", None, None, "v")]


def test_chart_data_needs_its_axes(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a")], "x double, y double, s string")
    assert tt.chart_data(df, "scatter", "x", None) is None and tt.chart_data(df, "map", "x", "y") is None
    assert tt.chart_data(df, "heatmap", None, None).count() == 4
    assert tt.heatmap_data(df.select("x")).count() == 0
    for kind in ("bar", "line", "scatter", "histogram", "box", "pie", "area", "violin"):
        assert tt.chart_data(df, kind, "x", "y").count() == 1


def test_sample_of_points(spark):
    df = spark.range(100).selectExpr("id", "id AS a", "id * 2 AS b")
    picks = [sorted(map(tuple, tt.scatter_data(df.repartition(p), "a", "b", ["id"], 10).collect())) for p in (1, 5)]
    assert picks[0] == picks[1] and len(picks[0]) == 10
    assert tt.scatter_data(df, "a", "b").count() == 100
    with pytest.raises(ValueError):
        tt.scatter_data(df, "a", "b", max_points=5)


def test_choice_prefers_parsed_specs(spark, monkeypatch):
    parsed = spark.createDataFrame([(1, "pie")], "id int, chart_type string")
    rules = spark.createDataFrame([(1, "bar"), (2, "bar"), (2, "line")], "id int, chart_type string")
    for size in (2 ** 20, 0):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", size)
        rows = sorted(map(tuple, tt.choose_charts(parsed, rules).collect()))
        assert rows == [(1, "pie"), (2, "bar"), (2, "line")]


def test_fewer_charts_on_request(spark):
    empty = spark.createDataFrame([], "a int, b int, c int, s string, t date")
    assert [r.rank for r in tt.recommend_charts(empty, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_stacked_areas(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (1, "a", 1.0), (2, "b", 5.0), (2, None, 9.0), (3, "a", None)],
                               "x int, g string, y double")
    assert [tuple(r) for r in tt.area_data(df, "x", "y", group="g").collect()] == [
        (1, "a", 3.0, 0.0, 3.0), (1, "b", 3.0, 3.0, 6.0), (2, "b", 5.0, 0.0, 5.0)]


def kernel_sum(values, at):
    """A Gaussian density with Scott's bandwidth, value by value."""
    h = np.std(values, ddof=1) * len(values) ** -0.2
    return np.exp(-0.5 * ((at[:, None] - values[None]) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))


def test_violin_density_is_a_kernel_density(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": ["a"] * 700 + ["b"] * 300 + ["one"] + ["same"] * 4,
                          "v": np.concatenate([rng.normal(5, 2, 700), rng.choice([0.0, 50.0], 300) + rng.random(300), [3.0], [7.0] * 4])})
    frame = pd.concat([frame, pd.DataFrame({"g": ["a", None], "v": [np.nan, 1.0]})])
    found = tt.violin_density(spark.createDataFrame(frame).repartition(3), "g", "v").toPandas().sort_values(["x", "point"])
    assert set(found.x) == {"a", "b"}
    for g, curve in found.groupby("x"):
        own = frame[(frame.g == g) & frame.v.notna()].v.to_numpy()
        step = ((curve.y - curve.y.iloc[0]) / (curve.point - curve.point.iloc[0])).iloc[-1]
        assert curve.density.sum() * step == pytest.approx(1)
        exact = kernel_sum(own, curve.y.to_numpy())
        assert abs(curve.density.to_numpy() - exact).max() < 0.02 * exact.max()


def raster(points, width, low, high):
    """The lowest and highest pixel row that a line touches in each pixel column."""
    x, y = (np.array([p[i] for p in points], float) for i in (0, 1))
    column = np.minimum((x - low) / (high - low) * width, width - 1e-9).astype(int)
    out = {}
    for c in np.unique(column):
        own = y[column == c]
        out[int(c)] = (own[0], own[-1], own.min(), own.max())
    return out


def test_a_thinned_line_draws_the_same(spark):
    rng = np.random.default_rng(8)
    x = np.sort(rng.choice(10 ** 6, 5000, replace=False))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.cumsum(rng.normal(size=5000))})).repartition(4)
    whole = [tuple(r) for r in tt.line_data(df, "x", "y").collect()]
    thin = [tuple(r) for r in tt.line_data(df, "x", "y", max_points=400).collect()]
    assert len(thin) <= 400 < len(whole) == 5000 and set(thin) <= set(whole) and thin == sorted(thin)
    assert raster(thin, 100, x[0], x[-1]) == raster(whole, 100, x[0], x[-1])
    assert [tuple(r) for r in tt.line_data(df, "x", "y", max_points=5000).collect()] == whole
    dates = df.withColumn("x", F.timestamp_seconds("x"))
    assert tt.line_data(dates, "x", "y", max_points=40).count() <= 40
    assert tt.line_data(df.withColumn("x", F.lit(1)), "x", "y", max_points=4).count() == 1
    with pytest.raises(ValueError):
        tt.line_data(df.withColumn("x", F.col("x").cast("string")), "x", "y", max_points=40)
    with pytest.raises(ValueError):
        tt.line_data(df, "x", "y", max_points=3)
