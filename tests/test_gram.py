import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabletools as tt
import tabletools.functions.gram as gram
from tabletools.functions.gram import block_correlations
from tabletools.functions.ranks import numbered


def frame(columns, rows, gaps, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(rows, columns)) + rng.normal(size=(rows, 1)) * rng.random(columns) * 2 + rng.normal(size=columns) * 1e6
    values[rng.random(values.shape) < gaps] = np.nan
    return pd.DataFrame(values, columns=[f"c{i}" for i in range(columns)])


def plain(data):
    return data.corr(min_periods=2).to_numpy()


def as_matrix(rows, n):
    found = np.full((n, n), np.nan)
    for r in rows:
        found[r.ia, r.ib] = np.nan if r.r is None else r.r
    return found


@pytest.mark.parametrize("columns,gaps,block,tile,fan", [(40, 0.0, 7, 2, 2), (40, 0.2, 7, 2, 2), (40, 0.1, 64, 1, 64), (5, 0.0, 5, 1, 64)])
def test_blocks_equal_pandas(spark, monkeypatch, columns, gaps, block, tile, fan):
    for name, value in (("BLOCK", block), ("TILE", tile), ("FAN", fan)):
        monkeypatch.setattr(gram, name, value)
    data = frame(columns, 300, gaps)
    if columns > 20:
        data["c3"], data["c17"], data["c20"] = 5.0, np.nan, data["c2"] * -2
    df = spark.createDataFrame(data).repartition(5)
    missing = data.isna().any().tolist()
    rows = block_correlations(df, list(data), data.mean().fillna(0.0).tolist(), missing).collect()
    upper = np.triu(np.ones((columns, columns), bool), 1)
    assert len(rows) == upper.sum() and all((r.a, r.b) == (f"c{r.ia}", f"c{r.ib}") for r in rows)
    want = plain(data)
    want[[c for c in (3, 17) if columns > 20]] = np.nan
    want[:, [c for c in (3, 17) if columns > 20]] = np.nan
    assert np.allclose(as_matrix(rows, columns)[upper], want[upper], equal_nan=True, atol=1e-8)


def test_two_thousand_columns(spark):
    data = frame(2000, 80, 0.0)
    df = spark.createDataFrame(data).repartition(3)
    table = block_correlations(df, list(data), data.mean().tolist(), [False] * 2000)
    facts = table.agg(F.count("*"), F.sum("r"), F.count_if(F.abs("r") > 0.9)).first()
    upper = plain(data)[np.triu_indices(2000, 1)]
    assert facts[0] == 2000 * 1999 // 2 and facts[1] == pytest.approx(upper.sum()) and facts[2] == (abs(upper) > 0.9).sum()
    ranked = numbered(table.where("abs(r) > 0.85"), [F.desc(F.abs("r")), "ia", "ib"], "rank")
    best = ranked.where("rank <= 50").orderBy("rank").collect()
    assert [r["rank"] for r in best] == list(range(1, 51))
    assert np.allclose([abs(r.r) for r in best], np.sort(abs(upper))[::-1][:50])


def test_wide_tables_give_what_narrow_ones_give(spark, monkeypatch):
    data = frame(9, 200, 0.1)
    df = spark.createDataFrame(data)
    results = []
    for narrow in (12, 2):
        monkeypatch.setattr("tabletools.operators.profile.NARROW_COLUMNS", narrow)
        results.append([[tuple(r) for r in q.collect()] for q in (
            tt.correlation_pairs(df, 0.1).orderBy("rank"), tt.strongest_pair(df), tt.profile_text(df, "t").orderBy("line_no"),
            tt.heatmap_data(df).select("a", "b", F.round("r", 9)).orderBy("a", "b"), tt.kpi_summary(df).orderBy("seq"))])
    assert results[0] == results[1]


def test_no_rows_and_no_columns(spark):
    empty = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(20)))
    assert tt.correlation_matrix(empty).where("r IS NULL").count() in (0, 190)
    assert tt.correlation_pairs(empty).count() == 0 and tt.strongest_pair(empty).first().a == "c0"
    assert tt.correlation_matrix(spark.createDataFrame([(1.0,)], "c double")).count() == 0
