import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tabletools.functions.joins as joins
import tabletools.functions.quantiles as quantiles
from tabletools.functions.quantiles import column_quantiles, from_ordered_bits, group_quantiles, ordered_bits

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def frames():
    rng = np.random.default_rng(7)
    n = 4000
    third = rng.random(n) < 0.35
    yield pd.DataFrame({
        "smooth": rng.normal(size=n), "heavy": rng.lognormal(sigma=6, size=n),
        "hot": np.where(third, 0.0, rng.normal(size=n)), "two": rng.integers(0, 2, n).astype(float),
        "steps": np.round(rng.random(n), 1), "wide": rng.choice([-1e300, 1e300, 0.5, 1e-300], n),
        "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.random(n))})


@pytest.mark.parametrize("listed,held", [(50_000, 1 << 18), (100, 50), (0, 1)])
def test_columns_equal_pandas(spark, monkeypatch, listed, held):
    monkeypatch.setattr(quantiles, "LISTED_ROWS", listed)
    monkeypatch.setattr(quantiles, "HELD_CELLS", held)
    for frame in frames():
        df = spark.createDataFrame(frame).repartition(5)
        found = column_quantiles(df, list(frame), PROBS)
        for c in frame:
            expected = frame[c].quantile(PROBS)
            assert np.allclose([found[c][p] for p in PROBS], expected, rtol=1e-12), c


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-100, 100, allow_nan=False, width=16), min_size=1, max_size=40), st.floats(0, 1))
def test_any_list_equals_pandas(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    exact = column_quantiles(df, ["x"], [p])["x"][p]
    assert exact == pytest.approx(float(pd.Series(values, dtype="float64").quantile(p)), abs=1e-9)


def test_empty_column_has_none(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert column_quantiles(df, ["x"], [0.5]) == {"x": {0.5: None}}


@pytest.mark.parametrize("group_values,size", [(1_000_000, 2 ** 20), (300, 2 ** 20), (20, 2 ** 20), (300, 0)])
def test_groups_equal_pandas_with_a_hot_key(spark, monkeypatch, group_values, size):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", size)
    rng = np.random.default_rng(3)
    n = 3000
    frame = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 200, n).astype(str)),
                          "v": np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n))})
    df = spark.createDataFrame(frame).repartition(4)
    found = {r.g: (r.n, r.q) for r in group_quantiles(df, "g", "v", [0.25, 0.5, 0.9], group_values).collect()}
    expected = frame.groupby("g").v.quantile([0.25, 0.5, 0.9]).unstack()
    assert set(found) == set(expected.index)
    for g, (n, q) in found.items():
        assert np.allclose(q, expected.loc[g]) and n == (frame.g == g).sum(), g


def test_a_value_that_fills_its_group(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": "one", "v": np.concatenate([np.full(3000, 7.0), rng.normal(size=400), 8 + rng.random(400)])})
    df = spark.createDataFrame(frame).repartition(3)
    edges = [(np.sum(frame.v < 7) - 0.4) / (len(frame) - 1), (np.sum(frame.v <= 7) - 0.4) / (len(frame) - 1)]
    probs = [0.01, *edges, 0.1052, 0.5, 0.894, 0.99]
    found = group_quantiles(df, "g", "v", probs, group_values=20).first().q
    assert np.allclose(found, frame.v.quantile(probs))
    rare = column_quantiles(df, ["v"], probs)["v"]
    assert np.allclose([rare[p] for p in probs], frame.v.quantile(probs))


def test_bits_in_the_order_of_the_doubles():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.0]])
    values = np.unique(values)
    bits = ordered_bits(values)
    assert (np.diff(bits.astype(object)) > 0).all()
    assert [from_ordered_bits(int(b)) for b in bits] == values.tolist()
    assert ordered_bits(np.array([-0.0])) == ordered_bits(np.array([0.0]))


@pytest.mark.parametrize("listed,most", [(0, 4), (50_000, 2)])
def test_four_passes_at_most(spark, monkeypatch, listed, most):
    """For any number of columns and probabilities, also of values that differ in their last bits only."""
    monkeypatch.setattr(quantiles, "LISTED_ROWS", listed)
    passes = []
    real = quantiles._pass
    monkeypatch.setattr(quantiles, "_pass", lambda rows, targets: passes.append(len(targets)) or real(rows, targets))
    n, rng = 3000, np.random.default_rng(1)
    close = 1.0 + rng.integers(0, 10 ** 6, n) * 2.0 ** -52
    frame = pd.DataFrame({f"c{i}": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n) for i in range(30)}
                         | {"close": close, "inf": np.where(rng.random(n) < 0.2, np.inf, close), "same": 7.0})
    found = column_quantiles(spark.createDataFrame(frame), list(frame), PROBS)
    assert len(passes) <= most
    for c in frame:
        values = np.sort(frame[c].to_numpy())
        for p in PROBS:
            low, high, share = quantiles.linear_position(n, p)
            want = values[low] if values[low] == values[high] or not share else values[low] + (values[high] - values[low]) * share
            assert found[c][p] == want
