import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tabletools as tt
import tabletools.functions.values as values
from tabletools.functions.values import distinct_counts, top_values


def slow_top(texts, k):
    counts = Counter(t for t in texts if t is not None)
    best = sorted(counts.items(), key=lambda p: (-p[1], p[0].encode()))[:k]
    return [(v, n, i) for i, (v, n) in enumerate(best, 1)]


def found_top(df, columns, k):
    found = {c: [] for c in columns}
    for r in top_values(df, columns, k).orderBy("rank").collect():
        found[r["column"]].append((r.value, r.n, r["rank"]))
    return found


def table(spark, columns):
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)).repartition(4)


def columns_of_all_sorts():
    rng = random.Random(3)
    n = 400
    long = "x" * 900
    return {
        "few": [rng.choice(["b", "a", "ç", None]) for _ in range(n)],
        "unique": [f"{i:05d}" for i in rng.sample(range(10 ** 5), n)],
        "a long beginning": [long + rng.choice(["", "a", "ab", "b" * 70, f"{i}"]) for i in range(n)],
        "unique and long": [long + f"{i:05d}" for i in rng.sample(range(10 ** 5), n)],
        "long.then short": [rng.choice([long, long[:64], long[:63], "", "x", "🙂" * 100, "🙂" * 64]) for _ in range(n)],
        "none": [None] * n,
        "value": [rng.choice(["v" * 65, "v" * 64 + "u", "v" * 64]) for _ in range(n)],
        "n": [rng.choice("aab") * rng.choice([1, 100, 1000]) for _ in range(n)]}


@pytest.mark.parametrize("k", [1, 3, 20, 500])
def test_top_values_equal_brute_force(spark, k):
    columns = columns_of_all_sorts()
    assert found_top(table(spark, columns), list(columns), k) == {c: slow_top(v, k) for c, v in columns.items()}


def test_distinct_counts(spark):
    columns = columns_of_all_sorts()
    assert distinct_counts(table(spark, columns), list(columns)) == {c: len({x for x in v if x is not None}) for c, v in columns.items()}
    assert distinct_counts(spark.range(1), []) == {}


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch, bits):
    """Under the first two seeds a hash is 0, or a few bits."""
    real = values.value_hash
    monkeypatch.setattr(values, "value_hash", lambda v, seed: real(v, seed).bitwiseAND(F.lit((1 << bits) - 1)) if seed in (0, 1) else real(v, seed))
    columns = columns_of_all_sorts()
    assert found_top(table(spark, columns), list(columns), 3) == {c: slow_top(v, 3) for c, v in columns.items()}
    assert distinct_counts(table(spark, columns), list(columns)) == {c: len({x for x in v if x is not None}) for c, v in columns.items()}


def test_hashes_that_never_tell_texts_apart_raise(spark, monkeypatch):
    real = values.value_hash
    monkeypatch.setattr(values, "value_hash", lambda v, seed: F.lit(0).cast("long") if seed >= 0 else real(v, seed))
    with pytest.raises(RuntimeError, match="share a hash"):
        top_values(table(spark, columns_of_all_sorts()), ["few"], 1)


def test_empty_table_and_no_columns(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert top_values(empty, ["a", "b"], 3).collect() == []
    assert top_values(empty, [], 3).columns == ["column", "value", "n", "rank"]
    assert distinct_counts(empty, ["a", "b"]) == {"a": 0, "b": 0}


def test_whole_texts_are_not_shuffled(spark, monkeypatch):
    """What crosses the network is a few times the result, not the table."""
    seen = []
    real = values._merged

    def merged(hashed, *keys):
        seen.append(hashed.agg(F.max(F.octet_length("shown"))).first()[0])
        return real(hashed, *keys)

    monkeypatch.setattr(values, "_merged", merged)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    assert len(tt.category_topk(docs).collect()) == 5
    assert max(seen) <= 4 * values.SHOWN < docs.agg(F.max(F.octet_length("text"))).first()[0]
    plan = top_values(docs, ["text"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan and "IN (" in plan.replace("INSET", "IN (")


def test_mode_of_long_texts(spark):
    long = "y" * 5000
    df = spark.createDataFrame([(long + "b",), (long + "b",), (long + "a",), (long + "a",), (None,), ("z",)], "s string")
    assert tt.fill_mode(df).where(F.col("s") == long + "a").count() == 3
    gate = tt.cardinality_gate(df).first()
    assert (gate.n_distinct, gate.kept) == (3, True)
