"""Facts joined back to rows: by shuffle once a count shows that they are many, whatever Spark estimates."""

import pytest
from pyspark.sql import functions as F

import tabletools as tt
from tabletools.functions import joins
from tabletools.sources.staging import stage


def _nodes(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 40).alias("k"))
    facts = stage(spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"), (F.col("id") % 20).alias("n")), "facts")
    return rows, facts


@pytest.mark.parametrize("size", [None, "n"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_many_facts_are_not_broadcast(tables, monkeypatch, size, how):
    rows, facts = tables
    monkeypatch.setattr(joins, "HOT_ROWS", 15)
    joined = joins.join_group_facts(rows, facts, ["k"], "id", how, size=size, broadcast_rows=0)
    if size is None:
        assert "Broadcast" not in _nodes(joined)
    assert sorted((r.id, r.v) for r in joined.collect()) == sorted((r.id, r.v) for r in rows.join(facts, "k", how).collect())


def test_unseen_targets_among_many_classes(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    table = spark.range(300).select("id", F.when(F.col("id") % 11 > 0, F.format_string("name %03d", "id")).alias("name"))
    train, test = tt.train_test_split(table, ["id"])
    parts = tt.encode_target(train, test, "name")
    # one join shuffles; that with the keys of classes of many rows, of which there are none, is a broadcast
    for part in parts:
        assert "SortMergeJoin" in _nodes(part)
    place = {name: i for i, name in enumerate(sorted(r.name for r in train.collect() if r.name))}
    for part in parts:
        assert all(r.label == place.get(r.name, 0) for r in part.collect())
    assert sum(p.count() for p in parts) == 300


def test_labels_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    table = spark.range(300).select("id", F.when(F.col("id") % 11 > 0, F.format_string("name %03d", "id")).alias("name"))
    encoded = tt.label_encode(table, ["name"])
    assert "SortMergeJoin" in _nodes(encoded)
    texts = {r.id: r.name or "nan" for r in table.collect()}
    place = {name: i for i, name in enumerate(sorted(set(texts.values())))}
    assert {r.id: r.name for r in encoded.collect()} == {i: place[t] for i, t in texts.items()}
