import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletools.llm.queries import ORACLES, op11_topk_search
from tabletools.llm.topk_search import posting_lists, search_block, top_k
from tools.check_oracles import compare, duck

SF = "/root/testdata/sf0.001"
ROWS = [(100, [1.0, 0.5]), (200, [1.0, 0.5]), (200, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-1.0, 0.0]),
        (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [2.0]),
        (10, [0.0, 0.0]), (11, [1.0, 0.5, 3.0]), (None, [1.0, 0.5]), (300, [0.0, 0.0]), (400, None), (12, [0.0003, -0.0003])]


def slow_search(rows, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, vector in whole:
        if q is None or q % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v)), i is None, i or 0) for i, v in whole if i != q]
        out += [(q, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def table(spark):
    rows = [(i, v, "x", 1, 2) for i, v in ROWS]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, q_block int, n int").repartition(3)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}])
@pytest.mark.parametrize("k", [1, 3, 30])
def test_edges_equal_brute_force(spark, options, k):
    found = top_k(table(spark), F.col("vec_id") % 100 == 0, k, **options)
    assert sorted([tuple(r) for r in found.collect()], key=str) == slow_search(ROWS, k)


def test_query_equals_sql(spark):
    assert compare(op11_topk_search(spark, SF), duck(SF), ORACLES["op11_topk_search"]) == ""


def test_many_blocks(spark, monkeypatch):
    from tabletools.llm import topk_search
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 11)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(0, 3000, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for options in ({}, {"broadcast_rows": 0}):
        found = top_k(df, F.col("vec_id") % 100 == 0, 10, 2, **options).collect()
        whole = [(i, [2 * int(x) for x in v]) for i, v in rows]
        want = [(q, rank, i, -s) for q, v in whole if q % 100 == 0 for rank, (s, i) in enumerate(
            sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:10], 1)]
        assert sorted(map(tuple, found)) == sorted(want)


def test_empty_table_and_no_queries(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty, F.col("vec_id") % 100 == 0).collect() == []
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert top_k(rows, F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(alone, F.col("vec_id") % 100 == 0).collect() == []


def test_posting_lists_leave_out_zeros():
    lists = posting_lists(np.array([[1, 0], [2, 5], [3, 0]]))
    assert lists[0][0] == slice(None) and lists[1][0].tolist() == [1] and lists[1][1].tolist() == [5]


@pytest.mark.parametrize("size", [1, 1 << 14, 1 << 24, 1 << 40])
def test_wide_scores(size):
    queries, vectors = np.array([[size, -size]], float), np.array([[size, 1], [0, 0], [-size, size]], float)
    ids, scores = search_block(np.array([50]), queries, np.array([1, 2, 3]), vectors, 2)
    exact = {1: size * size - size, 2: 0, 3: -2 * size * size}
    most = (1 << 63) - 1
    assert dict(zip(ids[0].tolist(), scores[0].tolist())) == {i: min(most, exact[i]) for i in (1, 2)}
