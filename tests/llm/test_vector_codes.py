import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tabletools.llm.queries import ORACLES, op12_vector_codes
from tabletools.llm.vector_codes import compress, dictionaries, nearest
from tools.check_oracles import compare, duck

SF = "/root/testdata/sf0.001"


def slow_compress(rows, scale=256, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), lab) for i, v, lab in kept]
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def assign(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[assign(p, c[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(x) for x in zip(*own[n])) if n in own else e for n, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[assign(p, c[p]) for p in range(parts)] for c in cut]
    most = (1 << 63) - 1
    errors, of_label = [min(most, sum(d for d, _ in f)) for f in found], defaultdict(int)
    for (_, _, lab), e in zip(kept, errors):
        of_label[lab] += e
    return sorted(((i, "".join(f"{n:02x}" for _, n in f), e, min(most, of_label[lab]), digest)
                   for (i, _, lab), f, e in zip(kept, found, errors)), key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows],
                               "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    found = compress(df, **options)[0]
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == slow_compress(rows, **options)


def test_query_equals_sql(spark):
    assert compare(op12_vector_codes(spark, SF), duck(SF), ORACLES["op12_vector_codes"]) == ""


def test_many_blocks_equal_brute_force(spark, monkeypatch):
    from tabletools.llm import vector_codes
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    monkeypatch.setattr(vector_codes, "GATHER_ROWS", 10)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0, 0.3, 8).tolist(), int(rng.integers(3)) if i % 7 else None) for i in rng.permutation(300)]
    check(spark, rows, parts=4, entries=16, rounds=3)


def test_edges(spark):
    rows = [(1, [0.5, -0.001, 1.0], 1), (1, [0.5, -0.001, 1.0], 1), (2, None, 1), (3, [1.0, None], 2), (4, [float("nan")], 2),
            (5, [float("-inf"), 1.0], 2), (6, [], None), (7, [0.1] * 17, None), (None, [2.0], 3), (8, [-0.5, 0.001], 4)]
    check(spark, rows)
    check(spark, rows, entries=2)


def test_large_components(spark):
    check(spark, [(i, [10.0 ** (i % 12), -3.0 * 10.0 ** (i % 9)], 0) for i in range(30)], parts=2, entries=3)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert compress(df)[0].collect() == []
    only = spark.createDataFrame([(1, [], None)], "vec_id long, embedding array<float>, label int")
    assert compress(only)[0].first()["code"] == "00" * 16


def test_more_entries_than_a_code_can_tell(spark):
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), entries=257)


def test_tables_of_distinct_values_give_plain_distances():
    rng = np.random.default_rng(2)
    matrix, entries = rng.integers(-9, 9, (100, 3)).astype(float), rng.integers(-9, 9, (5, 3)).astype(object)
    values, codes = dictionaries(matrix)
    assert all((np.diff(v) > 0).all() for v in values)
    index, least = nearest(values, codes.T, entries)
    plain = ((matrix[:, None, :] - entries[None].astype(float)) ** 2).sum(axis=2)
    assert index.tolist() == plain.argmin(axis=1).tolist() and least.tolist() == plain.min(axis=1).tolist()
