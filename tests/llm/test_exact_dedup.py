import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletools.llm.exact_dedup import PerfectHash, drop_exact_copies, exact_groups

ROWS = [(1, "a"), (9, "a"), (4, "a"), (2, None), (3, ""), (5, "ü" * 200_000), (6, "b"), (7, "A"), (None, "a"), (None, "n"), (8, "b"),
        (8, "b")] + [(i, "hot") for i in range(100, 400)]


def slow_groups(rows):
    best, size = {}, {}
    for i, t in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        best[t] = max((x for x in (best.get(t), i) if x is not None), default=None)
    return sorted(((i, best[t or ""], size[t or ""], i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
                   for i, t in rows), key=str)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, digest string, n int")


@pytest.mark.parametrize("historical", [None, "true", "false", "doc_id % 2 = 0"])
def test_groups_for_any_history(table, historical):
    if historical is not None:
        historical = F.coalesce(F.expr(historical), F.lit(False))
    rows = exact_groups(table, historical).collect()
    assert sorted((tuple(r) for r in rows), key=str) == slow_groups(ROWS)


def test_dropping_leaves_one_of_each(table):
    left = drop_exact_copies(table)
    assert left.columns == table.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, len(r.text or "")) for r in left.collect()) == \
        [(-1, 1), (3, 0), (5, 200_000), (7, 1), (8, 1), (9, 1), (399, 3)]
    assert drop_exact_copies(table.limit(0)).count() == 0 and exact_groups(table.limit(0)).count() == 0


def test_null_and_empty_are_equal_in_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, "x", "c"), (2, "x", "d"), (None, None, "e")],
                                 "doc_id long, text string, digest string")
    left = drop_exact_copies(docs).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == [(1, ""), (2, "x")]
    assert all((r.doc_id, r.text, r.digest) in {tuple(x) for x in docs.collect()} for r in left)


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_the_hash_is_perfect_and_minimal(n):
    rng = np.random.default_rng(n)
    digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    index = PerfectHash.build(digests)
    assert sorted(index.slots(digests).tolist()) == list(range(n))
    others = index.slots(rng.integers(0, 256, (50, 32), dtype=np.uint8))
    assert ((others >= -1) & (others < max(n, 1))).all()
