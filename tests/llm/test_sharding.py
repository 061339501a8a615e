import random
import zlib

import pytest

from tabletools.llm.queries import op4_sharding
from tabletools.llm.sharding import differencing, shard_documents

SF = "/root/testdata/sf0.01"


def check_shards(rows, docs, shards):
    """rows: results; docs: (doc_id, text). Rows match, equal texts share a shard, slots are gapless; returns bytes by shard."""
    def facts(doc_id, text):
        data = (text or "").encode()
        return doc_id, len(data) + 1, zlib.crc32(data)

    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=key) == sorted((facts(*d) for d in docs), key=key)
    of_text, of_id = {}, {}
    for r in rows:
        of_id.setdefault((r.doc_id, r.text_crc32), set()).add(r.shard)
    for doc_id, text in docs:
        of_text.setdefault(text or "", set()).update(of_id[doc_id, zlib.crc32((text or "").encode())])
    assert all(len(s) == 1 for s in of_text.values())
    out = [0] * shards
    for shard in range(shards):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        out[shard] = sum(r.size for r in own)
    assert sum(out) == sum(r.size for r in rows)
    return out


def test_query_balances_bytes(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op4_sharding(spark, SF).collect()
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    sizes = check_shards(rows, docs, 8)
    assert max(sizes) - min(sizes) <= 0.001 * sum(sizes) / 8
    again = {(r.doc_id, r.shard, r.slot) for r in op4_sharding(spark, SF).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_many_tasks(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    sizes = check_shards(shard_documents(table, shards=5, task_groups=40, range_rows=10).collect(), docs, 5)
    assert max(sizes) - min(sizes) <= max(len((t or "").encode()) for _, t in docs) + 1     # one group at most


@pytest.mark.parametrize("bins", [2, 3, 8])
def test_differencing(bins):
    rng = random.Random(bins)
    sizes = [rng.randrange(1, 10_000) for _ in range(500)]
    goes, total = differencing([[n] + [0] * (bins - 1) for n in sizes])
    mine = [sum(n for n, g in zip(sizes, goes) if g[0] == b) for b in range(bins)]
    assert mine == total and sum(mine) == sum(sizes)
    greedy = [0] * bins
    for n in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += n
    assert max(mine) - min(mine) <= max(max(greedy) - min(greedy), 5)
    assert differencing([]) == ([], [])
    assert differencing([[8, 7], [6, 5], [4, 0]])[1] in ([15, 15], [14, 16], [16, 14])


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a" * 1_000_000), (4, "b"), (None, "b"), (5, "ü"), (5, "ü")] + [(i, "hot") for i in range(6, 90)]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, digest string")
    check_shards(shard_documents(table).collect(), docs, 8)
    assert shard_documents(table.limit(0)).count() == 0
