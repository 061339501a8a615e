from collections import Counter

import pytest

import tabletools.functions.joins as joins
from tabletools.llm.mixing import mix, mixed_documents, taken_words
from tabletools.llm.queries import ORACLES, op9_mixing
from tools.check_oracles import compare, duck

SF = "/root/testdata/sf0.01"


def slow_targets(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess by weight until none is above; sizes: {source: words}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and rest * weight[s] / share > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in full else rest * weight[s] / share for s in order}
        full |= above


def test_query_equals_sql(spark):
    assert compare(op9_mixing(spark, SF), duck(SF), ORACLES["op9_mixing"]) == ""


def test_targets_and_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = op9_mixing(spark, SF).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for s, t in slow_targets(sizes).items():
        assert abs(target[s] - t) < 1e-6 * t and taken[s] == int(target[s])
    assert {(r.doc_id, r.taken) for r in op9_mixing(spark, SF).collect()} == {(r.doc_id, r.taken) for r in rows}


def test_any_run_of_slots_is_near_the_shares(spark):
    rows = [(i, f"s{i % 4}", 100 + i % 7) for i in range(2000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    streams, parts = mix(sized, block=64)
    target = {r.src: r.target for r in streams.select("src", "target").distinct().collect()}
    slots = sorted((r.position, r.src, r.n) for r in parts.groupBy("position", "src").sum("words")
                   .withColumnRenamed("sum(words)", "n").collect())
    assert len(slots) == len({s[0] for s in slots})
    total = sum(target.values())
    early = slots[:len(slots) * 4 // 5]
    for at in range(0, len(early) - 512, 512):
        words = {}
        for _, s, n in early[at:at + 512]:
            words[s] = words.get(s, 0) + n
        for s, t in target.items():
            assert abs(words.get(s, 0) / sum(words.values()) - t / total) < 0.03


def test_edges(spark):
    long = "w " * 200_000
    rows = [(1, None, None), (2, "", "a"), (3, "one two three", None), (None, "x y", "a"), (5, "p q r s", "b"),
            (6, long, "é"), (7, "same", "b"), (7, "same", "b"), (8, " \t\n", "t")]
    docs = spark.createDataFrame([(i, t, s, 9, 1) for i, t, s in rows],
                                 "doc_id long, text string, source string, n_chars int, size int")
    found = taken_words(docs).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = slow_targets(sizes)
    assert sorted(r.size for r in found) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert sum(r.taken for r in found) == sum(int(t) for t in targets.values())
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert taken_words(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_mixed_documents_are_whole(spark):
    """Each document as often as rounds take it; at the end of a source's last round the one that would be cut is taken if that is nearer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = {r.doc_id: r.size for r in taken_words(docs).collect()}
    taken = {r.doc_id: r.taken for r in taken_words(docs).collect() if r.taken}
    rows = mixed_documents(docs).collect()
    texts = {r.doc_id: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == texts[r.doc_id] for r in rows)
    times = Counter(r.doc_id for r in rows)
    assert times == {d: n // size[d] + (2 * (n % size[d]) >= size[d] and n % size[d] > 0) for d, n in taken.items()
                     if 2 * n >= size[d]}


def test_columns_of_any_name_and_repeated_rows(spark):
    rows = [(i, f"s{i % 2}", "w " * (5 + i % 3)) for i in range(20)]
    rows += rows[:10] + [(None, None, "a b c"), (None, None, "a b c"), (None, "s0", None), (3, "s1", "another text")]
    docs = spark.createDataFrame([(*r, *range(11)) for r in rows],
                                 "doc_id long, source string, text string, key int, taken int, _key int, _taken int, _words int, src int, "
                                 "size int, start int, position int, slot int, c0 int")
    out = mixed_documents(docs.repartition(3))
    assert out.schema == docs.schema
    found, distinct = out.collect(), {r for r in rows if r[2]}
    words, target = Counter(), slow_targets({s: sum(len(r[2].split()) for r in distinct if r[1] == s) for s in ("s0", "s1", None)})
    for r in found:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= 4.5 for s, t in target.items())
    assert {(r.doc_id, r.source, r.text) for r in found} <= distinct
    assert all(n <= 2 for n in Counter((r.doc_id, r.source, r.text) for r in found).values())


def test_facts_too_large_to_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = [tuple(r) for r in taken_words(docs).collect()]
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert [tuple(r) for r in taken_words(docs).collect()] == one


@pytest.mark.parametrize("name", ["op5_exact_dedup"])
def test_exact_dedup_query_equals_sql(spark, name):
    from tabletools.llm.queries import QUERIES
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) == ""
