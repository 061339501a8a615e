import random

import numpy as np
import pytest
import xxhash

from tabletools.llm.components import components
from tabletools.llm.queries import op8_simhash_near_dedup
from tabletools.llm.simhash import covering_masks, keep_one_of_each, near_links, simhash_groups

WHITE = " \t\n\v\f\r"


def slow_print(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: {doc_id: fingerprint}; the smallest doc_id of each document's component."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    values = {}
    for d, p in prints.items():
        values.setdefault(p, []).append(d)
    keys = np.array(list(values), np.uint64)
    for i, p in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(keys ^ p) <= 2):
            a, b = find(values[int(p)][0]), find(values[int(keys[j])][0])
            root[max(a, b)] = min(a, b)
    for same in values.values():
        for d in same:
            a, b = find(same[0]), find(d)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in prints}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    least = slow_components(prints)
    rows = op8_simhash_near_dedup(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == \
        {(d, f"{p:016x}", least[d]) for d, p in prints.items()}
    assert len(rows) == len(texts)


def test_every_pair_within_two_bits_shares_a_key():
    masks = covering_masks(list(range(64)))
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


@pytest.mark.parametrize("small", [1, 2, 32])
def test_links_of_large_buckets(spark, small):
    rng = random.Random(small)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2 ** 64 - 1)
                   for _ in range(25)}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    links = components(near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), small=small))
    roots = {r.node: r.root for r in links.collect()}
    expected = slow_components({int(p): int(np.int64(p).astype(np.uint64)) for p in signed})
    assert {p: roots.get(p, p) for p in signed} == expected


def test_edges(spark):
    rows = [(1, "a b c d"), (2, "A  b\tc\nd"), (3, None), (4, ""), (5, " \n"), (6, "x"), (None, "x"), (7, "X"),
            (8, "Ünï b"), (8, "Ünï b"), (9, "long " * 300_000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    found = {}
    for r in simhash_groups(docs).collect():
        found.setdefault(r.doc_id, []).append((r.fp & (2 ** 64 - 1), r.component_id))
    assert found[1] == [(slow_print("a b c d"), 1)] and found[2] == [(slow_print("a b c d"), 1)]
    assert [found[i] for i in (3, 4, 5)] == [[(0, 3)]] * 3
    assert found[6][0][1] == found[7][0][1] == found[None][0][1] == 6
    assert found[8] == [(slow_print("Ünï b"), 8)] * 2
    assert found[9] == [(slow_print("long " * 5), 9)]
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 8, 8, 9]
    assert simhash_groups(docs.limit(0)).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, 301)} | {(2000, 1000)}
    assert components(links.limit(0)).count() == 0
