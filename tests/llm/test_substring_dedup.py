import hashlib
import random
import re
from collections import Counter

import pytest

from tabletools.llm.queries import op3_substring_dedup
from tabletools.llm.substring_dedup import remove_repeats


def slow_cut(texts, size):
    """texts: a list; for each the number of words, of removed words, and the kept text."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = {(d, n, gone, hashlib.sha256(kept.encode()).hexdigest())
                for (d, _), (n, gone, kept) in zip(docs, slow_cut([t for _, t in docs], 35))}
    rows = op3_substring_dedup(spark, sf).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows} == expected
    assert len(rows) == len(docs)


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, seed):
    """Few distinct words, so that repeats overlap, touch and sit inside each other and inside one text."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(20, 90))] for _ in range(6)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randrange(25))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a:a + rng.randrange(1, 60)] * rng.choice([1, 1, 1, 2])
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs).collect()}
    assert found == dict(enumerate(slow_cut(texts, 35)))


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    texts = [None, "", " \n\t", "a " * 34, "b " * 35, "c " * 36, "é " * 100, long, " ".join(f"u{i}" for i in range(50)),
             " ".join(f"u{i}" for i in range(10, 45)), " ".join(f"u{i}" for i in range(12, 46)) + " end"]
    ids = list(range(len(texts))) + [None, 50, 50]
    texts += ["x " * 40, "same words " * 30, "same words " * 30]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in zip(ids, texts)],
                                 "doc_id long, text string, row int, spans string")
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept)
                  for r in remove_repeats(docs).collect())
    expected = [(i if i is not None else -1, *c) for i, c in zip(ids, slow_cut(texts, 35))]
    assert rows == sorted(expected)
    assert remove_repeats(docs.limit(0)).count() == 0
