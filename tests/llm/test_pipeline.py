"""Every stage of the pipeline against a plain version on its own input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tabletools.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert name == "packing" or after.columns == docs.columns
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "packing"]


def test_toxic_go_and_clean_stay(spark, stages):
    before, after = stages["toxicity"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in after}
    insults = {"trash", "pathetic", "idiot", "worthless", "moron", "scum"}
    for r in before:
        if len(insults & set(r.text.lower().split())) >= 3:
            assert r.doc_id not in left
    clean = [r.doc_id for r in before if toxic.get(r.doc_id) == 0]
    assert sum(d in left for d in clean) >= 0.99 * len(clean)


def test_one_of_equal_texts_stays(stages):
    before, after = stages["exact dedup"]
    best = {}
    for r in before:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())


def test_one_of_each_near_group_stays(stages):
    before, after = stages["simhash near-dedup"]
    prints = {}
    for r in before:
        hashes = shingle_hashes(r.text.encode())
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        prints[r.doc_id] = sum(1 << i for i, n in enumerate(bits) if 2 * n > len(hashes))
    ids = sorted(prints)
    values, group = np.array([prints[d] for d in ids], np.uint64), list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = group[i], group[j]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert sorted(r.doc_id for r in after) == sorted({ids[g] for g in group})


def test_mix_repeats_whole_documents(stages):
    before, after = stages["mixing"]
    sizes, words, taken, source = {}, {r.doc_id: r.text.split() for r in before}, {}, {r.doc_id: r.source for r in before}
    for d, w in words.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(w)
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        assert r.text == texts[r.doc_id]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words[r.doc_id])
    assert all(n <= 2 * len(words[d]) for d, n in taken.items())
    longest = {s: max(len(w) for d, w in words.items() if source[d] == s) for s in sizes}
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= sum(longest.values()) / 2 + len(sizes)


def test_packing_holds_every_id(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [tokenizer.encode(r.text, add_special_tokens=False).ids + [1] for r in before]
    assert sum(r.length for r in after) == sum(map(len, ids))
    forms = {}
    for r, own in zip(before, ids):
        forms.setdefault(r.doc_id, set()).add(tuple(own))
    for r in after:
        assert any(r.ids_crc32 == zlib.crc32(np.array(own[r.start:r.start + r.length], "<u4").tobytes())
                   and r.doc_tokens == len(own) for own in forms[r.doc_id])
