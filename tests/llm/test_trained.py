"""Toxicity and quality: held-out accuracy, counts against brute force, edge tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabletools.llm.quality import judge_quality
from tabletools.llm.queries import op2_toxicity, op7_quality_rules
from tabletools.llm.toxicity import LabelModel, drop_toxic, score_documents

SF = "/root/testdata/sf0.1"
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (None, "a b c"), (6, "é ü " * 200_000), (7, "same line\nsame line\n\nsame line"),
         (7, "same line\nsame line\n\nsame line"), (8, "#$ | <> & * %"), (9, "x\r\ny\r\nx\r\n" * 3)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, 0.5) for i, t in EDGES], "doc_id long, text string, bias double")


def test_toxicity_on_held_out_rows(spark):
    rows = op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    told = [r for r in rows if r.held_out and r.toxic is not None]
    toxic, clean = ([r for r in told if r.toxic == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    scores = np.array([r.score for r in clean])
    assert np.mean([(scores < r.score).mean() + (scores == r.score).mean() / 2 for r in toxic]) > 0.95


def test_label_model_discounts_copied_voters():
    rng = np.random.default_rng(5)
    truth = (rng.random(4000) < 0.2).astype(float)
    good = (rng.random((4000, 3)) < np.where(truth, 0.8, 0.05)[:, None]).astype(float)
    weak = (rng.random(4000) < np.where(truth, 0.35, 0.25)).astype(float)
    labels = np.where(rng.random(4000) < 0.1, 1 - truth, truth)
    model = LabelModel(np.column_stack([good, *[weak] * 8]), labels)
    assert model.independence[3:].max() < 0.2 and model.independence[:3].min() > 0.4
    assert ((model.posterior > 0.5) == (truth > 0.5)).mean() > (labels == truth).mean()


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    for table in (labels, labels.limit(0)):
        scored = score_documents(edges, table)
        assert scored.columns == ["doc_id", "text", "bias", "score"]
        scores = [r.score for r in scored.collect()]
        assert len(scores) == len(EDGES) and all(0 <= s <= 1 for s in scores)
    kept = drop_toxic(edges, labels.limit(0))
    assert kept.columns == edges.columns and kept.count() == len(EDGES)
    assert score_documents(edges.limit(0), labels).count() == 0


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def check_counts(r, text):
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(text)
    assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert not (r.kept and r.base_failed)


def test_quality_counts_and_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check_counts(r, texts[r.doc_id])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    told = [r for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == bool(labels[r.doc_id]) for r in told]) > 0.95


def test_quality_score_on_unlabelled_halves(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = judge_quality(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = judged.select("quality", "quality_rules.*").where("NOT base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95
    sure = [r for r in rows if r.score > 0.9]
    assert np.mean([r.quality for r in sure]) > 0.9                 # calibrated


def test_quality_edges(spark, edges):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for table in (labels, labels.limit(0)):
        judged = judge_quality(edges, table)
        assert judged.columns == ["doc_id", "text", "bias", "quality_rules"]
        rows = judged.select("text", "quality_rules.*").collect()
        assert len(rows) == len(EDGES)
        for r in rows:
            check_counts(r, r.text)
    assert judge_quality(edges.limit(0), labels).count() == 0
