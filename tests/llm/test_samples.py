"""A wanted document is one row of the training sample, however often it repeats."""

import pytest

from tabletools.llm import quality, toxicity


@pytest.mark.parametrize("module, fit, label", [(toxicity, "fit_toxicity", "toxic"), (quality, "fit_quality", "quality")])
def test_repeated_rows_are_learned_from_once(spark, monkeypatch, module, fit, label):
    docs = spark.createDataFrame([(1, "many equal rows")] * 500 + [(1, "a"), (1, None)] + [(i, f"text {i}") for i in (2, 3, 4)]
                                 + [(5, None), (6, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], f"doc_id long, {label} int")
    learned = []
    monkeypatch.setattr(module, "_train", learned.append)
    getattr(module, fit)(docs, labels, 5)
    assert sorted(zip(learned[0]["doc_id"].to_pylist(), learned[0][label].to_pylist())) == [(i, i % 2) for i in range(1, 6)]
    getattr(module, fit)(docs.limit(0), labels, 5)
    assert learned[1].num_rows == 0
