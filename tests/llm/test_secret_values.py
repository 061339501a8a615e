"""Every value in a credential context is scored, whatever other spans it meets and however short it is."""

import pytest

from tabletools.llm.queries import op1_secret_scans
from tabletools.llm.secret_scans import _CONTEXT, LEAST_COST, find_secrets, guess_cost, scan_secrets

SF = "/root/testdata/sf0.01"


def test_tail_behind_a_base_span_is_marked():
    text = 'password = "hunter22!x9#Kq7$Lm"'
    assert find_secrets(text) == [("assign", 0, 20), ("cost", 12, 30)] and text[12:30] == "hunter22!x9#Kq7$Lm"


def test_short_values_are_scored():
    value = "#~&%|+^"
    assert len(value) == 7 and guess_cost(value) >= LEAST_COST
    assert find_secrets("pwd: " + value) == [("cost", 5, 12)]
    assert find_secrets("pwd: x9Kq27") == []


@pytest.mark.parametrize("text, spans", [
    ("token = x9Kq27vLmT0z", [("assign", 0, 20), ("cost", 8, 20)]), ("token = changeme", [("assign", 0, 16)]),
    ("auth: " + "0a7f" * 2 + "19c3be52" * 2 + "d", [("hex", 6, 31), ("cost", 6, 31)])])
def test_values_inside_of_base_spans_are_scored(spark, text, spans):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(s) for s in scan_secrets(docs).first().secrets] == spans


def test_query_holds_every_costly_value(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = 0
    for r in op1_secret_scans(spark, SF).collect():
        costly = {f"cost:{m.start(1)}:{m.end(1)}" for m in _CONTEXT.finditer(texts[r.doc_id] or "") if guess_cost(m[1]) >= LEAST_COST}
        assert {s for s in r.spans.split(",") if s.startswith("cost")} == costly and r.n_cost == len(costly)
        total += r.n_cost
    assert total
