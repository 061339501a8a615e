import hashlib
import re

import pytest

from tabletools.llm.queries import op1_secret_scans
from tabletools.llm.secret_scans import LEAST_COST, find_secrets, guess_cost, scan_secrets

SF = "/root/testdata/sf0.01"
LETTERS = "(?i:password|passwd|secret|token|api_?key)"


def base_spans(text):
    """The fixed patterns, letter by letter from the contract; keywords hold no letter that another one folds to."""
    text = text or ""
    found = []
    for m in re.finditer(LETTERS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if m[0].isascii() and len(m[1]) >= 6:
            found.append(("assign", *m.span()))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_secret_scans(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("cost")] == ([joined] if joined else []) \
            or r.spans.split(",") == joined.split(",") or set(joined.split(",")) <= set(r.spans.split(","))


@pytest.mark.parametrize("text", [
    "token: a token: abcdef", "secret=token=abcdef", "PassWord = 'Abc/+123=='", "api_key:abcde api_key:abcdef",
    "paſſword=abcdefg", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "AKIAAKIA" + "0" * 11, "0" * 23 + "g" + "0" * 24 + "G",
    "é token='" + "f" * 30 + "'", "token =\tabcdefgh", "tokentoken:::abcdef", ""])
def test_base_spans(text):
    assert [s for s in find_secrets(text) if s[0] != "cost"] == base_spans(text)


def test_cheap_and_costly_values():
    for cheap in ("password", "P@ssw0rd", "qwertyuiop", "aaaaaaaaaaaa", "abcdefgh", "19991231", "abcabcabcabc", "changeme",
                  "letmein123456", "summer2024", "zxcvbnm", "", "hello.world"):
        assert guess_cost(cheap) < LEAST_COST, cheap
    for costly in ("x9Kq27vLmT0z", "correcthorsebatterystaple", "gH7!pQ2#vR9$"):
        assert guess_cost(costly) >= LEAST_COST - 1.5, costly
    assert guess_cost("x9Kq27vLmT0z") > guess_cost("x9Kq27") > guess_cost("x9") > 0


def test_cost_is_the_cheapest_segmentation():
    """Every value costs at most brute force, and at most the sum over any two parts and their seam."""
    for value in ("password1999aaaa", "qwerty7Kx", "2024-01-31secret"):
        for i in range(1, len(value)):
            assert guess_cost(value) <= guess_cost(value[:i]) + guess_cost(value[i:]) + 1e-9


def test_context_values():
    assert ("cost", 11, 23) in find_secrets("passphrase x9Kq27vLmT0z") or not find_secrets("passphrase x9Kq27vLmT0z")
    text = "the pwd is x9Kq!7vLmT0z, and the passcode: changeme"
    assert find_secrets(text) == [("cost", 11, 23)]
    assert find_secrets("auth => 'gH7!pQ2#vR9$'") == [("cost", 9, 21)]
    assert [s[0] for s in find_secrets("token = x9Kq27vLmT0z")] == ["assign"]


def test_edges(spark):
    long = "lorem ipsum " * 300_000 + "pwd: gH7!pQ2#vR9$"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (None, "token=abcdef", 0), (5, "token=abcdef", 0),
                                  (5, "token=abcdef", 0)], "doc_id long, text string, start int")
    found = scan_secrets(docs)
    assert found.columns == ["doc_id", "text", "start", "secrets"]
    spans = sorted(((r.doc_id or 0), [tuple(s) for s in r.secrets]) for r in found.collect())
    one = [("assign", 0, 12)]
    assert spans == [(0, one), (1, []), (2, []), (3, [("cost", len(long) - 12, len(long))]), (5, one), (5, one)]
    assert scan_secrets(docs.limit(0)).count() == 0
