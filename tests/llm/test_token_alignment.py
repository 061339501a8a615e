import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabletools.llm.queries import op13_token_alignment
from tabletools.llm.token_alignment import VOCABULARY_A, VOCABULARY_B, PairHash, Tokenizers, aligned_documents

PATHS = public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)
TOKENIZERS = Tokenizers(*PATHS)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def whole():
    """Plain encoders of whole texts: (ids, their bytes) of each tokenizer."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def encode(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids_b]
        return ids_a, [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], ids_b, \
            [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]

    return encode


def slow_groups(text, encode):
    """Groups of ids as pairs of lists; nothing where the bytes differ."""
    if not text:
        return []
    ids_a, bytes_a, ids_b, bytes_b = encode(text)
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    ends_a, ends_b, groups, begin = ends(bytes_a), ends(bytes_b), [], 0
    for border in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, e in zip(ids_a, ends_a) if begin < e <= border],
                       [i for i, e in zip(ids_b, ends_b) if begin < e <= border]))
        begin = border
    return groups


def slow_rows(docs, encode):
    groups = [slow_groups(text, encode) for _, text in docs]
    linked = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    count = Counter(p for links in linked for p in links)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    rows = []
    for (doc_id, _), g, links in zip(docs, groups, linked):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        rows.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), links.total(),
                     sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()),
                     hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return rows


def in_order(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query_equals_brute_force(spark, whole):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = op13_token_alignment(spark, sf)
    assert found.columns == COLUMNS
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert in_order(found.collect()) == in_order(slow_rows(docs, whole))


EDGES = [(1, None), (2, ""), (3, " "), (4, "plain words"), (5, "plain words"), (5, "plain words"), (None, "no id here"),
         (6, "a▁b"), (7, "<s> </s> <unk> <|endoftext|> <0x41>"), (8, "日本語のテキスト、改行\n\n\tと　空白"), (9, "  two  spaces  "),
         (10, "\x00\x01"), (11, "🙂🙃 ça va  naïve\r\nİstanbul's won't"), (12, "aaaa" * 3000), (13, "word " * 20000),
         (14, "    　x \u0085 y"), (15, "".join(chr(c) for c in range(0x3400, 0x3400 + 600)))]


def edge_table(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in EDGES],
                                 "doc_id long, text string, row string, bucket int, pairs int, a int")


@pytest.mark.parametrize("options", [{}, {"head_pairs": 0}, {"head_pairs": 40, "buckets": 3, "fan": 2, "task_pairs": 50}])
def test_edges_and_pairs_outside_the_head(spark, whole, options):
    found = aligned_documents(edge_table(spark).repartition(5), **options)
    assert in_order(found.collect()) == in_order(slow_rows(EDGES, whole))


def test_head_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    one = in_order(aligned_documents(docs).collect())
    assert in_order(aligned_documents(docs, head_pairs=500, buckets=5, fan=2, task_pairs=3000).collect()) == one


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert aligned_documents(empty).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert in_order(aligned_documents(nulls).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n 　'▁<>|sa1é本🙂\x00."), st.characters(codec="utf-8"))), max_size=6))
def test_units_give_the_tokens_of_whole_texts(whole, texts):
    a, n_a, b, n_b = TOKENIZERS.ids(pa.array(texts, pa.large_string()))
    mine = [(x.tolist(), y.tolist()) for x, y in zip(np.split(a, np.cumsum(n_a)), np.split(b, np.cumsum(n_b)))][:len(texts)]
    want = [slow_groups(t, whole) for t in texts]
    assert mine == [([i for x, _ in g for i in x], [i for _, y in g for i in y]) for g in want]


def test_pair_hash_is_minimal_and_knows_its_pairs():
    rng = random.Random(5)
    keys = np.array(rng.sample(range(1 << 31), 20000), np.int64)
    made = PairHash.from_row(PairHash.build(keys).row())
    assert sorted(made.look_up(keys).tolist()) == list(range(len(keys)))
    others = np.array(list(set(rng.sample(range(1 << 31), 5000)) - set(keys.tolist())), np.int64)
    assert (made.look_up(others) == -1).all()
    assert (PairHash.build(keys[:0]).look_up(others) == -1).all()
