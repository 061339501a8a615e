import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabletools.llm import packing
from tabletools.llm.packing import Sequences, WordTokenizer, pack, places
from tabletools.llm.queries import op10_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_pieces(rows, ids, length=2048):
    """rows: pieces; ids: {doc_id: ids with the end}. All ids lie in one piece, sequences are gapless; returns their sizes."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for doc_id, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = ids[doc_id][at:at + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc_id])
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc_id])
    sizes = {}
    for sequence, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes[sequence] = at
        assert at <= length and at & (at - 1) == 0      # full, or a power of two: no padding at all
    assert sorted(sizes) == list(range(len(sizes)))
    return sizes


def test_query_packs_every_id(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    rows = op10_packing(spark, SF).collect()
    sizes = check_pieces(rows, ids)
    assert sum(sizes.values()) == sum(map(len, ids.values()))


def test_every_sequence_keeps_the_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 7 = 0 THEN 'b' ELSE 'c' END source")
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = pack(docs.repartition(7), quantum=64).collect()
    tokens, by_sequence = {}, {}
    for r in rows:
        s = source[r.doc_id]
        tokens[s] = tokens.get(s, 0) + r.length
        own = by_sequence.setdefault(r.sequence_id, {})
        own[s] = own.get(s, 0) + r.length
    total, served = sum(tokens.values()), dict.fromkeys(tokens, 0)
    for k in sorted(by_sequence):
        for s in tokens:
            served[s] += by_sequence[k].get(s, 0)
        done = sum(served.values())
        assert all(abs(served[s] - done * n / total) <= 2 * 64 for s, n in tokens.items())      # the deficit


def test_places_are_a_permutation():
    totals = np.array([1000, 77, 3, 4096, 1, 1000])
    taken = []
    for s, n in enumerate(totals):
        quanta = np.arange(-(-n // 16))
        for p, j in zip(places(s, quanta, totals, 16), quanta):
            taken += range(p, p + min(16, n - 16 * j))
    assert sorted(taken) == list(range(totals.sum()))
    tail = Sequences(2048 * 3 + 13, 2048)
    assert [int(x) for x in tail.of(np.array([0, 2047, 2048, 6144, 6152, 6156]))[0]] == [0, 0, 1, 3, 4, 5]


def test_words_are_tokens_of_whole_texts(spark, tokenizer):
    texts = ["it's  DON'T x", "<|endoftext|> a<|startoftext|>b", "é ́x", "  a b　c", "ΑΣ ΣΑΣ.", "İİ",
             "１２ ½x² 漢字かな", "a‍b 👩‍👩‍👧", "\x00 \x1c\x1d\x85 x", "'s 'S 've'RE", "ﬁ ſ K"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' source")
    check_pieces(pack(docs).collect(), {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)})


def test_edges(spark, tokenizer):
    texts = {1: None, 2: "", 3: "a", 4: "long text " * 100_000, 5: " \n"}
    rows = [(i, t, s, "x") for (i, t), s in zip(texts.items(), (None, "s", "t", None, "é"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string")
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    check_pieces(pack(docs).collect(), ids)
    twice = pack(docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))).collect()
    assert sum(r.length for r in twice) == 2 * len(ids[3])
    nameless = spark.createDataFrame([(None, "a b", None)], "doc_id long, text string, source string")
    assert [r.doc_id for r in pack(nameless).collect()] == [None, None]
    assert pack(docs.limit(0)).count() == 0


def test_plain_words_are_cut_as_the_tokenizer_does(tokenizer):
    rng = np.random.default_rng(1)
    letters = [chr(c) for c in range(0x21, 0x17F)] + list("abcdefghijklmnopqrstuvwxyzßÿ") * 8
    mine = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert mine.plain
    for _ in range(20_000):
        word = "".join(rng.choice(letters, rng.integers(1, 9)))
        flat, _ = mine._word_ids(["x", word])
        if word.split() == [word]:
            assert flat == tokenizer.encode(f"x {word}", add_special_tokens=False).ids, word


def test_slices_are_cut_as_the_tokenizer_does(tokenizer):
    rng = np.random.default_rng(2)
    words = ["", " ", "a1b22", "DON'T", "É!x", "ÿ¿ß9", "漢字", "x<y", "--", "Wörter", "12", "İ", "\t\n", "ab", "…"]
    texts = ["".join(rng.choice(words, n)) + " " * int(n % 3) + " ".join(rng.choice(words, n)) for n in [0, 1, *rng.integers(0, 30, 200)]]
    mine = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for part in (texts, texts[:3], [""], [], ["漢"], texts[::-1]):
        ids, tokens = mine.ids(pa.array(part, pa.large_string()), 1)
        expected = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in part]
        assert ids.tolist() == sum(expected, []) and tokens.tolist() == [len(e) for e in expected]


def test_pieces_of_the_slice_before_are_not_encoded_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_PIECES", 50)
    mine, encoded = WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    cut = mine._piece_ids
    monkeypatch.setattr(mine, "_piece_ids", lambda piece: encoded.append(piece) or cut(piece))
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    for _ in range(2):
        ids, _ = mine.ids(pa.array([text], pa.large_string()), 1)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert len(mine.known) <= 50
    assert len(encoded) == 60 + 10
