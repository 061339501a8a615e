"""Tokens of two tokenizers aligned on the same bytes, and how many documents link each pair of ids.

Both tokenizers cut the bytes of " " + text. Where a token of each ends is a common border; between two common borders lies a group,
and all its tokens of the one are linked with all its tokens of the other.

1. Texts are tokenized once and their ids staged. A text is cut into units, each a space with what follows, at spaces that no token of either
   tokenizer goes across, and a distinct unit of a slice is encoded once.
2. Each task aligns its documents and counts, per pair of ids, the documents that link it. A pair belongs to the bucket of its A id.
3. The distinct pairs of a bucket, united over tasks by a tree, get a minimal perfect hash; a slot also holds its pair.
4. Tasks' counts are scattered into dense vectors indexed by slot, and the vectors of a bucket are added by a tree.
5. A second pass aligns the documents again and looks up counts. The most frequent pairs, at most ``HEAD_PAIRS``, go to every task in one
   perfect hash. A slot that holds another pair tells that a pair is not among them; these go to their buckets by a shuffle. A
   pair outside the head is linked in few documents, so no bucket is hot.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.llm.words import bounded_batches, mixed, slices, text_bytes
from tabletools.sources.staging import stage

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
BUCKETS = 256
FAN = 64                    # rows of a bucket that one step of a tree takes together
HEAD_PAIRS = 1_000_000      # pairs whose counts go to every task: 16 bytes each and the bits of their hash
TASK_PAIRS = 2_000_000      # pairs that a task counts before it passes them on
LINKS_AT_ONCE = 2_000_000
LARGE_GROUP = 4096          # links of a group from which its ids are counted before they are linked
TOKENIZE_BYTES = 4 << 20
ALIGN_BYTES = 1 << 20
SPACE = 2                   # bits of a level of the hash per pair that is still without a slot


# -- tokens -----------------------------------------------------------------------------

def _letter_bytes() -> dict[str, int]:
    """The byte for which each letter stands in a byte-level vocabulary: its own if printable, the others in order from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def _next_bytes() -> np.ndarray:
    """Bytes that surely begin no white space: printable ASCII, and lead bytes of characters under which there is none."""
    safe = np.zeros(256, bool)
    safe[0x21:0x7F] = True
    safe[0xC3:0xE1] = True
    safe[0xE4:0xF5] = True
    return safe


class Vocabulary(NamedTuple):
    """Bytes of each token of both vocabularies, by id."""

    lengths_a: np.ndarray
    lengths_b: np.ndarray

    @property
    def size_a(self) -> int:
        return len(self.lengths_a)

    @property
    def size_b(self) -> int:
        return len(self.lengths_b)

    @property
    def id_type(self) -> np.dtype:
        return np.dtype("<u2" if max(self.size_a, self.size_b) <= 1 << 16 else "<u4")

    def names(self) -> pa.Array:
        """All ids as texts: those of A before a comma, before a bar, those of B before a comma, before a semicolon."""
        return pa.array([f"{i}{mark}" for n, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks
                         for i in range(n)], pa.large_string())


class Tokenizers:
    """A byte-level BPE (A) and a piece BPE with byte fallback (B), and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _letter_bytes()
        a = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = pa.array(a, pa.large_binary())
        self.bytes_b = pa.array([_piece_bytes(p) for p in pieces], pa.large_binary())
        self.vocabulary = Vocabulary(*[np.diff(np.frombuffer(x.buffers()[1], np.int64)).astype(np.int32)
                                       for x in (self.bytes_a, self.bytes_b)])
        self.separate = not any("▁" in p.lstrip("▁") for p in pieces)      # no piece goes from a word into the next

    def units(self, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Where units begin: at each text (which begins with a space), and at spaces after another byte and before no white space."""
        begins = np.zeros(len(data) + 1, bool)
        if self.separate and len(data) > 2:
            begins[1:-2] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & _next_bytes()[data[2:]]
        begins[limits[:-1]] = True
        begins[-1] = False
        return np.flatnonzero(begins)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and how many each text has, then those of B. A text whose joined bytes are not those of " " + text has none."""
        filled = np.array(texts.is_valid()) & (np.diff(text_bytes(texts)[1]) > 0)
        spaced = pa.array([" " + t for t in texts.filter(pa.array(filled)).to_pylist()], pa.large_string())
        data, limits = text_bytes(spaced)
        begins = self.units(data, limits)
        offsets = np.append(begins, len(data)).astype(np.int64)
        cut = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        coded = cut.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        first = np.searchsorted(begins, limits)
        out, right = [], np.ones(len(spaced), bool)
        for encoded, names in (([e.ids for e in self.a.encode_batch_fast(distinct, add_special_tokens=False)], self.bytes_a),
                               (self.b.encode([u[1:] for u in distinct], num_threads=1) if distinct else [], self.bytes_b)):
            ids, per_text = _gathered(encoded, codes, first)
            out += [ids, per_text]
            right &= _same_bytes(names.take(pa.array(ids)), per_text, data, limits)
        result = []
        for ids, per_text in (out[:2], out[2:]):
            all_counts = np.zeros(len(texts), np.int64)
            all_counts[filled] = np.where(right, per_text, 0)
            result += [ids[np.repeat(right, per_text)], all_counts]
        return tuple(result)


def _gathered(encoded: list[list[int]], codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units in a row, and how many each text has. ``first``: the first unit of each text (one more at the end)."""
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    flat = np.fromiter(chain.from_iterable(encoded), np.int64, int(lengths.sum()))
    sizes = lengths[codes]
    total = np.concatenate([[0], np.cumsum(sizes)])
    begins = np.cumsum(lengths) - lengths
    take = np.arange(total[-1]) + np.repeat(begins[codes] - total[:-1], sizes)
    return flat[take], np.diff(total[first])


def _same_bytes(tokens: pa.Array, per_text: np.ndarray, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Whether the joined tokens of each text are its bytes."""
    if not len(tokens):
        return np.diff(limits) == 0
    joined, ends = text_bytes(tokens)
    at = ends[np.concatenate([[0], np.cumsum(per_text)])]
    if np.array_equal(at, limits) and np.array_equal(joined, data):
        return np.ones(len(per_text), bool)
    mine, theirs = memoryview(np.ascontiguousarray(joined)), memoryview(np.ascontiguousarray(data))
    return np.array([mine[a:b] == theirs[c:d] for a, b, c, d in zip(at[:-1], at[1:], limits[:-1], limits[1:])], bool)


_TOKENS = "row long, doc_id long, a binary, b binary"


def _tokenized(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, row = Tokenizers(*paths), TaskContext.get().partitionId() << 40
        kind = tokenizers.vocabulary.id_type
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), TOKENIZE_BYTES):
                a, n_a, b, n_b = tokenizers.ids(texts)
                columns = [pa.array(np.arange(row, row + len(texts))), batch.column("doc_id").slice(at, len(texts))]
                for ids, n in ((a, n_a), (b, n_b)):
                    whole = ids.astype(kind).tobytes()
                    limits = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
                    columns.append(pa.array([whole[i:j] for i, j in zip(limits[:-1], limits[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "a", "b"])
                at, row = at + len(texts), row + len(texts)
    return run


# -- groups and links -------------------------------------------------------------------

class Aligned(NamedTuple):
    """Tokens of some documents: ids, the group of each, the document of each group."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    doc: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def align(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, vocabulary: Vocabulary) -> Aligned:
    """Groups between common borders. ``n_a``, ``n_b``: tokens per document; both cut the same bytes."""
    ends_a, ends_b = (np.cumsum(x[ids], dtype=np.int64) for x, ids in zip(vocabulary, (a, b)))
    common_a, common_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
    doc = np.repeat(np.arange(len(n_a)), n_a)[common_a]
    return Aligned(a, b, group_a, group_b, doc, n_a, n_b)


def _counted(groups: np.ndarray, ids: np.ndarray, large: np.ndarray, size: int):
    """Tokens with their groups and weights; in large groups one per distinct id, weighing its tokens."""
    inside = large[groups]
    if not inside.any():
        return groups, ids, np.ones(len(ids), np.int64)
    keys, n = np.unique(groups[inside] * size + ids[inside], return_counts=True)
    groups, ids = np.append(groups[~inside], keys // size), np.append(ids[~inside], keys % size)
    weights = np.append(np.ones(len(ids) - len(n), np.int64), n)
    order = np.argsort(groups, kind="stable")
    return groups[order], ids[order], weights[order]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of the weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begins], np.add.reduceat(weights[order], begins)


def links(found: Aligned, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair (A id * ``size_b`` + B id) and number of links, one row per distinct pair of a document."""
    groups = len(found.doc)
    large = np.bincount(found.group_a, minlength=groups) * np.bincount(found.group_b, minlength=groups) >= LARGE_GROUP
    group_a, a, weight_a = _counted(found.group_a, found.a, large, size_a)
    group_b, b, weight_b = _counted(found.group_b, found.b, large, size_b)
    per_group = np.bincount(group_b, minlength=groups)
    begins, repeats = np.cumsum(per_group) - per_group, per_group[group_a]
    upto, pairs = np.concatenate([[0], np.cumsum(repeats)]), size_a * size_b
    keys, weights, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + LINKS_AT_ONCE, "right")) - 1)
        own = np.repeat(np.arange(at, to), repeats[at:to])
        other = np.arange(upto[at], upto[to]) - upto[own] + begins[group_a[own]]
        key = found.doc[group_a[own]].astype(np.uint64) * np.uint64(pairs) + (a[own] * size_b + b[other]).astype(np.uint64)
        if weight_a[at:to].max() == 1 and weight_b[other].max(initial=1) == 1:
            key, weight = np.unique(key, return_counts=True)
        else:
            key, weight = _summed(key, weight_a[own] * weight_b[other])
        keys.append(key)
        weights.append(weight)
        at = to
    key, weight = (keys[1], weights[1]) if len(keys) == 2 else _summed(np.concatenate(keys), np.concatenate(weights))
    return (key // np.uint64(pairs)).astype(np.int64), (key % np.uint64(pairs)).astype(np.int64), weight


def group_digests(found: Aligned, names: pa.Array, size_a: int, size_b: int) -> list[str]:
    """Per document the SHA-256 of its groups written as ``a,a|b;a|b``; nothing for one without tokens."""
    per_a, per_b = (np.bincount(g, minlength=len(found.doc)) for g in (found.group_a, found.group_b))
    upto_a, upto_b = np.cumsum(per_a), np.cumsum(per_b)
    last_a = np.arange(len(found.a)) == upto_a[found.group_a] - 1
    last_b = np.arange(len(found.b)) == upto_b[found.group_b] - 1
    mixed_ids = np.zeros(len(found.a) + len(found.b), np.int64)
    mixed_ids[np.arange(len(found.a)) + (upto_b - per_b)[found.group_a]] = found.a + size_a * last_a
    mixed_ids[np.arange(len(found.b)) + upto_a[found.group_b]] = 2 * size_a + found.b + size_b * last_b
    data, ends = text_bytes(names.take(pa.array(mixed_ids)))
    limits = ends[np.concatenate([[0], np.cumsum(found.n_a + found.n_b)])]
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(view[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]


def _read_tokens(batch: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """The rows of a batch with their alignment, so many at a time as have about ``ALIGN_BYTES`` of ids."""
    sizes = np.array([len(a) for a in batch.column("a").to_pylist()], np.int64)
    upto, at, kind = np.concatenate([[0], np.cumsum(sizes)]), 0, vocabulary.id_type
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + ALIGN_BYTES, "right")) - 1)
        rows = batch.slice(at, to - at)
        both = []
        for side in ("a", "b"):
            parts = rows.column(side).to_pylist()
            both += [np.frombuffer(b"".join(parts), kind).astype(np.int64),
                     np.array([len(p) // kind.itemsize for p in parts], np.int64)]
        yield rows, align(*both, vocabulary)
        at = to


# -- perfect hash of pairs --------------------------------------------------------------

class PairHash:
    """A minimal perfect hash over distinct pairs, given as numbers: each level is an array of bits, a pair owns the first bit that
    no other pair of its level hits, and the rank of the bit is its slot. ``keys`` holds the pair of each slot."""

    def __init__(self, sizes: list[int], bits: np.ndarray, keys: np.ndarray):
        self.sizes, self.bits, self.keys = sizes, bits, keys
        self.limits = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def _hit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mixed(keys.astype(np.uint64) + salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PairHash:
        left, sizes, levels = keys, [], []
        while len(left):
            size = SPACE * len(left) + 1
            at = cls._hit(left, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            sizes.append(size)
            left = left[hits[at] > 1]
        made = cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool), keys)
        held = np.zeros(len(keys), np.int64)
        held[made._slots(keys)] = keys
        made.keys = held
        return made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.limits[level] + self._hit(keys[left], level, size)
            found = self.bits[at]
            out[left[found]] = self.ranks[at[found]]
            left = left[~found]
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair; -1 for a pair that is not held."""
        slots = self._slots(keys)
        if len(self.keys):
            slots[self.keys[slots] != keys] = -1
        return slots

    def row(self) -> dict:
        return {"sizes": self.sizes, "bits": np.packbits(self.bits).tobytes(), "held": self.keys.astype("<i8").tobytes()}

    @classmethod
    def from_row(cls, row: dict) -> PairHash:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
        return cls(row["sizes"], bits, np.frombuffer(row["held"], "<i8"))


# -- counts -----------------------------------------------------------------------------

_PARTIAL = "bucket long, node long, keys binary, counts binary"
_UNITED = "bucket long, node long, keys binary"
_INDEX = "bucket long, sizes array<long>, bits binary, held binary"
_VECTOR = "bucket long, node long, counts binary"


def _table(schema: dict) -> pa.Table:
    return pa.table({c: pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for c, v in schema.items()})


def _bucket_runs(keys: np.ndarray, size_b: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys."""
    bucket = keys // size_b % buckets
    order = np.argsort(bucket, kind="stable")
    limits = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(limits)):
        yield int(i), order[limits[i]:limits[i + 1]]


def _task_counts(vocabulary: Vocabulary, buckets: int, task_pairs: int):
    """In how many of a task's documents each pair is linked, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        held, n_held = [], 0

        def passed_on(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for bucket, own in _bucket_runs(keys, vocabulary.size_b, buckets):
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([bucket], pa.int64()), "node": pa.array([node], pa.int64()),
                    "keys": [keys[own].astype("<i8").tobytes()], "counts": [counts[own].astype("<i8").tobytes()]})

        for batch in batches:
            for _, found in _read_tokens(batch, vocabulary):
                _, key, _ = links(found, vocabulary.size_a, vocabulary.size_b)
                held.append(np.unique(key, return_counts=True))
                n_held += len(held[-1][0])
                if n_held > task_pairs:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    n_held = len(held[0][0])
                    if 2 * n_held > task_pairs:
                        yield from passed_on(*held[0])
                        held, n_held, node = [], 0, node + 7919       # the next rows go elsewhere in the tree
        if held:
            yield from passed_on(*_summed(*(np.concatenate(x) for x in zip(*held))))
    return run


def _united(key: tuple, table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([np.frombuffer(k, "<i8") for k in table["keys"].to_pylist()]))
    return _table({"bucket": key[0].as_py(), "node": key[1].as_py(), "keys": keys.astype("<i8").tobytes()})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            made = PairHash.build(np.frombuffer(r["keys"], "<i8").astype(np.int64)).row()
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r["bucket"]], pa.int64()), "sizes": pa.array([made["sizes"]], pa.list_(pa.int64())),
                                              "bits": [made["bits"]], "held": [made["held"]]})


def _scattered(key: tuple, partial: pa.Table, index: pa.Table) -> pa.Table:
    """The counts of some tasks in one dense vector, in the order of the slots."""
    hashed = PairHash.from_row(index.to_pylist()[0])
    dense = np.zeros(len(hashed.keys), np.int64)
    for keys, counts in zip(partial["keys"].to_pylist(), partial["counts"].to_pylist()):
        dense[hashed.look_up(np.frombuffer(keys, "<i8"))] += np.frombuffer(counts, "<i8")
    return _table({"bucket": key[0].as_py(), "node": key[1].as_py(), "counts": dense.tobytes()})


def _added(key: tuple, table: pa.Table) -> pa.Table:
    dense = sum(np.frombuffer(c, "<i8") for c in table["counts"].to_pylist())
    return _table({"bucket": key[0].as_py(), "node": key[1].as_py(), "counts": dense.tobytes()})


def _deepest(rows: DataFrame) -> int:
    """The rows of the bucket with the most."""
    return rows.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0


def _tree(rows: DataFrame, left: int, merge, schema: str, fan: int) -> DataFrame:
    """The rows of each bucket merged into one, about ``fan`` at a time. ``left``: how many a bucket has at most."""
    while left > 1:
        left = -(-left // fan)
        rows = rows.withColumn("node", F.pmod("node", F.lit(left).cast("long"))).groupBy("bucket", "node").applyInArrow(merge, schema)
    return rows


def _on_nodes(index: DataFrame, nodes: int) -> DataFrame:
    """The index once for each node of a step of the tree."""
    return index.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))))


def pair_counts(tokens: DataFrame, vocabulary: Vocabulary, buckets: int = BUCKETS, fan: int = FAN,
                task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Per bucket the perfect hash of its distinct pairs and, by slot, in how many documents each is linked."""
    partial = stage(tokens.mapInArrow(_task_counts(vocabulary, buckets, task_pairs), _PARTIAL), "pair-partials")
    deepest = _deepest(partial)
    united = _tree(partial.select("bucket", "node", "keys"), max(deepest, 2), _united, _UNITED, fan)
    index = stage(united.select("bucket", "keys").mapInArrow(_hashed, _INDEX), "pair-index")
    nodes = max(1, -(-deepest // fan))
    spread = partial.withColumn("node", F.pmod("node", F.lit(nodes).cast("long")))
    vectors = spread.groupBy("bucket", "node").cogroup(_on_nodes(index, nodes).groupBy("bucket", "node")) \
        .applyInArrow(_scattered, _VECTOR)
    total = _tree(vectors, nodes, _added, _VECTOR, fan)
    return stage(index.join(total.select("bucket", "counts"), "bucket"), "pair-counts")


def _bests(size_b: int):
    """Per bucket the highest count of each A id, and how many pairs have counts of each number of bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = np.frombuffer(r["held"], "<i8"), np.frombuffer(r["counts"], "<i8")
                ids, which = np.unique(keys // size_b, return_inverse=True)
                best = np.zeros(len(ids), np.int64)
                np.maximum.at(best, which, counts)
                bits = np.bincount(np.frexp(counts.astype(float))[1], minlength=64)
                yield pa.RecordBatch.from_pydict({"ids": [ids.tolist()], "best": [best.tolist()], "bits": [bits.tolist()]})
    return run


def _heads(least: int):
    """The pairs that at least so many documents link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = np.frombuffer(r["held"], "<i8"), np.frombuffer(r["counts"], "<i8")
                own = counts >= least
                yield pa.RecordBatch.from_pydict({"keys": [keys[own].tobytes()], "counts": [counts[own].tobytes()]})
    return run


# -- second pass ------------------------------------------------------------------------

_LOOKED_UP = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string, pairs binary, times binary")


def _per_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of integers per row."""
    out = np.zeros(n, np.int64)
    np.add.at(out, rows, values)
    return out


def _looked_up(vocabulary: Vocabulary, head, best):
    """Documents with the counts of pairs in the head; ``pairs`` and ``times`` are those not in it, and their links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (hashed, counts), best_of = vocabulary.names(), head.value, best.value
        for batch in batches:
            for rows, found in _read_tokens(batch, vocabulary):
                n = len(rows)
                doc, key, times = links(found, vocabulary.size_a, vocabulary.size_b)
                slot = hashed.look_up(key)
                inside = slot >= 0
                count = np.where(inside, counts[slot] if len(counts) else 0, 0)
                highest = inside & (count == best_of[key // vocabulary.size_b])
                out = np.flatnonzero(~inside)
                limits = np.searchsorted(doc[out], np.arange(n + 1))
                outside = [[values[out[a:b]].tobytes() for a, b in zip(limits[:-1], limits[1:])] for values in (key, times)]
                sums = (found.n_a, found.n_b, np.bincount(found.doc, minlength=n), _per_row(doc, times, n),
                        _per_row(doc[highest], times[highest], n), _per_row(doc, times * count, n))
                digests = group_digests(found, names, vocabulary.size_a, vocabulary.size_b)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), rows.column("doc_id"), *[pa.array(s, pa.int64()) for s in sums],
                     pa.array(digests, pa.string()), *[pa.array(o, pa.binary()) for o in outside]],
                    [f.split()[0] for f in _LOOKED_UP.split(", ")])
    return run


def _to_buckets(size_b: int, buckets: int):
    """Pairs of a batch of documents, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        for batch in batches:
            pairs, times = (batch.column(c).to_pylist() for c in ("pairs", "times"))
            rows = np.repeat(batch.column("row").to_numpy(), [len(p) // 8 for p in pairs])
            keys, n = (np.frombuffer(b"".join(x), "<i8") for x in (pairs, times))
            for bucket, own in _bucket_runs(keys, size_b, buckets):
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([bucket], pa.int64()), "node": pa.array([node], pa.int64()), "rows": [rows[own].tobytes()],
                    "keys": [keys[own].tobytes()], "times": [n[own].tobytes()]})
            node += 7919
    return run


def _bucket_counts(size_b: int, best):
    def run(key: tuple, asked: pa.Table, index: pa.Table) -> pa.Table:
        made = index.to_pylist()[0]
        hashed, counts = PairHash.from_row(made), np.frombuffer(made["counts"], "<i8")
        rows, keys, times = (np.frombuffer(b"".join(asked[c].to_pylist()), "<i8") for c in ("rows", "keys", "times"))
        if not len(rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("row", "more_best", "more_sum")})
        count = counts[hashed.look_up(keys)]
        distinct, which = np.unique(rows, return_inverse=True)
        high = np.where(count == best.value[keys // size_b], times, 0)
        return pa.table({"row": distinct, "more_best": _per_row(which, high, len(distinct)),
                         "more_sum": _per_row(which, times * count, len(distinct))})
    return run


def aligned_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, head_pairs: int = HEAD_PAIRS,
                      buckets: int = BUCKETS, fan: int = FAN, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs``.

    ``docs``: doc_id, text, and any other columns. ``path_a``: vocabulary of a byte-level BPE; ``path_b``: model of a piece BPE
    that puts a space before a text. A pair of ids counts in how many rows of the whole table it is linked, repeated rows each;
    ``count_sum`` adds the counts of all links of a row, ``n_best`` tells how many have the highest count of their A id. A text that is null,
    empty, or not given back byte for byte by either tokenizer has zeros and an empty ``groups_sha256``. A null doc_id is kept. A very
    long text is one slice of work and is never cut; a group in which nothing meets is linked by its distinct ids. An empty table gives no rows.
    """
    if path_a is None or path_b is None:
        import public_tokenizers
        path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    paths, spark = (path_a, path_b), docs.sparkSession
    both = Tokenizers(*paths).vocabulary
    tokens = stage(bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(_tokenized(paths), _TOKENS), "token-ids")
    counted = pair_counts(tokens, both, buckets, fan, task_pairs)
    best, bits = np.zeros(both.size_a, np.int64), np.zeros(64, np.int64)       # bounded by the vocabulary, whatever the corpus
    for r in counted.mapInArrow(_bests(both.size_b), "ids array<long>, best array<long>, bits array<long>").collect():
        best[r["ids"]], bits = r["best"], bits + np.array(r["bits"])
    lowest = next(b for b in range(64) if bits[b:].sum() <= head_pairs)
    head = counted.mapInArrow(_heads(1 << lowest >> 1), "keys binary, counts binary").collect()      # at most head_pairs pairs
    keys, counts = (np.concatenate([np.frombuffer(r[c], "<i8") for r in head] or [np.zeros(0, np.int64)]) for c in ("keys", "counts"))
    hashed = PairHash.build(keys)
    by_slot = np.zeros(len(keys), np.int64)
    by_slot[hashed.look_up(keys)] = counts
    sent, sent_best = spark.sparkContext.broadcast((hashed, by_slot)), spark.sparkContext.broadcast(best)
    found = tokens.mapInArrow(_looked_up(both, sent, sent_best), _LOOKED_UP)
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not bits[:lowest].any():
        return found.select(*result)
    found = stage(found, "aligned")
    asked = stage(found.where(F.octet_length("pairs") > 0).select("row", "pairs", "times").mapInArrow(
        _to_buckets(both.size_b, buckets), "bucket long, node long, rows binary, keys binary, times binary"), "pairs-outside-the-head")
    nodes = max(1, -(-_deepest(asked) // fan))
    more = asked.withColumn("node", F.pmod("node", F.lit(nodes).cast("long"))).groupBy("bucket", "node") \
        .cogroup(_on_nodes(counted, nodes).groupBy("bucket", "node")) \
        .applyInArrow(_bucket_counts(both.size_b, sent_best), "row long, more_best long, more_sum long") \
        .groupBy("row").agg(F.sum("more_best").alias("more_best"), F.sum("more_sum").alias("more_sum"))
    zero = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(more, "row", "left") \
        .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", zero)) \
        .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", zero)).select(*result)
