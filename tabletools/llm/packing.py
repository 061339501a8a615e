"""Documents packed into sequences whose sources keep their target proportions: deficit round-robin over source queues.

Every source is a queue of token ids. It is served a quantum at a time, and next comes the source whose next
quantum is due first: quantum j of a source with n tokens is due when (j + 1/2) quanta of its n tokens should
have been served, that is at (2 j + 1) quantum / 2 n of the whole mix. So what a source is short of, its
deficit, stays below a quantum and passes on from sequence to sequence. As the due time of a quantum needs no state, a task finds
the place of each of its quanta in the whole mix by counting the earlier ones of every source, and partitions take over each other's
deficits without running one after the other. Sequences are cut from the mix every ``length`` tokens; the rest
at the end is cut into powers of two. No token of padding is needed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletools.functions.joins import join_group_facts
from tabletools.llm.words import bounded_batches, give_back, slices, text_bytes
from tabletools.sources.staging import stage

LENGTH = 2048
QUANTUM = 128
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
PACK_ROWS = 2000            # documents that a task packs at once
TOKENIZE_BYTES = 1 << 22
KEPT_PIECES = 100_000       # pieces of words whose ids a task keeps

# How the vocabulary's words are cut into pieces, and the characters for which the cut is plain: ASCII without the
# apostrophe (it starts contractions) and "<" (it starts special tokens), and the letters of Latin-1, which have simple lower cases
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PLAIN_WORD = r"^[!-&(-;=-~À-ÖØ-öø-ÿ]*$"
_LETTER, _DIGIT, _OTHER = range(3)
_KINDS = np.array([_LETTER if 97 <= b <= 122 or b >= 128 else _DIGIT if 48 <= b <= 57 else _OTHER for b in range(256)], np.uint8)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


def _in_a_row(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each of ``codes`` in a row, and how many each has; ``flat`` holds those of code 0, 1, ..."""
    begins, sizes = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    total = np.cumsum(sizes)
    return flat[np.arange(total[-1] if len(total) else 0) + np.repeat(begins - (total - sizes), sizes)], sizes


class WordTokenizer:
    """Ids of whole texts for a vocabulary that splits at white space first. Each distinct word of a slice is encoded once; plain words are
    cut into pieces here, each distinct piece is encoded once and its ids kept, all others pass through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model, self.known, self.letters = Tokenizer.from_file(path), {}, _byte_letters()
        self.cut = self.model.model.tokenize
        form = json.loads(self.model.to_str())
        normal = (form["normalizer"] or {}).get("normalizers", [])
        cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = [n["type"] for n in normal] == _NORMAL and [c["type"] for c in cuts] == ["Split", "ByteLevel"] \
            and cuts[0]["pattern"].get("Regex") == _CUT and not cuts[1]["add_prefix_space"]

    def _piece_ids(self, piece: str) -> list[int]:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.cut(letters)]

    def _plain_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words in a row, and how many each has. Words are cut all at once, by the kinds of their bytes."""
        data, limits = text_bytes(pc.utf8_lower(words))
        kind = _KINDS[data]
        new = np.zeros(len(data) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[limits] = True
        begins = np.flatnonzero(new[:-1])
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)).dictionary_encode()
        distinct, known = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        own = [ids if (ids := known.get(piece)) is not None else self._piece_ids(piece) for piece in distinct]
        if len(known) + len(own) > KEPT_PIECES:                 # those of this slice are the likeliest to come again
            known = self.known = {}
        known.update(islice(zip(distinct, own), KEPT_PIECES))
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), np.uint32, sizes.sum())
        flat, sizes = _in_a_row(flat, sizes, pieces.indices.to_numpy(zero_copy_only=False))
        ahead = np.append(0, np.cumsum(sizes))[np.searchsorted(begins, limits)]
        return flat, np.diff(ahead)

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        plain = pc.match_substring_regex(words, _PLAIN_WORD) if self.plain else pa.array(np.zeros(len(words), bool))
        flat, sizes = self._plain_ids(words.filter(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        if plain.all():
            return flat, sizes
        other = [e.ids for e in self.model.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(other), np.uint32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, other), np.int64, len(other))])
        place = np.empty(len(words), np.int64)                  # of each word among the plain ones and the others behind them
        place[np.append(np.flatnonzero(plain), np.flatnonzero(~plain))] = np.arange(len(words))
        return _in_a_row(flat, sizes, place)

    def _word_ids(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all words in a row, and where each word's begin."""
        flat, sizes = self._ids_of(pa.array(words, pa.large_string()))
        return flat.tolist(), (np.cumsum(sizes) - sizes).tolist()

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text with ``end_id`` behind it, and how many each has."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        flat, sizes = self._ids_of(coded.dictionary)
        per_row = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(per_row + 1)
        codes = np.full(ends[-1] if len(ends) else 0, len(sizes))
        inside = np.ones(len(codes), bool)
        inside[ends - 1] = False
        codes[inside] = coded.indices.to_numpy(zero_copy_only=False)
        flat, sizes = _in_a_row(np.append(flat, np.uint32(end_id)), np.append(sizes, 1), codes)
        row_ends = np.cumsum(sizes)[ends - 1] if len(ends) else np.zeros(0, np.int64)
        return flat, np.diff(row_ends, prepend=0)


_STAGED = "doc_id long, src string, part int, ahead long, tokens long, ids binary"


def _tokenized(path: str, end_id: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, served = WordTokenizer(path), {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), TOKENIZE_BYTES):
                ids, tokens = tokenizer.ids(texts, end_id)
                data = ids.astype(f"<u{id_bytes}").tobytes()
                limits = np.concatenate([[0], np.cumsum(tokens)]) * id_bytes
                rows = batch.slice(at, len(texts))
                at += len(texts)
                ahead = []
                for src, n in zip(rows.column("src").to_pylist(), tokens.tolist()):
                    ahead.append(served.get(src, 0))
                    served[src] = ahead[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("src"), pa.array([part] * len(rows), pa.int32()),
                     pa.array(ahead, pa.int64()), pa.array(tokens, pa.int64()),
                     pa.array([data[a:b] for a, b in zip(limits[:-1], limits[1:])], pa.binary())],
                    ["doc_id", "src", "part", "ahead", "tokens", "ids"])
            give_back()
    return run


def _due(quanta: np.ndarray, tokens, quantum: int) -> np.ndarray:
    """When a quantum of a source with ``tokens`` tokens is due, as a share of the whole mix."""
    return (2.0 * quanta + 1.0) * (quantum / 2.0) / tokens


def places(source: int, quanta: np.ndarray, totals: np.ndarray, quantum: int) -> np.ndarray:
    """The tokens of the whole mix before each of these quanta of a source. Quanta due at once go by source."""
    due = _due(quanta, totals[source], quantum)
    place = np.zeros(len(quanta), np.int64)
    for other, tokens in enumerate(totals):
        if other == source:
            earlier = quanta
        else:
            earlier = np.maximum(np.floor(due * tokens / quantum + 0.5).astype(np.int64), 0)
            before = np.less_equal if other < source else np.less
            while (more := before(_due(earlier, tokens, quantum), due)).any():
                earlier = earlier + more
            while (less := (earlier > 0) & ~before(_due(earlier - 1, tokens, quantum), due)).any():
                earlier = earlier - less
        place += np.minimum(earlier * quantum, tokens)
    return place


class Sequences:
    """Where the sequences of a mix of ``total`` tokens begin: every ``length`` tokens, then powers of two."""

    def __init__(self, total: int, length: int):
        self.whole, self.length = total // length, length
        rest = total % length
        sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = self.whole * length + np.cumsum([0, *sizes])

    def of(self, places_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each place."""
        sequence, offset = np.divmod(places_, self.length)
        late = places_ >= self.whole * self.length
        k = np.searchsorted(self.tail, places_[late], "right") - 1
        sequence[late], offset[late] = self.whole + k, places_[late] - self.tail[k]
        return sequence, offset

    def ends(self, places_: np.ndarray) -> np.ndarray:
        """The end of the sequence that each place is in."""
        ends = (places_ // self.length + 1) * self.length
        late = places_ >= self.whole * self.length
        ends[late] = self.tail[np.searchsorted(self.tail, places_[late], "right")]
        return ends


def pieces(sources: np.ndarray, at: np.ndarray, tokens: np.ndarray, totals: np.ndarray, quantum: int,
           sequences: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and place of each piece of documents that begin ``at`` a place of their source's queue."""
    first, last = at // quantum, (at + tokens - 1) // quantum
    count = last - first + 1
    doc = np.repeat(np.arange(len(at)), count)
    quanta = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    begin = np.maximum(quanta * quantum, at[doc])
    end = np.minimum((quanta + 1) * quantum, (at + tokens)[doc])
    place = begin - quanta * quantum
    for source in np.unique(sources):
        own = np.flatnonzero(sources[doc] == source)
        known, which = np.unique(quanta[own], return_inverse=True)
        place[own] += places(source, known, totals, quantum)[which]
    new = np.ones(len(doc), bool)                              # quanta of a document served in a row are one piece
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != (place + end - begin)[:-1])
    begins = np.flatnonzero(new)
    end = end[np.append(begins[1:], len(doc)) - 1] if len(begins) else end
    doc, begin, place = doc[begins], begin[begins], place[begins]
    while (over := np.flatnonzero(place + end - begin > sequences.ends(place))).size:
        cut = begin[over] + sequences.ends(place[over]) - place[over]
        doc, begin, end, place = (np.insert(x, over + 1, y) for x, y in (
            (doc, doc[over]), (begin, cut), (end, end[over]), (place, sequences.ends(place[over]))))
        end[over + np.arange(len(over))] = cut
    return doc, begin - at[doc], end - begin, place


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(totals: dict[str, int], length: int, quantum: int, id_bytes: int):
    names = sorted(totals)
    index, counts = {s: i for i, s in enumerate(names)}, np.array([totals[s] for s in names], np.int64)
    sequences = Sequences(int(counts.sum()), length)
    fields = [x.split()[0] for x in _PIECES.split(", ")]

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, tokens = (batch.column(c).to_numpy() for c in ("at", "tokens"))
        sources = np.array([index[s] for s in batch.column("src").to_pylist()], np.int64)
        doc, start, size, place = pieces(sources, at, tokens, counts, quantum, sequences)
        sequence, offset = sequences.of(place)
        ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{id_bytes}").astype("<u4")
        data = memoryview(ids).cast("B")
        begin = 4 * ((np.cumsum(tokens) - tokens)[doc] + start)
        crcs = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * size).tolist())]
        columns = (batch.column("doc_id").take(pa.array(doc)), start, size, crcs, tokens[doc], sequence, offset)
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns],
                                          fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PACK_ROWS):
                yield packed(batch.slice(at, PACK_ROWS))
            give_back()
    return run


def pack(docs: DataFrame, length: int = LENGTH, quantum: int = QUANTUM, path: str | None = None,
         end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``docs``: doc_id, source, text, and any other columns; null sources are a source of their own, null and empty
    texts have ``end_id`` alone, repeated rows are packed each. Sources share each sequence in proportion to their tokens, so all
    queues end together; the totals per source go to every task (a few bytes for each source). Texts are tokenized once and their ids
    staged, two bytes each if the vocabulary allows. ``path`` is the vocabulary file of a tokenizer whose words end at white space.
    """
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    from tokenizers import Tokenizer
    id_bytes = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    src = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    rows = stage(bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), "text")
                 .mapInArrow(_tokenized(path, end_id, id_bytes), _STAGED), "token-ids")
    shares = rows.groupBy("src", "part").agg(F.sum("tokens").alias("tokens"))
    ahead = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = stage(shares.select("src", "part", "tokens", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("before")),
                   "token-shares")
    totals = {r["src"]: r["n"] for r in shares.groupBy("src").agg(F.sum("tokens").alias("n")).collect()}
    queued = join_group_facts(rows, shares.select("src", "part", "before"), ["src", "part"], "doc_id")
    return queued.select("doc_id", "src", (F.col("before") + F.col("ahead")).alias("at"), "tokens", "ids") \
        .mapInArrow(_packed(totals, length, quantum, id_bytes), _PIECES)
