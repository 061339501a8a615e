"""Words of whole texts as numpy arrays, for Arrow batches inside tasks.

Texts are taken as UTF-8 bytes. A batch is worked on in slices of about ``SLICE_BYTES``; a longer text
makes a slice of its own and is never cut. A word is hashed by a polynomial over its bytes modulo 2^64, mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
ASCII_PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)      # odd, so that each has an inverse modulo 2^64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_byte_values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(NamedTuple):
    """The words of a slice: bytes, word limits in them, and the first word of each row (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def bounded_batches(docs: DataFrame) -> DataFrame:
    """The same table; from here on the session sends a task's rows to Python in batches of about ``BATCH_BYTES``, so that long texts take
    no more memory than short ones. Spark's limit is a number of rows and 64 MB."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def give_back() -> None:
    """Memory that is free goes back to the system: a Python worker lives on, and other tasks and the JVM share the executor with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts (null: empty) in order, in slices of at most ``most`` bytes or one text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = _offsets(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a slice, and where each row begins in them (one more at the end)."""
    offsets = _offsets(texts)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(texts: pa.Array, separators: bytes = WHITE) -> Words:
    """The words of each text: longest runs of bytes that are no separators."""
    data, limits = text_bytes(texts)
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(texts) + 1, np.int64))
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~apart[data]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = limits[1:-1][(limits[1:-1] > 0) & (limits[1:-1] < len(data))]
    starts[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, limits))


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of each 64-bit value spread over all others (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's base and of its inverse, at least ``n`` of them."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES)
        base = _BASES[lane]
        both = [np.cumprod(np.full(n, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64))]
        have = _powers[lane] = (both[0], both[1])
    return have


def word_hashes(words: Words, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.zeros(len(words.starts), np.uint64)
    step = SLICE_BYTES // 4
    for at in range(0, len(out), step):
        starts, ends = words.starts[at:at + step], words.ends[at:at + step]
        begin = starts[0]
        part = words.data[begin:ends[-1]]
        powers, inverses = _power_table(len(part) + 1, lane)
        values = _byte_values[part] * powers[:len(part)]
        limits = np.empty(2 * len(starts), np.int64)
        limits[0::2], limits[1::2] = starts - begin, ends - begin
        sums = np.add.reduceat(np.append(values, np.uint64(0)), limits)[0::2]
        out[at:at + step] = mixed(sums * inverses[starts - begin] + (ends - starts).astype(np.uint64))
    return out


def gram_hashes(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` values; one per start that has that many."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    base = np.uint64(_BASES[lane])
    with np.errstate(over="ignore"):
        done, at = 0, 0
        squares = hashes                                # runs of 1, 2, 4, ... values
        have, power = 1, base
        while done < size:
            if size & have:                             # append a run of `have` values
                out = out * power + squares[at:at + len(out)]
                at += have
                done += have
            if done < size:
                squares = squares[:-have] * power + squares[have:]
                have, power = have * 2, power * power
    return mixed(out + np.uint64(size))


def prefix_hashes(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Sums from which :func:`span_hashes` takes the hash of any run of the values."""
    powers, _ = _power_table(len(hashes) + 1, lane)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:len(hashes)])])


def span_hashes(prefixes: np.ndarray, begins: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """A hash of the values from each begin to its end."""
    _, inverses = _power_table(len(prefixes), lane)
    return mixed((prefixes[ends] - prefixes[begins]) * inverses[begins] + (ends - begins).astype(np.uint64))


def grams_inside(first: np.ndarray, size: int) -> np.ndarray:
    """Which starts of runs of ``size`` words keep the run inside one row."""
    total = int(first[-1])
    inside = np.ones(max(total - size + 1, 0), bool)
    for limit in first[1:-1]:
        inside[max(limit - size + 1, 0):limit] = False
    return inside
