"""Quality rules: counts of words, symbols, repeated lines and repeated word windows, and a trained score.

The score is a logistic regression on hashed words and hashed character trigrams (their shares of the text), trained on labelled rows and calibrated on
labelled rows that it was not trained on. Texts fail by fixed thresholds on the counts or on the score. All is worked out
in one pass over Arrow batches. The fit is on a bounded sample: the ``TRAIN_ROWS`` labelled
documents with the smallest hash of doc_id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.llm.keep import one_text_each
from tabletools.llm.words import (
    bounded_batches, find_words, gram_hashes, grams_inside, mixed, slices, text_bytes, word_hashes)

TRAIN_ROWS = 6_000
CALIBRATION_PART = 4        # one labelled row of so many calibrates
BUCKET_BITS = 15            # of the words; the character trigrams have as many buckets again
STEPS = 200
SCALE = 30.0
RIDGE = 1.0
MOST_RAW = 8.0              # raw scores are cut at this before they are calibrated
WINDOW = 5
# Fixed thresholds
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
LEAST_SCORE = 0.5
SYMBOLS = b"#*$%&|<>"


class Counts(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _between(flags: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The number of set flags of each row."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[limits[1:]] - sums[limits[:-1]]


def _members(chars) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are found twice or more, and which are found earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def counts(texts: pa.Array) -> Counts:
    """The counts of each text; 0 for an empty one."""
    words, lines = find_words(texts), find_words(texts, b"\n")
    data, limits = text_bytes(texts)
    n = len(texts)
    chars = (data & 0xC0) != 0x80
    blank = _members(b" \t\n\v\f\r")[data]
    has_word = np.diff(np.searchsorted(words.starts, np.stack([lines.starts, lines.ends])), axis=0)[0] > 0
    line_rows = lines.rows[has_word]
    line_keys = word_hashes(lines)[has_word] ^ mixed(line_rows.astype(np.uint64))
    dup_lines = np.bincount(line_rows[_repeated(line_keys)[1]], minlength=n)
    inside = np.flatnonzero(grams_inside(words.first, WINDOW))
    grams = gram_hashes(word_hashes(words), WINDOW)[inside] ^ mixed(words.rows[inside].astype(np.uint64))
    edges = np.zeros(len(words.starts) + 1, np.int64)
    begin = inside[_repeated(grams)[0]]
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + WINDOW, -1)
    return Counts(np.diff(words.first), _between(chars & ~blank, limits), _between(_members(SYMBOLS)[data], limits),
                  dup_lines, _between(np.cumsum(edges[:-1]) > 0, words.first))


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words with the first word of each row, and of all character trigrams with the first of each row.

    Trigrams reach over the end of a text by at most two bytes, which then are spaces.
    """
    words = find_words(texts)
    word = (word_hashes(words) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    data, limits = text_bytes(texts)
    codes = np.concatenate([data, np.full(2, 32, np.uint8)]).astype(np.uint32)
    second, third = codes[1:-1].copy(), codes[2:].copy()
    ends = limits[1:][np.diff(limits) > 0]
    second[ends - 1] = third[ends - 1] = 32
    third[np.maximum(ends - 2, 0)] = 32
    grams = (codes[:-2] << np.uint32(16) | second << np.uint32(8) | third) * np.uint32(2654435761)
    return word, words.first, (grams >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), limits


def _mean(weights: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[buckets])])
    return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)


class Quality(NamedTuple):
    """Weights of the buckets of words and of trigrams, bias, and the two numbers of the calibration."""

    words: np.ndarray
    trigrams: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        word, first_word, gram, first_gram = _buckets(texts)
        z = SCALE * (_mean(self.words, word, first_word) + _mean(self.trigrams, gram, first_gram)) + self.bias
        return _sigmoid(self.slope * np.clip(z, -MOST_RAW, MOST_RAW) + self.shift)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def _calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the raw scores, with the labels pulled in a little."""
    p = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w = np.stack([np.clip(z, -MOST_RAW, MOST_RAW), np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(x @ w)
        curve = (x.T * np.maximum(q * (1 - q), 1e-3)) @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (q - p) + 1e-2 * (w - [1.0, 0.0]))
        w = w - step * min(1.0, 0.5 / max(np.abs(step).max(), 1e-12))
        w[0] = max(w[0], 0.05)                  # a higher raw score never lowers the result
    return float(w[0]), float(w[1])


def _train(rows: pa.Table) -> Quality:
    size = 1 << BUCKET_BITS
    y = rows["quality"].to_numpy().astype(float)
    flat = Quality(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log((y.sum() + 9.0) / (len(y) - y.sum() + 1.0))))
    if len(np.unique(y)) < 2 or len(y) < 2 * CALIBRATION_PART:
        return flat
    at = [np.frombuffer(b, np.int32) for b in rows["buckets"].to_pylist()]
    share = np.concatenate([np.frombuffer(b, np.float32) for b in rows["shares"].to_pylist()]) * SCALE
    doc, at = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at)
    train = np.arange(len(y)) % CALIBRATION_PART != 0
    kept = train[doc]
    doc_t, at_t, share_t = doc[kept], at[kept], share[kept]
    w, bias = np.zeros(2 * size), 0.0
    seen, seen_bias, n = np.full(2 * size, 1e-8), 1e-8, train.sum()
    for _ in range(STEPS):
        z = np.bincount(doc_t, w[at_t] * share_t, minlength=len(y)) + bias
        error = np.where(train, _sigmoid(z) - y, 0.0) / n
        gradient = np.bincount(at_t, error[doc_t] * share_t, minlength=2 * size) + RIDGE * w / n
        seen += gradient ** 2
        seen_bias += error.sum() ** 2
        w -= 0.3 * gradient / np.sqrt(seen)
        bias -= 0.3 * error.sum() / np.sqrt(seen_bias)
    z = np.bincount(doc, w[at] * share, minlength=len(y)) + bias
    if len(np.unique(y[~train])) < 2:
        return Quality(w[:size], w[size:], bias, 1.0, 0.0)
    return Quality(w[:size], w[size:], bias, *_calibration(z[~train], y[~train]))


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Quality:
    """The score learned from ``labels`` (doc_id, quality; rows with a null in either are no labels; of several for a document the lowest
    counts). Without labels of both kinds every text has one high score."""
    wanted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id") \
        .agg((F.min("quality") > 0).cast("int").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    @F.arrow_udf("struct<buckets:binary,shares:binary>")
    def features(texts: pa.Array) -> pa.Array:
        buckets, shares = [], []
        for part in slices(texts):
            word, first_word, gram, first_gram = _buckets(part)
            for i in range(len(part)):
                both = []
                for offset, values, first in ((0, word, first_word), (1 << BUCKET_BITS, gram, first_gram)):
                    at, n = np.unique(values[first[i]:first[i + 1]], return_counts=True)
                    both.append((at + offset, n / max(n.sum(), 1)))
                buckets.append(np.concatenate([b[0] for b in both]).astype(np.int32).tobytes())
                shares.append(np.concatenate([b[1] for b in both]).astype(np.float32).tobytes())
        return pa.StructArray.from_arrays([pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
                                          ["buckets", "shares"])

    sample = bounded_batches(one_text_each(docs, wanted, "quality"))
    rows = sample.select(F.xxhash64("doc_id").alias("at"), "doc_id", "quality", features("text").alias("f"))
    rows = rows.select("at", "doc_id", "quality", "f.*").toArrow()
    return _train(rows.sort_by([("at", "ascending"), ("doc_id", "ascending")]).slice(0, train_rows))


_MEASURES = ", ".join(f"{c}:long" for c in Counts._fields) + ", score:double"


def measures(text, model: Quality):
    """A struct column with the counts and the score of a text column (null: empty)."""
    @F.arrow_udf(f"struct<{_MEASURES}>")
    def measured(texts: pa.Array) -> pa.Array:
        parts = [(*counts(part), model.scores(part)) for part in slices(texts)]
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * (len(Counts._fields) + 1)
        types = [pa.int64()] * len(Counts._fields) + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*Counts._fields, "score"])

    return measured(text)


def judge_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` (any columns but ``quality_rules``; repeated rows get theirs each) with the struct ``quality_rules``: the counts, ``score``,
    ``base_failed`` by the thresholds on the counts, ``kept``."""
    model = fit_quality(docs, labels, train_rows)
    measured = docs.withColumn("quality_rules", measures(F.col("text"), model))
    n, repeated = F.col("quality_rules.n_words"), F.col("quality_rules.n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)
    return measured.withColumn("quality_rules", F.col("quality_rules").withField("base_failed", failed)
                               .withField("kept", ~failed & (F.col("quality_rules.score") >= LEAST_SCORE)))
