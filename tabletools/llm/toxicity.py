"""Toxic texts by weak supervision.

Voters are words and beginnings of words (a lexicon mined from labelled rows, so that inflected forms count) and
patterns of characters; each fires on a text or abstains. A generative label
model explains the votes, and the given label as the vote of a noisy annotator, by a hidden class: expectation maximisation estimates each
voter's firing rate per class, and the correlation that voters keep within a class sets the share that each
adds to the log-odds, so ten words that always come together count about as one. A linear classifier is then trained on
the posterior labels, and scores any text without voters or labels.

The fit is on a bounded sample: the ``TRAIN_ROWS`` labelled documents with the smallest hash of doc_id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.llm.keep import one_text_each
from tabletools.llm.words import ASCII_PUNCTUATION, WHITE, bounded_batches, find_words, give_back, slices, text_bytes, word_hashes

TRAIN_ROWS = 8_000
VOTERS = 200                # words and stems of the lexicon
FEATURES = 300              # words and stems that the classifier weighs
STEM_BYTES = (4, 5, 6)
LEAST_DOCS = 3              # documents of the sample that a word must be in
LEAST_Z = 4.0               # how far a word's share of toxic documents must stand out, in standard deviations
STEPS = 12
RIDGE = 0.3
# Share of a text's bytes, or their number, from which a pattern voter fires
PATTERNS = {"!": 3, "?": 3, "upper": 0.25, "symbols": 0.05, "digits": 0.2, "non-ASCII": 0.15}
_SYMBOLS = b"#*$%&|<>@^~_"


def _word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 32-bit key of each distinct lower-case word, and stem, of each text; sorted by row."""
    words = find_words(pc.utf8_lower(texts), WHITE + ASCII_PUNCTUATION)
    rows = words.rows.astype(np.uint64) << np.uint64(32)
    keys = [rows | (word_hashes(words) >> np.uint64(32))]
    for size in STEM_BYTES:
        long = np.flatnonzero(words.ends - words.starts > size)
        stems = words._replace(starts=words.starts[long], ends=words.starts[long] + size)
        keys.append(rows[long] | (word_hashes(stems) * np.uint64(2 * size + 1) >> np.uint64(32)))
    keys = np.unique(np.concatenate(keys))
    return (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)


def _byte_table(members) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(members)] = 1
    return table


def pattern_votes(texts: pa.Array) -> np.ndarray:
    """Which patterns fire on each text: one row per text."""
    data, limits = text_bytes(texts)
    tables = {"!": _byte_table(b"!"), "?": _byte_table(b"?"), "upper": _byte_table(range(65, 91)),
              "symbols": _byte_table(_SYMBOLS), "digits": _byte_table(range(48, 58)), "non-ASCII": _byte_table(range(128, 256))}
    sizes = np.maximum(np.diff(limits), 1)
    fired = []
    for name, least in PATTERNS.items():
        sums = np.concatenate([[0], np.cumsum(tables[name][data])])
        found = sums[limits[1:]] - sums[limits[:-1]]
        fired.append(found >= (least if least >= 1 else least * sizes))
    return np.stack(fired, axis=1) & (np.diff(limits) > 0)[:, None]


class Toxicity(NamedTuple):
    """The fitted classifier: sorted word keys, their weights, weights of the patterns, bias."""

    keys: np.ndarray
    weights: np.ndarray
    pattern_weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, keys = _word_keys(texts)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        z = np.bincount(rows[hit], self.weights[at[hit]], minlength=len(texts))
        z = z + pattern_votes(texts) @ self.pattern_weights + self.bias
        return _sigmoid(z)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def _strongest(docs: np.ndarray, keys: np.ndarray, p: np.ndarray, most: int) -> np.ndarray:
    """The keys whose presence tells most of the class with probabilities ``p``: by the z value of the two shares."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    distinct, count = ordered[begins], np.diff(np.append(begins, len(keys))).astype(float)
    toxic = np.add.reduceat(p.astype(np.float32)[docs[order]], begins, dtype=np.float64) if len(keys) else np.zeros(0)
    share = p.mean()
    z = (toxic - count * share) / np.sqrt(count * share * (1 - share) * (1 - count / len(p)) + 1.0)
    order = np.lexsort((distinct, -z))
    order = order[(count[order] >= LEAST_DOCS) & (z[order] >= LEAST_Z)][:most]
    return np.sort(distinct[order])


def _fires(docs: np.ndarray, keys: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """One row per document, one column per chosen key: 1 if the document has it."""
    out = np.zeros((n, len(chosen)))
    if len(chosen):
        at = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
        hit = chosen[at] == keys
        out[docs[hit], at[hit]] = 1.0
    return out


class LabelModel:
    """Firing rates of voters per class, the correlation of voters within a class, and the annotator's rates."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, steps: int = STEPS):
        share = (labels.sum() + 1.0) / (len(labels) + 20.0)
        posterior = np.where(labels == 1, 0.95, 0.02)
        self.independence = np.ones(votes.shape[1])
        for step in range(steps):
            self.rates = np.stack([((1 - posterior) @ votes + 0.5) / ((1 - posterior).sum() + 1.0),
                                   (posterior @ votes + 0.5) / (posterior.sum() + 1.0)])
            self.annotator = np.array([((1 - posterior) @ labels + 1.0) / ((1 - posterior).sum() + 10.0),
                                       (posterior @ labels + 9.0) / (posterior.sum() + 10.0)])
            if step == steps // 2:
                self.independence = self._independent_shares(votes, posterior)
            posterior = _sigmoid(np.log(share / (1 - share)) + self.log_odds(votes) + self._annotated(labels))
        self.posterior = posterior

    def _independent_shares(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """1 over the sum of a voter's squared correlations with all voters, itself included, taken within the classes."""
        centred = votes - posterior[:, None] * self.rates[1] - (1 - posterior)[:, None] * self.rates[0]
        covariance = centred.T @ centred
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        self.correlations = covariance / np.outer(spread, spread)
        return 1.0 / np.maximum((self.correlations ** 2).sum(axis=1), 1.0)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """What the votes say, beside the prior. An abstaining voter says nothing, and none speaks for a clean text."""
        return votes @ (self.independence * np.log(np.maximum(self.rates[1] / self.rates[0], 1.0)))

    def _annotated(self, labels: np.ndarray) -> np.ndarray:
        clean, toxic = self.annotator
        return np.where(labels == 1, np.log(toxic / clean), np.log((1 - toxic) / (1 - clean)))


def _logistic(x: np.ndarray, p: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on probabilities, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = _sigmoid(x @ w)
        gradient = x.T @ (q - p) + penalty * w
        curve = (x.T * np.maximum(q * (1 - q), 1e-6)) @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _train(rows: pa.Table) -> Toxicity:
    """``rows``: text features ``keys`` (bytes of 32-bit keys), ``patterns`` and the label ``toxic`` of each document."""
    labels = rows["toxic"].to_numpy().astype(float)
    prior = (labels.sum() + 1.0) / (len(labels) + 20.0)
    if len(np.unique(labels)) < 2:
        return Toxicity(np.zeros(0, np.uint32), np.zeros(0), np.zeros(len(PATTERNS)), float(np.log(prior / (1 - prior))))
    per_doc = [np.frombuffer(k, np.uint32) for k in rows["keys"].to_pylist()]
    docs = np.repeat(np.arange(len(per_doc), dtype=np.int32), [len(k) for k in per_doc])
    keys = np.concatenate(per_doc)
    patterns = np.array(rows["patterns"].to_pylist(), float).reshape(len(labels), len(PATTERNS))
    lexicon = _strongest(docs, keys, labels, VOTERS)
    posterior = LabelModel(np.hstack([_fires(docs, keys, lexicon, len(labels)), patterns]), labels).posterior
    chosen = _strongest(docs, keys, posterior, FEATURES)
    w = _logistic(np.hstack([_fires(docs, keys, chosen, len(labels)), patterns]), posterior)
    n = len(chosen)
    return Toxicity(chosen, w[:n], w[n:-1], float(w[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Toxicity:
    """The classifier learned from ``labels`` (doc_id, toxic; rows with a null in either are no labels; of several for a document the highest counts).

    Without labels of both kinds the score is one low prior for every text.
    """
    wanted = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id") \
        .agg((F.max("toxic") > 0).cast("int").alias("toxic")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    @F.arrow_udf("struct<keys:binary,patterns:array<boolean>>")
    def features(texts: pa.Array) -> pa.Array:
        keys_out, patterns_out = [], []
        for part in slices(texts):
            rows, keys = _word_keys(part)
            limits = np.searchsorted(rows, np.arange(len(part) + 1))
            keys_out += [keys[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])]
            patterns_out += pattern_votes(part).tolist()
        return pa.StructArray.from_arrays([pa.array(keys_out, pa.binary()), pa.array(patterns_out, pa.list_(pa.bool_()))],
                                          ["keys", "patterns"])

    sample = bounded_batches(one_text_each(docs, wanted, "toxic"))
    rows = sample.select("doc_id", "toxic", features("text").alias("f")).select("doc_id", "toxic", "f.*")
    return _train(rows.toArrow().sort_by("doc_id").slice(0, train_rows))


def toxic_score(text, model: Toxicity):
    """A column with the score of a text column, 0 to 1; null and empty texts have the score of a text without words."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scores = np.concatenate([np.zeros(0)] + [model.scores(part) for part in slices(texts)])
        give_back()
        return pa.array(scores, pa.float64())

    return score(text)


def held_out(doc_id, parts: int = 5):
    """Whether the CRC-32 of the doc_id as text leaves no rest: rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``score``, learned from the labels of rows that are not held out. Every row gets its score, repeated ones too."""
    learn = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return docs.withColumn("score", toxic_score(F.col("text"), fit_toxicity(docs, learn, train_rows)))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with the same columns, without the texts whose score is a half or more."""
    learn = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return docs.where(toxic_score(F.col("text"), fit_toxicity(docs, learn, train_rows)) < 0.5)
