"""Passages that repeat within or across documents, found by seed and extend.

Seeds: of the hashes of ``ANCHOR_WORDS`` consecutive words inside each window of ``window`` words the smallest is kept (winnowing), so
two equal windows keep the same anchor at the same place, and neighbouring windows mostly share theirs: a *run* is
the windows of one anchor. Only anchors found twice or more are joined; the others end there.

Extension: runs of one anchor that agree in all their words, both ways, are one class, counted before it is
shuffled; a class with two members is repeated as a whole, however many copies it has. Where an anchor has several classes, one
member of each is extended window by window around the anchor, and a window found in two classes is repeated in both.
No pair of occurrences is ever formed. Overlapping repeated windows are joined to maximal repeats.

Windows and classes are told apart by 128-bit hashes, rows by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.llm.words import (
    bounded_batches, find_words, gram_hashes, prefix_hashes, slices, span_hashes, word_hashes)
from tabletools.sources.staging import stage

WINDOW = 35
ANCHOR_WORDS = 10


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The index of the leftmost smallest of every ``size`` consecutive values."""
    at, have = np.arange(len(values)), 1
    while have < size:
        step = min(have, size - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        have += step
    return at


class Runs:
    """The runs of a slice of texts: anchors, rows, first window (as a word of the slice) and number of windows."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = find_words(texts)
        self.hashes = word_hashes(self.words)
        first, counts = self.words.first, np.diff(self.words.first)
        self.rows = self.lows = self.sizes = np.zeros(0, np.int64)
        self.anchors = np.zeros(0, np.uint64)
        if counts.max(initial=0) < window:
            return
        grams = gram_hashes(self.hashes, ANCHOR_WORDS)
        anchor = _smallest(grams, window - ANCHOR_WORDS + 1)
        row = self.words.rows[:len(anchor)]
        starts = np.flatnonzero(np.arange(len(anchor)) + window <= first[1:][row])
        anchor, row = anchor[starts], row[starts]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        begins = np.flatnonzero(new)
        self.rows, self.lows = row[begins], starts[begins]
        self.sizes = np.diff(np.append(begins, len(starts)))
        self.anchors = grams[anchor[begins]]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                anchors, n = np.unique(Runs(texts, window).anchors, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(anchors), pa.array(n, pa.int64())], ["anchor", "n"])
    return run


def _runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column("row").to_numpy(zero_copy_only=False), 0
            for texts in slices(batch.column("text")):
                runs = Runs(texts, window)
                context = span_hashes(prefix_hashes(runs.hashes, 1), runs.lows, runs.lows + runs.sizes + window - 1, 1)
                yield pa.RecordBatch.from_arrays(
                    [_signed(runs.anchors), _signed(context), pa.array(keys[at + runs.rows], pa.int64()),
                     pa.array(runs.lows - runs.words.first[runs.rows], pa.int32()), pa.array(runs.sizes, pa.int32())],
                    ["anchor", "context", "row", "low", "size"])
                at += len(texts)
    return run


def _extended(window: int):
    """Every window of the listed runs of a text: its two hashes, and its class and place in the run."""
    names = ["left", "right", "anchor", "context", "place", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                listed = batch.column("runs").slice(at, len(texts))
                at += len(texts)
                runs, words = listed.flatten(), find_words(texts)
                per_row = np.diff(listed.offsets.to_numpy())
                size, low = runs.field("size").to_numpy(), runs.field("low").to_numpy().astype(np.int64)
                low = low + np.repeat(words.first[:-1], per_row)
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                begin = np.repeat(low, size) + place
                hashes = [span_hashes(prefix_hashes(word_hashes(words, lane), lane), begin, begin + window, lane)
                          for lane in (0, 1)]
                again = pa.array(np.repeat(np.arange(len(size)), size))
                yield pa.RecordBatch.from_arrays(
                    [*map(_signed, hashes), runs.field("anchor").take(again), runs.field("context").take(again),
                     pa.array(place, pa.int32()), runs.field("n").take(again)], names)
    return run


def repeated_runs(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, spans`` of the rows (row, doc_id, text) with a repeated window; the spans are (start, end) in words, sorted, apart."""
    texts = rows.select("row", "text")
    counted = texts.mapInArrow(_anchors(window), "anchor long, n long")
    # written, so that in the joins only shuffles meet, whose large partitions Spark can split
    shared = stage(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "repeat-anchors")
    runs = texts.mapInArrow(_runs(window), "anchor long, context long, row long, low int, size int")
    seeds = stage(runs.join(shared, "anchor"), "repeat-seeds")

    classes = stage(seeds.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "low", "size")).alias("member")), "repeat-classes")
    several = stage(classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "repeat-several")
    members = classes.join(several, "anchor").select("anchor", "context", "n", "member.*")
    listed = members.groupBy("row").agg(F.collect_list(F.struct("anchor", "context", "n", "low", "size")).alias("runs"))
    windows = stage(rows.join(listed, "row").select("text", "runs").mapInArrow(
        _extended(window), "left long, right long, anchor long, context long, place int, n long"), "repeat-windows")
    found = stage(windows.groupBy("left", "right").agg(F.sum("n").alias("all")).where("all > 1").select("left", "right"),
                  "repeated-windows")
    places = windows.where("n = 1").join(found, ["left", "right"]).groupBy("anchor", "context") \
        .agg(F.sort_array(F.collect_set("place")).alias("places"))      # as many as a run has windows at most
    whole = classes.where("n > 1").select("anchor", "context", F.lit(None).cast("array<int>").alias("places"))
    hits = seeds.join(stage(whole.unionByName(places), "repeat-places"), ["anchor", "context"])
    low, size = F.col("low"), F.col("size")
    spans = F.when(F.col("places").isNull(), F.array(F.struct(low.alias("start"), (low + size - 1 + window).alias("end")))) \
        .otherwise(F.transform("places", lambda p: F.struct((low + p).alias("start"), (low + p + window).alias("end"))))
    return hits.select("row", spans.alias("spans")).groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


_CUT = "struct<kept:string,n_words:long,n_removed:long>"


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    kept, total, removed = [], [], []
    for text, parts in zip(texts.cast(pa.large_binary()).to_pylist(), spans.to_pylist()):
        words, out, at = (text or b"").split(), [], 0
        for span in parts or ():
            out += words[at:max(span["start"], at)]
            at = max(at, span["end"])
        out += words[at:]
        kept.append(b" ".join(out))
        total.append(len(words))
        removed.append(len(words) - len(out))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
        ["kept", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, kept, n_words, n_removed``: each text without the words that some repeated window covers, its other words joined by
    one space.

    A null text has no words. A row that is there twice repeats itself, so it loses all it has if that is a window or more; texts
    shorter than a window keep all. Other columns of ``docs`` are not read.
    """
    rows = bounded_batches(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    repeats = repeated_runs(rows, window)

    @F.arrow_udf(_CUT)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return _cut(texts, spans)

    return rows.join(repeats, "row", "left").select("doc_id", cut("text", "spans").alias("cut")) \
        .select("doc_id", "cut.*")
