"""Exact duplicates found through a minimal perfect hash over historical distinct digests.

The distinct digests of the history are dealt into buckets of about ``BUCKET_DIGESTS``. Each bucket has a minimal
perfect hash: levels of bit arrays, a digest owns the first bit that no other digest of its level
hits, and the rank of that bit is its slot. A slot holds the full digest, the locator of the winner and
the number of rows. New rows are first reduced to one row per digest, so a text copied a billion times is one lookup. A lookup compares all
bytes of the slot's digest with its own, so a digest outside the history is never taken for a member; such
digests form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.llm.keep import without
from tabletools.sources.staging import stage

BUCKET_DIGESTS = 20_000
SPACE = 2                     # bits of a level per digest that is still without a slot
_ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit that each digest (rows of 32 bytes) hits in a level of ``size`` bits."""
    words = digests.view(np.uint64)
    h = words[:, 1] ^ (words[:, 2] * np.uint64(2 * level + 1))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + words[:, 3] * np.uint64(level)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct digests: n digests, slots 0 to n - 1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.limits = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left, sizes, levels = digests, [], []
        while len(left):
            size = SPACE * len(left) + 1
            at = _place(left, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            sizes.append(size)
            left = left[hits[at] > 1]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The only slot each digest can be in; -1 if no bit is set on its way."""
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.limits[level] + _place(digests[left], level, size)
            found = self.bits[at]
            out[left[found]] = self.ranks[at[found]]
            left = left[~found]
        return out


def _digest_rows(column) -> np.ndarray:
    """A column of 32-byte values as an array with one row for each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32).copy()


def _index_of_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    digests = _digest_rows(table["digest"])
    index = PerfectHash.build(digests)
    order = np.argsort(index.slots(digests))
    return pa.table({
        "bucket": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([index.sizes], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(index.bits).tobytes()], pa.binary()),
        "digests": pa.array([digests[order].tobytes()], pa.binary()),
        "winners": pa.array([table["winner"].take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
        "counts": pa.array([table["n"].to_numpy()[order]], pa.list_(pa.int64()))})


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _look_up_bucket(key: tuple[pa.Scalar, ...], new: pa.Table, index: pa.Table) -> pa.Table:
    digests = _digest_rows(new["digest"]) if len(new) else np.zeros((0, 32), np.uint8)
    winners, counts = new["winner"].to_pylist(), new["n"].to_numpy()
    member = np.zeros(len(digests), bool)
    held = np.zeros((0, 32), np.uint8)
    held_winners, held_counts = [], np.zeros(0, np.int64)
    if len(index):
        row = {c: index[c][0].as_py() for c in index.column_names}
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
        held_winners, held_counts = row["winners"], np.array(row["counts"], np.int64)
        slots = PerfectHash(row["sizes"], bits).slots(digests)
        member = (slots >= 0) & (held[slots] == digests).all(axis=1)
        for i in np.flatnonzero(member):
            held_winners[slots[i]] = _larger(held_winners[slots[i]], winners[i])
        np.add.at(held_counts, slots[member], counts[member])
    apart = np.flatnonzero(~member)
    return pa.table({
        "digest": pa.array([r.tobytes() for r in held] + [digests[i].tobytes() for i in apart], pa.binary()),
        "winner": pa.array(held_winners + [winners[i] for i in apart], pa.int64()),
        "n": pa.array(np.concatenate([held_counts, counts[apart]]), pa.int64()),
        "historical": pa.array([True] * len(held) + [False] * len(apart), pa.bool_())})


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest locator (null only if all are) and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n"))


def _bucket(buckets: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket with the perfect hash and its slots. ``history``: digest, winner, n; digests distinct."""
    return history.select("*", _bucket(buckets)).groupBy("bucket").applyInArrow(
        _index_of_bucket,
        "bucket long, sizes array<long>, bits binary, digests binary, winners array<long>, counts array<long>")


def look_up(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """All groups after ``new`` (digest, winner, n; digests distinct) has met the index: those of the history, with
    what the new rows add, and those of nonmembers."""
    return new.select("*", _bucket(buckets)).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(
        _look_up_bucket, "digest binary, winner long, n long, historical boolean")


def _text_digest(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def exact_groups(docs: DataFrame, historical=None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row.

    ``historical`` tells which rows the index is built from (default: the lower half of the doc_id range). Null texts count as empty. Of
    equal texts the row with the largest doc_id stays; a null doc_id loses to any other, and rows that repeat the winning
    doc_id all count as that document. An empty table gives no rows.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if historical is None:
        historical = F.coalesce(F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2), F.lit(True))
    rows = stage(docs.select("doc_id", F.unhex(_text_digest("text")).alias("digest"), historical.alias("old")), "digests")
    history, new = (distinct_digests(rows.where(c)) for c in (F.col("old"), ~F.col("old")))
    buckets = 1 + rows.count() // BUCKET_DIGESTS
    groups = look_up(new, build_index(history, buckets), buckets).where("n > 1").withColumnRenamed("digest", "same")
    found = rows.join(groups, F.col("digest") == F.col("same"), "left")
    alone = F.col("same").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("winner"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, whatever their names, one row left of equal texts (null counts as empty): that with the largest
    doc_id. Of rows that also agree in doc_id any one is left. An empty table gives no rows; texts are compared whole, however long."""
    groups = stage(exact_groups(docs), "exact-groups")
    key = {"doc_id": docs["doc_id"], "text_sha256": _text_digest(docs["text"])}
    left = without(docs, groups.where("NOT kept"), key)
    again = stage(groups.where("kept").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    if again.isEmpty():
        return left
    repeated = left.join(again, [e.eqNullSafe(again[c]) for c, e in key.items()], "left_semi")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    one = repeated.toDF(*names.values()).withColumn("digest", _text_digest(F.col(names["text"]))) \
        .dropDuplicates([names["doc_id"], "digest"]).select(*[F.col(n).alias(c) for c, n in names.items()])
    return without(left, again, key).unionByName(one)
