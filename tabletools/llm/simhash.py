"""Near-duplicates by SimHash, found by covering locality-sensitive hashing.

A fingerprint has a bit set if more than half of its shingles' hashes have. To find all pairs within ``RADIUS`` = 2
bits, each bit position gets a nonzero vector of 3 bits, and each nonzero vector v makes a table whose mask keeps the positions with an odd product with
v. Any two positions have a v that is orthogonal to both of their vectors; so two fingerprints that differ in
at most two bits are equal under that table's mask. Seven tables hence find every pair, without chance.

Only distinct fingerprints enter. Those of a small bucket are compared with each other. A large bucket is not: its fingerprints
differ only in the positions that its mask hides, so the same construction on the hidden positions splits it again, and
what is still large after that is linked by equality without each pair of the 12 or so positions left.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletools.functions.joins import join_group_facts
from tabletools.llm.components import components
from tabletools.llm.keep import without
from tabletools.llm.words import bounded_batches, give_back, slices
from tabletools.sources.staging import stage

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BITS = 64
SMALL_BUCKET = 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each run of ``words`` words joined by a space; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest
    parts = text.translate(_LOWER).split()
    if len(parts) <= words:
        return np.array([xxh64_intdigest(b" ".join(parts), SEED)] if parts else [], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist())
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row of ``counts`` hashes the bits set in over half of them; no bit for a row without hashes."""
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    counts = counts[rows]
    parts = -(-counts // 255)                                   # sums of bytes that cannot overflow
    part_row = np.repeat(np.arange(len(rows)), parts)
    row_part = np.cumsum(parts) - parts
    begins = (np.cumsum(counts) - counts)[part_row] + 255 * (np.arange(len(part_row)) - row_part[part_row])
    found = np.zeros(len(rows), np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & _ONES, begins)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), row_part, axis=0)
        over = 2 * ones > counts[:, None]
        for byte in range(8):
            found |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    out[rows] = found
    return out


def fingerprint(text, words: int = SHINGLE_WORDS):
    """A column with the fingerprint of a text column, as a signed 64-bit number; 0 for a text without words."""
    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.uint64)]
        for part in slices(texts):
            hashes = [shingle_hashes(t, words) for t in part.cast(pa.large_binary()).to_pylist()]
            out.append(majority_bits(np.concatenate(hashes), np.array([len(h) for h in hashes])))
        give_back()
        return pa.array(np.concatenate(out).view(np.int64))

    return fingerprints(text)


def _signed(mask: int):
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Of every 2^(radius + 1) - 1 tables the positions that its mask keeps, as bits."""
    vectors = range(1, 1 << (radius + 1))
    of = {p: vectors[i % len(vectors)] for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (of[p] & v).bit_count() % 2) for v in vectors]


def _bits(mask: int) -> list[int]:
    return [p for p in range(BITS) if mask >> p & 1]


def _keyed(rows: DataFrame, masks: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Each fingerprint under the masks of its table: ``fp, table, key``. ``masks``: (new table, mask) by table."""
    def keys(options):
        return F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(_signed(m)).alias("key"))
                         for t, m in options])

    parts = [rows.where(F.col("table") == table) if len(masks) > 1 else rows for table in masks]
    out = None
    for part, options in zip(parts, masks.values()):
        new = part.select("fp", F.explode(keys(options)).alias("at")).select("fp", "at.table", "at.key")
        out = new if out is None else out.unionByName(new)
    return out


def _pairs(buckets: DataFrame, radius: int) -> DataFrame:
    """Links inside small buckets (fp, table, key)."""
    a, b = buckets.withColumnRenamed("fp", "a"), buckets.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return a.join(b, ["table", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def _split(keyed: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """The rows of small and of large buckets; those alone in a bucket are left out."""
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["table", "key"])
    return sized.where(F.col("n") <= small).drop("n"), sized.where(F.col("n") > small).drop("n")


def near_links(prints: DataFrame, radius: int = RADIUS, small: int = SMALL_BUCKET) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that join all that are within ``radius`` bits
    directly or through others that are."""
    everything = (1 << BITS) - 1
    first = covering_masks(_bits(everything), radius)
    second = {}                                                   # by table of the first: (table, mask) of the second
    for i, mask in enumerate(first):
        hidden = _bits(everything & ~mask)
        second[i] = [(i * len(first) + j, mask | more) for j, more in enumerate(covering_masks(hidden, radius))]
    keyed = stage(_keyed(prints.select("fp", F.lit(0).alias("table")), {0: list(enumerate(first))}), "simhash-keys")
    few, many = _split(keyed, small)
    links = _pairs(few, radius)
    many = stage(many.select("fp", "table"), "simhash-large-buckets")
    if many.isEmpty():
        return links
    few, many = _split(stage(_keyed(many, second), "simhash-keys"), small)
    links = links.unionByName(_pairs(few, radius))
    many = stage(many.select("fp", "table"), "simhash-large-buckets")
    if many.isEmpty():
        return links
    third = {table: [(0, everything & ~sum(1 << p for p in hidden)) for hidden in
                     combinations(_bits(everything & ~mask), radius)]
             for options in second.values() for table, mask in options}
    hidden = F.create_map(*[x for table, options in third.items() for x in (
        F.lit(table), F.array(*[_signed(m) for _, m in options]))])
    equal = many.select("fp", F.explode(F.element_at(hidden, F.col("table"))).alias("mask")).distinct() \
        .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    lowest = equal.groupBy("mask", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return links.unionByName(equal.join(lowest, ["mask", "key"]).where("fp <> a").select("a", F.col("fp").alias("b")))


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                   small: int = SMALL_BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` per row; ``component_id`` is the smallest doc_id of those linked, itself included.

    Null and empty texts have fingerprint 0 and are linked like others. A null doc_id takes part but is never
    the smallest unless no other is there. Repeated rows each get theirs.
    """
    rows = stage(bounded_batches(docs).select("doc_id", fingerprint(F.col("text"), words).alias("fp")), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-classes")
    roots = components(near_links(classes.select("fp"), radius, small))
    roots = stage(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "components")
    linked = roots.join(classes, F.col("node") == F.col("fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    facts = stage(classes.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"),
                  "fingerprint-facts")
    return join_group_facts(rows, facts, ["fp"], "doc_id", size="n").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, reduced to the document with the smallest doc_id of each group. Rows that share a doc_id stay
    if one of them does."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    dropped = simhash_groups(docs).groupBy("doc_id").agg(F.bool_or(stays).alias("stays")).where("NOT stays")
    return without(docs, dropped, {"doc_id": docs["doc_id"]})
