"""Vectors of whole numbers compressed to one byte per part, with codebooks learnt from all vectors.

Vectors are cut into equal parts, and each part position has a codebook. A block of vectors is written once as dictionaries: per dimension
the distinct integers of the block in order, and for each vector the place of its integer. To assign parts,
the squared differences of every distinct integer of a dimension to the same component of all entries are tabulated once;
the distances of a part are then gathers from these tables by the dictionary codes, added over the part's dimensions.
A round sends to the driver one count and the component sums per entry, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.functions.joins import join_group_facts
from tabletools.llm.vectors import floored, whole_numbers
from tabletools.llm.words import bounded_batches
from tabletools.sources.staging import stage

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 8192                # vectors of a block, which has one dictionary per dimension
GATHER_ROWS = 2048          # vectors whose distances are held at once

_DICTIONARIES = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("width", pa.int64()),
                           ("sizes", pa.list_(pa.int64())), ("values", pa.binary()), ("codes", pa.binary())])
_DICTIONARY_COLUMNS = "ids array<long>, labels array<string>, width long, sizes array<long>, values binary, codes binary"


def dictionaries(matrix: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per dimension the distinct values in order, and for each vector the places of its values."""
    codes, values = np.zeros(matrix.shape, np.uint16), []
    for d, column in enumerate(matrix.T):
        distinct, codes[:, d] = np.unique(column, return_inverse=True)
        values.append(distinct)
    return values, codes


def _coded(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                kept, matrix = floored(part.column("embedding"), scale)
                if not len(matrix):
                    continue
                values, codes = dictionaries(matrix)
                rows = part.filter(pa.array(kept))
                yield pa.RecordBatch.from_pydict({
                    "ids": [rows.column("vec_id").to_pylist()], "labels": [rows.column("label_key").to_pylist()],
                    "width": [matrix.shape[1]], "sizes": [[len(v) for v in values]],
                    "values": [np.concatenate(values or [np.zeros(0)]).astype("<f8").tobytes()],
                    "codes": [codes.astype("<u2").T.tobytes()]}, _DICTIONARIES)
    return run


def _read_block(row: dict, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Values per dimension and codes (dimensions x vectors) of a block; dimensions that it lacks hold only 0."""
    n = len(row["ids"])
    values = np.split(np.frombuffer(row["values"], "<f8"), np.cumsum(row["sizes"])[:-1]) if row["sizes"] else []
    codes = np.frombuffer(row["codes"], "<u2").reshape(row["width"], n)
    values += [np.zeros(1)] * (width - row["width"])
    return values, np.concatenate([codes, np.zeros((width - row["width"], n), np.uint16)])


def nearest(values: list[np.ndarray], codes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the nearest of ``entries`` (entries x dimensions of the part; the first of equals) and the squared distance."""
    top = max([float(np.abs(v).max(initial=0)) for v in values], default=0.0)
    reach = top + max((abs(float(e)) for e in entries.ravel()), default=0.0)
    bound = reach * reach * max(len(values), 1)
    tables = [np.subtract.outer(whole_numbers(v, bound), whole_numbers(e, bound)) ** 2 for v, e in zip(values, entries.T)]
    n = codes.shape[1]
    kind = np.int64 if not tables else tables[0].dtype
    index, least = np.zeros(n, np.int64), np.zeros(n, kind)
    for at in range(0, n, GATHER_ROWS):
        some = slice(at, at + GATHER_ROWS)
        total = np.zeros((len(index[some]), len(entries)), kind)
        for table, places in zip(tables, codes):
            total += table[places[some]]
        index[some] = total.argmin(axis=1)
        least[some] = np.take_along_axis(total, index[some][:, None], 1)[:, 0]
    return index, least


def _entry_sums(codebooks: list[np.ndarray], width: int):
    """Per dimension and entry the number of parts assigned in this task and the sum of their components, as text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_part, n_entries = width // len(codebooks), len(codebooks[0])
        counts = np.zeros((width, n_entries), np.int64)
        sums = np.zeros((width, n_entries), object)
        for batch in batches:
            for row in batch.to_pylist():
                values, codes = _read_block(row, width)
                for p, entries in enumerate(codebooks):
                    own = slice(p * per_part, (p + 1) * per_part)
                    index, _ = nearest(values[own], codes[own], entries)
                    for d in range(own.start, own.stop):
                        pairs = np.bincount(index * len(values[d]) + codes[d], minlength=n_entries * len(values[d]))
                        pairs = pairs.reshape(n_entries, -1)
                        counts[d] += pairs.sum(axis=1)
                        exact = whole_numbers(values[d], float(np.abs(values[d]).max(initial=0)) * len(index) * 2)
                        sums[d] += (pairs.astype(exact.dtype) @ exact).astype(object)
        d, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d), pa.array(e), pa.array(counts[d, e]), pa.array([str(s) for s in sums[d, e]], pa.string())],
            ["dimension", "entry", "n", "total"])
    return run


def _assigned(codebooks: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_part = width // max(len(codebooks), 1)
        most = np.iinfo(np.int64).max
        for batch in batches:
            for row in batch.to_pylist():
                values, codes = _read_block(row, width)
                index, error = np.zeros((len(row["ids"]), len(codebooks)), np.uint8), np.zeros(len(row["ids"]), object)
                for p, entries in enumerate(codebooks):
                    own = slice(p * per_part, (p + 1) * per_part)
                    index[:, p], least = nearest(values[own], codes[own], entries)
                    error += least.astype(object)
                text, step = index.tobytes().hex(), 2 * len(codebooks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()),
                     pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()),
                     pa.array([min(int(e), most) for e in error], pa.int64())], ["vec_id", "label_key", "code", "error"])
    return run


def _first_entries(rows: DataFrame, scale: int, entries: int, parts: int, width: int) -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the vectors with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    _, matrix = floored(first["embedding"].combine_chunks(), scale)
    whole = np.zeros((len(matrix), width), object)
    whole[:, :matrix.shape[1]] = whole_numbers(matrix, np.inf)
    return [whole[:, p * width // parts:(p + 1) * width // parts] for p in range(parts)]


def _next_entries(codebooks: list[np.ndarray], sums: list) -> list[np.ndarray]:
    width = sum(c.shape[1] for c in codebooks)
    per_part = width // len(codebooks)
    codebooks = [c.copy() for c in codebooks]
    for r in sums:
        codebooks[r["dimension"] // per_part][r["entry"], r["dimension"] % per_part] = int(r["total"]) // r["n"]
    return codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(``vec_id, code, error, label_error, codebooks_sha256`` per kept vector, codebooks as arrays entries x components).

    ``vectors``: vec_id, embedding (a list of numbers), label, and any other columns. A vector that is null or holds null or non-finite
    components is dropped. ``code``: two hex digits per part. Codebooks start from the vectors with the smallest vec_id (of
    equal ids the smaller vector, null ids last); with fewer vectors than entries they are shorter. Vectors shorter than
    the longest, or whose length is no multiple of ``parts``, end in zeros. Repeated rows count and are returned each; null labels
    are one label. An empty table gives no rows. Integers up to 10^26 are summed exactly; errors beyond a long become the largest.
    """
    if not 0 < entries <= 256:
        raise ValueError("A code has two hex digits: 1 to 256 entries.")
    label = F.coalesce(F.concat(F.lit("s"), F.col("label").cast("string")), F.lit("t")).alias("label_key")
    rows = bounded_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label)
    blocks = stage(rows.mapInArrow(_coded(scale), _DICTIONARY_COLUMNS), "vector-dictionaries")
    longest = blocks.agg(F.max("width")).first()[0]
    width = -(-(longest or 0) // parts) * parts
    finite = F.forall("embedding", lambda x: x.isNotNull() & ((F.lit(float(scale)) * x.cast("double")) * 0.0 == 0.0))
    codebooks = _first_entries(rows.where(F.col("embedding").isNotNull() & finite), scale, entries, parts, width) \
        if longest is not None else []
    for _ in range(rounds if codebooks else 0):
        sums = blocks.mapInArrow(_entry_sums(codebooks, width), "dimension long, entry long, n long, total string") \
            .groupBy("dimension", "entry").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        codebooks = _next_entries(codebooks, sums.collect())           # rows: entries x components
    coded = stage(blocks.mapInArrow(_assigned(codebooks, width), "vec_id long, label_key string, code string, error long"),
                  "vector-codes")
    errors = coded.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    errors = stage(errors.select("label_key", F.least("total", most).cast("long").alias("label_error")), "label-errors")
    joined = join_group_facts(coded, errors, ["label_key"], "vec_id")
    return joined.select("vec_id", "code", "error", "label_error",
                         F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")), codebooks
