"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A component of a vector is a term, its value the weight. A block of candidates is inverted into one posting list
per term: the places of the block where the term is not zero, and the weights there. A query is its terms that are not
zero; each scatters its weight times a posting list into a dense array of scores, one per place of the block. A
partition selection takes the best of the array, and the best of blocks are merged: in a task as blocks come by, then over
all tasks by a window that keeps k rows a task before its shuffle.

Queries are packed into blocks too, and each block of candidates meets each block of queries. The query blocks are broadcast if a count shows
that they are small. Otherwise both sides shuffle on query block and salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletools.functions.joins import join_group_facts
from tabletools.llm.vectors import floored, packed, unpacked, whole_numbers
from tabletools.llm.words import bounded_batches
from tabletools.sources.staging import stage

SCALE = 1024
K = 10
QUERY_BLOCK = 8192          # queries that are searched together
CANDIDATE_BLOCK = 8192
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def _blocks(scale: int, most: int):
    """One row per block of at most ``most`` vectors, in the order of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                kept, matrix = floored(part.column("embedding"), scale)
                ids = part.column("vec_id").cast(pa.int64()).fill_null(_MOST).to_numpy(zero_copy_only=False)[kept]
                order = np.argsort(ids, kind="stable")
                data, kind = packed(matrix[order])
                if len(ids):
                    yield pa.RecordBatch.from_pydict(
                        {"block": [block], "n": [len(ids)], "ids": [ids[order].astype("<i8").tobytes()], "kind": [kind],
                         "data": [data]}, pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
                                                     ("kind", pa.string()), ("data", pa.binary())]))
                    block += 1
    return run


_BLOCK = "block long, n long, ids binary, kind string, data binary"


def posting_lists(matrix: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Per term the places where it is not zero and its weights there."""
    lists = []
    for column in matrix.T:
        places = np.flatnonzero(column)
        full = len(places) == len(column)
        lists.append((slice(None) if full else places, np.ascontiguousarray(column if full else column[places])))
    return lists


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores; of equal ones the first places."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > last)
    return np.concatenate([over, np.flatnonzero(scores == last)[:k - len(over)]])


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids and scores of its k best vectors of a block in the order of ids, in no order and padded with the least
    score. Vectors with the query's id take no part. Scores beyond 64 bits become the largest or smallest."""
    terms = min(queries.shape[1], vectors.shape[1])
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(terms, 1)
    queries, vectors = whole_numbers(queries[:, :terms], bound), whole_numbers(vectors[:, :terms], bound)
    postings = posting_lists(vectors)
    found_ids = np.full((len(queries), k), _MOST, np.int64)
    found = np.full((len(queries), k), _LEAST, np.int64)
    own_from, own_to = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    scores, product = np.empty(len(ids), queries.dtype), np.empty(len(ids), queries.dtype)
    for i, query in enumerate(queries):
        scores[:] = 0
        for term in np.flatnonzero(query):
            places, weights = postings[term]
            if isinstance(places, slice):
                np.multiply(weights, query[term], out=product)
                scores += product
            else:
                scores[places] += weights * query[term]
        if scores.dtype == object:
            whole = np.array([max(-_MOST, min(_MOST, s)) for s in scores], np.int64)
        else:
            whole = scores
        if own_from[i] < own_to[i]:
            others = np.r_[0:own_from[i], own_to[i]:len(ids)]
            best = others[_best(whole[others], k)]
        else:
            best = _best(whole, k)
        found_ids[i, :len(best)], found[i, :len(best)] = ids[best], whole[best]
    return found_ids, found


def _merged(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row by falling score, then rising id."""
    order = np.lexsort((ids, ~scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _searched(k: int):
    """The k best of a task's candidates for each query. A task holds k ids and scores for the queries that it has met."""
    def rows(block: int, query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(scores > _LEAST)
        ids = ids[row, place]
        return pa.RecordBatch.from_arrays(
            [pa.array(block * QUERY_BLOCK + row), pa.array(query_ids[row]), pa.array(ids, mask=ids == _MOST),
             pa.array(scores[row, place])], ["query", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for batch in batches:
            for r in batch.to_pylist():
                query_ids, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                queries, vectors = unpacked(r["q_data"], r["q_kind"], r["q_n"]), unpacked(r["data"], r["kind"], r["n"])
                found = search_block(query_ids, queries, ids, vectors, k)
                if r["q_block"] in best:
                    found = _merged(*(np.concatenate([a, b], axis=1) for a, b in zip(best[r["q_block"]][1:], found)), k)
                best[r["q_block"]] = (query_ids, *found)
        for block, found in best.items():
            yield rows(block, *found)
    return run


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, broadcast_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k rows with the highest inner product of floor(scale * component).

    ``vectors``: vec_id, embedding (a list of numbers), and any other columns. ``is_query``: a column that is true for the rows to
    search for. Candidates are all rows but those with the query's vec_id; equal scores go by smaller vec_id, null (and the largest
    long, which is not told from it) last. Vectors that are null or hold null or non-finite components take no part; an empty vector
    scores 0, as terms that one of two vectors lacks count as 0. Repeated rows are candidates each, and queries each, with ranks
    of their own. Without candidates, or in an empty table, a query has no rows. Scores beyond a long become the largest or smallest.
    """
    rows = bounded_batches(vectors).select("vec_id", "embedding")
    wanted = rows.where(is_query)
    tasks = 1 + wanted.count() // QUERY_BLOCK
    queries = stage(wanted.repartition(tasks).mapInArrow(_blocks(scale, QUERY_BLOCK), _BLOCK), "query-blocks")
    numbers = [r["block"] for r in queries.select("block").collect()]             # one for thousands of queries
    number = F.array_position(F.array(*[F.lit(b) for b in numbers]), F.col("block")) - 1 if numbers else F.lit(0).cast("long")
    facts = stage(queries.select(number.alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "kind", "data")]),
                  "numbered-query-blocks")
    blocks = rows.mapInArrow(_blocks(scale, CANDIDATE_BLOCK), _BLOCK)
    pairs = blocks.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(len(numbers), 1) - 1).cast("long"))))
    met = join_group_facts(pairs, facts, ["q_block"], "block", broadcast_rows=broadcast_rows)
    found = met.mapInArrow(_searched(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
