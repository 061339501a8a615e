"""Correlations of tables with many columns: products of column blocks, added up as a distributed table.

Columns are cut into blocks. A task multiplies each pair of blocks, batch of rows by batch, and passes on one sum per pair of blocks; sums of a
pair are added by a tree. So neither a task nor the driver holds the whole matrix: a task holds the pairs of one tile of
blocks at a time, a wider table takes more passes, and the matrix is a table with a row per pair of columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128             # columns of a block
TILE = 12               # blocks on a side of the tile that a pass takes
FAN = 64                # sums that one step of the tree adds
NOISE = 1e-14           # rounding left over in the sums of a column that is constant where the other is present

# functions travel to the executors with their code, whether or not this package is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SUMS = "i int, j int, node long, sums binary"
_SUM_TYPES = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("sums", pa.binary())])


def _sums_of(x: tuple, y: tuple, gaps: bool) -> np.ndarray:
    """Sums over a batch for a pair of blocks, each given as (values, 1 where present, squares). With gaps: six matrices of
    sums over the rows where both are present; without: the matrix of products, sums and squares of each column, and the rows."""
    if gaps:
        return np.stack([x[1].T @ y[1], x[0].T @ y[1], x[1].T @ y[0], x[2].T @ y[1], x[1].T @ y[2], x[0].T @ y[0]]).ravel()
    columns = [v.sum(axis=0) for v in (x[0], y[0], x[2], y[2])]
    return np.concatenate([(x[0].T @ y[0]).ravel(), *columns, [len(x[0])]])


def _products(starts: list[int], sizes: list[int], pairs: list[tuple[int, int]], means: list[float], gaps: list[bool]):
    """``starts``: the place of each block's first column in the batch, by block; ``gaps``: whether a column of the block has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(pairs, 0.0)
        for batch in batches:
            blocks = {}
            for b in {b for p in pairs for b in p}:
                columns = [batch.column(starts[b] + c).to_numpy(zero_copy_only=False).astype(float) for c in range(sizes[b])]
                values = np.column_stack(columns) - np.array(means[b * BLOCK:b * BLOCK + sizes[b]])
                present = ~np.isnan(values)
                values = np.where(present, values, 0.0)
                blocks[b] = (values, present.astype(float), values * values)
            for i, j in pairs:
                total[i, j] = total[i, j] + _sums_of(blocks[i], blocks[j], gaps[i] or gaps[j])
        node = TaskContext.get().partitionId()
        for (i, j), sums in total.items():
            if isinstance(sums, np.ndarray):
                yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "node": node, "sums": sums.tobytes()}], _SUM_TYPES)
    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    i, j, node = (k.as_py() for k in key)
    total = sum(np.frombuffer(s) for s in table["sums"].to_pylist())
    return pa.Table.from_pylist([{"i": i, "j": j, "node": node, "sums": total.tobytes()}], _SUM_TYPES)


def correlations_of_sums(sums: np.ndarray, n_x: int, n_y: int, gaps: bool) -> np.ndarray:
    """The correlation of each column of one block with each of another; NaN where it is undefined."""
    if gaps:
        n, x, y, xx, yy, xy = sums.reshape(6, n_x, n_y)
    else:
        xy, rest = sums[:n_x * n_y].reshape(n_x, n_y), sums[n_x * n_y:]
        x, y, xx, yy, n = np.split(rest, np.cumsum([n_x, n_y, n_x, n_y]))
        x, xx = x[:, None], xx[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        var_x, var_y = xx - x * x / n, yy - y * y / n
        r = (xy - x * y / n) / (np.sqrt(var_x) * np.sqrt(var_y))
    defined = (n >= 2) & (var_x > NOISE * xx) & (var_y > NOISE * yy) & (var_x > 0) & (var_y > 0)
    return np.where(defined, np.clip(r, -1.0, 1.0), np.nan)


def _pairs_of_columns(names: list[str], sizes: list[int], gaps: list[bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                i, j = row["i"], row["j"]
                r = correlations_of_sums(np.frombuffer(row["sums"]), sizes[i], sizes[j], gaps[i] or gaps[j])
                x, y = np.triu_indices(sizes[i], 1) if i == j else (k.ravel() for k in np.indices(r.shape))
                values, a, b = r[x, y], x + i * BLOCK, y + j * BLOCK
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k] for k in a], pa.string()), pa.array([names[k] for k in b], pa.string()),
                     pa.array(values, mask=np.isnan(values)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                    ["a", "b", "r", "ia", "ib"])
    return run


def block_correlations(values: DataFrame, names: list[str], means: list[float], gaps: list[bool]) -> DataFrame:
    """``a, b, r, ia, ib`` of each pair of columns, a before b; r is NULL where undefined; ``ia``, ``ib`` are their places.

    ``values``: doubles, null where missing, one column per name; ``means`` keep sums from cancelling; ``gaps``: whether a column misses values.
    """
    n_blocks = -(-len(names) // BLOCK)
    sizes = [min(BLOCK, len(names) - b * BLOCK) for b in range(n_blocks)]
    gap_of = [any(gaps[b * BLOCK:b * BLOCK + sizes[b]]) for b in range(n_blocks)]
    tiles = [range(t, min(t + TILE, n_blocks)) for t in range(0, n_blocks, TILE)]
    parts = []
    for u, rows in enumerate(tiles):
        for columns in tiles[u:]:
            blocks = sorted({*rows, *columns})
            starts, read = [0] * n_blocks, []
            for b in blocks:
                starts[b] = len(read)
                read += values.columns[b * BLOCK:b * BLOCK + sizes[b]]
            pairs = [(i, j) for i in rows for j in columns if i <= j]
            parts.append(values.select(*read).mapInArrow(_products(starts, sizes, pairs, means, gap_of), _SUMS))
    sums, left = reduce(DataFrame.unionByName, parts), max(p.rdd.getNumPartitions() for p in parts)
    while True:
        left = -(-left // FAN)
        sums = sums.withColumn("node", F.pmod("node", F.lit(left).cast("long"))).groupBy("i", "j", "node").applyInArrow(_added, _SUMS)
        if left == 1:
            break
    return sums.mapInArrow(_pairs_of_columns(names, sizes, gap_of), "a string, b string, r double, ia int, ib int")
