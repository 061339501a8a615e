"""Exact quantiles that never hold a whole column or group in one task.

Of whole columns: a double is read as a 64-bit number in the same order, and numbers are counted by their first 16 bits, then, within the
cell that holds a wanted rank, by the next 16 below what is common to all of it, and so on. Every pass serves all columns and all wanted ranks, and there
are at most four of them. A cell with few rows is listed value by value, which ends it at once.

Of groups: values are counted per group and value, and ranked by one window. Groups with very many values are narrowed instead: a
sample proposes cut points around each rank, an exact count of the rows at and between them proves or corrects them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletools.functions.joins import join_group_facts
from tabletools.functions.kinds import batches, col, is_missing, number
from tabletools.sources.staging import stage

DIGIT_BITS = 16              # bits of a number that one pass counts by
LISTED_ROWS = 50_000         # rows of a cell whose values are listed
HELD_CELLS = 1 << 18         # cells that a task holds before it merges them
COLUMNS_PER_PASS = 200
GROUP_VALUES = 1_000_000     # distinct values of one group that one task may sort
GRID = 256                   # points of the sketch of a group's bracket
GRID_ROWS = 200              # sampled rows per point

# functions travel to the executors with their code, whether or not this package is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def linear_position(n: int, p: float) -> tuple[int, int, float]:
    """Ranks below and above the p-quantile of n values, and the share of the upper one."""
    pos = p * (n - 1)
    low = math.floor(pos)
    return low, min(low + 1, n - 1), pos - low


_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_ordered_bits(number_: int) -> float:
    """The double behind a number of :func:`ordered_bits`."""
    bits = np.array([number_], np.uint64)
    return float(np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64)[0])


@dataclass
class _Target:
    """A wanted quantile of a column and the numbers from ``lo`` to ``hi`` that hold its two ranks; ``below``: rows before them."""
    column: int
    p: float
    lo: int = 0
    hi: int = (1 << 64) - 1
    below: int = 0
    inside: int | None = None
    ranks: tuple[int, int, float] | None = None
    value: float | None = None

    @property
    def cells(self) -> tuple[int, int, int, int]:
        """Column, range, and by how many bits its numbers are cut to tell their cells apart."""
        listed = self.inside is not None and self.inside <= LISTED_ROWS
        return self.column, self.lo, self.hi, 0 if listed else max(0, (self.hi - self.lo).bit_length() - DIGIT_BITS)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Cells (rows of cell, n, lo, hi) with equal numbers put together, in order."""
    whole = np.concatenate(parts)
    whole = whole[np.argsort(whole[:, 0], kind="stable")]
    first = np.flatnonzero(np.append(True, whole[1:, 0] != whole[:-1, 0]))
    return np.column_stack([whole[first, 0], np.add.reduceat(whole[:, 1], first), np.minimum.reduceat(whole[:, 2], first),
                            np.maximum.reduceat(whole[:, 3], first)]) if len(whole) else whole


def _counted(wanted: list[tuple[int, int, int, int]]):
    """For each wanted range the rows of its cells in a task, and the least and largest number of each."""
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in wanted]
        sizes = [0] * len(wanted)
        for batch in batches_:
            columns = {}
            for i, (column, lo, hi, shift) in enumerate(wanted):
                if column not in columns:
                    values = batch.column(column).drop_null().to_numpy(zero_copy_only=False)
                    columns[column] = np.sort(ordered_bits(values))
                numbers = columns[column]
                if lo > 0 or hi < (1 << 64) - 1:
                    numbers = numbers[np.searchsorted(numbers, np.uint64(lo)):np.searchsorted(numbers, np.uint64(hi), "right")]
                if not len(numbers):
                    continue
                cells = (numbers - np.uint64(lo)) >> np.uint64(shift)
                first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                last = np.append(first[1:], len(cells)) - 1
                held[i].append(np.column_stack([cells[first], (last - first + 1).astype(np.uint64), numbers[first], numbers[last]]))
                sizes[i] += len(first)
                if sizes[i] > HELD_CELLS:
                    held[i] = [_merged(held[i])]
                    sizes[i] = len(held[i][0]) // 2              # merged again when as many have come as there are now
        for i, parts in enumerate(held):
            if parts:
                cells = _merged(parts)
                ordered = [pa.array((cells[:, c] ^ _SIGN).view(np.int64)) for c in (2, 3)]        # signed numbers in the same order
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), i)), pa.array(cells[:, 0].view(np.int64)),
                                                  pa.array(cells[:, 1].view(np.int64)), *ordered], ["i", "cell", "n", "lo", "hi"])
    return run


def _settle(t: _Target, cells: list) -> None:
    """What a pass has told of a target: its value, or a smaller range. ``cells``: those that hold its ranks, in order."""
    low, high, share = t.ranks
    lows, highs = ([c for c in cells if c["start"] <= r - t.below < c["start"] + c["n"]][0] for r in (low, high))
    ends = [int(v) + (1 << 63) for v in (lows["lo"], lows["hi"], highs["lo"], highs["hi"])]
    if lows["cell"] != highs["cell"]:                                  # neighbours in two cells are the ends of these
        low_value, high_value = from_ordered_bits(ends[1]), from_ordered_bits(ends[2])
    elif ends[0] == ends[1]:
        low_value = high_value = from_ordered_bits(ends[0])
    else:
        t.lo, t.hi, t.below, t.inside = ends[0], ends[1], t.below + lows["start"], lows["n"]
        return
    t.value = low_value if low_value == high_value or share == 0 else low_value + (high_value - low_value) * share


_CELLS = "i long, cell long, n long, lo long, hi long"


def digit_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, cell, n, lo, hi``: the rows of each column by the first digit of their numbers, as the first pass of
    :func:`column_quantiles` counts them. Those of parts of a table add up to those of the whole."""
    rows = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, cell long, n long, lo long, hi long")
    names = F.array(*[F.lit(c) for c in columns])
    cells = rows.mapInArrow(_counted([_Target(i, 0.0).cells for i in range(len(columns))]), _CELLS)
    return cells.select(F.get(names, F.col("i")).alias("column"), "cell", "n", "lo", "hi")


def cells_of_value(df: DataFrame, values: dict[str, tuple[float, int]]) -> DataFrame:
    """The cells of columns that hold one value n times; ``values``: {column: (value, n)}."""
    rows = []
    for c, (value, n) in values.items():
        bits = int(ordered_bits(np.array([value]))[0])
        rows.append((c, bits >> (64 - DIGIT_BITS), n, bits - (1 << 63), bits - (1 << 63)))
    return df.sparkSession.createDataFrame(rows, "column string, cell long, n long, lo long, hi long")


def _pass(rows: DataFrame, targets: list[_Target], first: DataFrame | None = None) -> None:
    """One look at all rows for all targets that have no value yet, or at the cells that a first one has counted."""
    wanted = list(dict.fromkeys(t.cells for t in targets))
    cells = (rows.mapInArrow(_counted(wanted), _CELLS) if first is None else first) \
        .groupBy("i", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    places = {w: i for i, w in enumerate(wanted)}
    upto = Window.partitionBy("i").orderBy("lo")                       # some ten thousand cells of a range at most
    cells = cells.withColumn("start", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")) \
        .withColumn("total", F.sum("n").over(Window.partitionBy("i")))
    asked = {(places[t.cells], float(t.p), *([int(r - t.below) for r in t.ranks[:2]] if t.ranks else (None, None))) for t in targets}
    asked = rows.sparkSession.createDataFrame(sorted(asked, key=str), "i long, p double, low long, high long")
    low = F.coalesce("low", F.floor(F.col("p") * (F.col("total") - 1)))
    high = F.coalesce("high", F.least(low + 1, F.col("total") - 1))
    found = cells.join(F.broadcast(asked), "i").where((F.col("start") <= high) & (F.col("start") + F.col("n") > low)) \
        .select(*cells.columns).distinct()
    of: dict[int, list] = {}
    for r in found.collect():                                          # two cells a target at most
        of.setdefault(r["i"], []).append(r)
    for t, own in [(t, of.get(places[t.cells], [])) for t in targets]:
        if own:
            t.ranks = t.ranks or linear_position(own[0]["total"], t.p)
            _settle(t, own)


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     cells: DataFrame | None = None) -> dict[str, dict[float, float | None]]:
    """{column: {p: exact quantile with linear interpolation}}; None for a column without values. ``cells``: the first pass, where it is
    known from :func:`digit_cells`."""
    result = {c: dict.fromkeys(probs) for c in columns}
    for part in batches(columns, COLUMNS_PER_PASS):
        rows = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(part)])
        targets = [_Target(i, p) for i in range(len(part)) for p in probs]
        open_, first = targets, None
        if cells is not None:
            place = (F.array_position(F.array(*[F.lit(c) for c in part]), F.col("column")) - 1).alias("i")
            first = cells.where(F.col("column").isin(part)).select(place, "cell", "n", "lo", "hi")
        while open_:
            _pass(rows, open_, *([first] if first is not None else []))
            first = None
            open_ = [t for t in open_ if t.value is None and t.ranks is not None]
        for t in targets:
            result[part[t.column]][t.p] = t.value
    return result


def _end_ranks(counted: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("end", F.sum("n").over(w))


def _pick(ranks: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """Values at two ranks per key: the first value whose running count passes the rank."""
    return ranks.groupBy(*keys).agg(
        F.min(F.when(F.col("end") > low, F.col("v"))).alias("low_value"),
        F.min(F.when(F.col("end") > high, F.col("v"))).alias("high_value"))


def group_quantiles(df: DataFrame, key: str, value: str, probs: list[float],
                    group_values: int = GROUP_VALUES) -> DataFrame:
    """(key, n, q: array of exact quantiles in the order of ``probs``), one row per group.

    Values are counted per (key, value) first. A group with few distinct values is then
    ranked by one window. Hot groups are narrowed round by round, as columns are, and only
    the values left in the brackets at the end are ranked.
    """
    rows = df.where(~is_missing(df, key) & ~is_missing(df, value)).select(
        col(key).alias("k"), number(df, value).alias("v"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # no group has more distinct values than rows, so only large groups need a sketch
    hot = stage(sizes.where(F.col("total") > group_values), "large-groups")
    if not hot.isEmpty():
        sketched = join_group_facts(rows, hot.select("k"), ["k"], "v").groupBy("k") \
            .agg(F.approx_count_distinct("v").alias("d")).where(F.col("d") > group_values)
        hot = stage(hot.join(sketched.select("k"), "k"), "hot-groups")
    if hot.isEmpty():
        return _ranked_quantiles(rows, probs).select(F.col("k").alias(key), "n", "q")
    marked = join_group_facts(rows, hot, ["k"], "v", how="left")
    cold = _ranked_quantiles(marked.where(F.col("total").isNull()).select("k", "v"), probs)
    warm = _hot_quantiles(marked.where(F.col("total").isNotNull()).select("k", "v"),
                          hot, probs, group_values)
    return cold.unionByName(warm).select(F.col("k").alias(key), "n", "q")


def _ranked_quantiles(rows: DataFrame, probs: list[float]) -> DataFrame:
    ranks = _end_ranks(rows.groupBy("k", "v").agg(F.count("*").alias("n")), ["k"]) \
        .withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    parts = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("total") - 1)
        low = F.floor(position)
        parts.append((F.min(F.when(F.col("end") > low, F.col("v"))).alias(f"low{i}"),
                      F.min(F.when(F.col("end") > F.least(low + 1, F.col("total") - 1), F.col("v")))
                      .alias(f"high{i}"),
                      F.max(position - low).alias(f"share{i}")))
    picked = ranks.groupBy("k").agg(F.sum("n").alias("n"), *[e for part in parts for e in part])
    return picked.select("k", "n", F.array(*[
        F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * F.col(f"share{i}")
        for i in range(len(probs))]).alias("q"))


def _hot_quantiles(rows: DataFrame, hot: DataFrame, probs: list[float],
                   group_values: int) -> DataFrame:
    """One state row per wanted quantile: its two ranks, the bracket [lo, hi] that holds them,
    the rows below and inside it, and the value once it is known."""
    position = F.col("p") * (F.col("total") - 1)
    state = hot.withColumn("pi", F.explode(F.sequence(F.lit(0), F.lit(len(probs) - 1)))) \
        .withColumn("p", F.array(*[F.lit(float(p)) for p in probs])[F.col("pi")]) \
        .select("k", "pi", F.floor(position).alias("low"),
                F.least(F.floor(position) + 1, F.col("total") - 1).alias("high"),
                (position - F.floor(position)).alias("share"), "lo", "hi",
                F.lit(0).cast("long").alias("below"), F.col("total").alias("inside"),
                F.lit(group_values + 1).cast("long").alias("d"),
                F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"))
    state = stage(state, "quantile-state")
    wide = F.col("value").isNull() & (F.col("d") > group_values)
    while smallest := state.where(wide).agg(F.min("d")).first()[0]:
        state = stage(state.where(~wide).union(_narrow_groups(rows, state.where(wide), smallest)), "quantile-state")
    brackets = state.where("value IS NULL")
    left = join_group_facts(rows, brackets.select("k", "pi", "lo", "hi"), ["k"], "v") \
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
    ranks = _end_ranks(left.groupBy("k", "pi", "v").agg(F.count("*").alias("n")), ["k", "pi"])
    ranks = ranks.join(brackets.select("k", "pi", "low", "high", "below", "share"), ["k", "pi"])
    picked = _pick(ranks, ["k", "pi", "share"], F.col("low") - F.col("below"), F.col("high") - F.col("below"))
    values = picked.select("k", "pi", _between("low_value", "high_value").alias("q")) \
        .union(state.where("value IS NOT NULL").select("k", "pi", "value"))
    arrays = values.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pi", "q"))).alias("s"))
    return arrays.join(hot, "k").select("k", F.col("total").alias("n"), F.transform("s", lambda s: s["q"]).alias("q"))


def _between(low: str, high: str) -> Column:
    return F.col(low) + (F.col(high) - F.col(low)) * F.col("share")


def _narrow_groups(rows: DataFrame, state: DataFrame, smallest: int) -> DataFrame:
    """One round for all open brackets: a sample proposes two cut points around the wanted rank,
    an exact count of the rows below, on, between and above them says where the rank is.

    A cut point is a cell of its own, so a bracket always gets smaller, also when one value
    fills most of it. Two neighbouring ranks in two cells are the cells' end values.
    """
    bracket = ["k", "lo", "hi"]
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    brackets = state.select(*bracket).distinct()
    sample = rows.sample(min(1.0, GRID * GRID_ROWS / smallest), seed=smallest % 997)
    grid = join_group_facts(sample, brackets, ["k"], "v").where(inside).groupBy(*bracket).agg(
        F.percentile_approx("v", [i / GRID for i in range(1, GRID)], 4 * GRID).alias("grid"))
    place = F.floor((F.col("low") - F.col("below")) / F.col("inside") * GRID).cast("int") - 1
    cuts = stage(state.join(grid, bracket, "left").select(
        "k", "pi", "low", "high", "share", "lo", "hi", "below",
        F.coalesce(F.get("grid", F.greatest(place - 2, F.lit(0))), "lo").alias("c1"),
        F.coalesce(F.get("grid", F.least(place + 3, F.lit(GRID - 2))), "hi").alias("c2")), "quantile-cuts")
    cell = (F.col("v") >= F.col("c1")).cast("int") + (F.col("v") > F.col("c1")).cast("int") \
        + (F.col("v") >= F.col("c2")).cast("int") + (F.col("v") > F.col("c2")).cast("int")
    cells = join_group_facts(rows, cuts.select("k", "pi", "lo", "hi", "c1", "c2"), ["k"], "v").where(inside) \
        .groupBy("k", "pi", cell.alias("cell")).agg(
            F.count("*").alias("n"), F.min("v").alias("cell_lo"), F.max("v").alias("cell_hi"),
            F.approx_count_distinct("v").alias("cell_d"))
    before = Window.partitionBy("k", "pi").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1)      # at most five cells
    cells = cells.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    start = F.col("below") + F.col("skip")
    has_low, has_high = ((start <= F.col(r)) & (F.col(r) < start + F.col("n")) for r in ("low", "high"))
    found = cuts.join(cells, ["k", "pi"]).where(has_low | has_high).groupBy("k", "pi", "low", "high", "share").agg(
        F.min("cell_lo").alias("lo"), F.max("cell_hi").alias("hi"), F.min(start).alias("below"),
        F.sum("n").alias("inside"), F.sum("cell_d").alias("d"),
        F.count("*").alias("cells"), F.max(F.when(has_low, F.col("cell_hi"))).alias("low_value"),
        F.max(F.when(has_high, F.col("cell_lo"))).alias("high_value"))
    value = F.when(F.col("cells") == 2, _between("low_value", "high_value")) \
        .when(F.col("lo") == F.col("hi"), F.col("lo"))
    return found.withColumn("value", value).select(*state.columns)
