"""Groups of equal texts dealt to shards of nearly equal bytes by Karmarkar-Karp differencing.

A partial partition holds the bytes that each shard gets from some groups. At first there is one for each group; again and again the two with the
largest spread are combined in opposite order, the largest bin of one with the smallest of the other. Tasks do
this for about ``TASK_GROUPS`` groups each and are left with one partial partition of eight numbers, and those are combined by the same
rule. Rows are numbered within shards by counting ranges of rows first.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletools.sources.staging import stage

SHARDS = 8
TASK_GROUPS = 50_000
RANGE_ROWS = 50_000


def differencing(partials: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Combine all partial partitions (bytes per bin) into one.

    Returns for each of them the bin of the result that each of its bins goes to, and the bytes of the result's
    bins. Ties go by the order of making, so reruns agree.
    """
    if not partials:
        return [], []
    bins = range(len(partials[0]))
    sums = [list(p) for p in partials]
    made: list[tuple] = [()] * len(sums)
    heap = [(min(p) - max(p), i) for i, p in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        down = sorted(bins, key=sums[a].__getitem__, reverse=True)
        up = sorted(bins, key=sums[b].__getitem__)
        both = [sums[a][i] + sums[b][j] for i, j in zip(down, up)]
        made.append((a, down, b, up))
        sums.append(both)
        heapq.heappush(heap, (min(both) - max(both), len(sums) - 1))
    goes: list = [None] * len(sums)
    goes[-1] = list(bins)
    for node in range(len(sums) - 1, len(partials) - 1, -1):
        for child, order in (made[node][:2], made[node][2:]):
            goes[child] = [0] * len(bins)
            for place, bin_ in zip(goes[node], order):
                goes[child][bin_] = place
    return goes[:len(partials)], sums[-1]


def _dealt(shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("digest", "ascending")])
        goes, _ = differencing([[n] + [0] * (shards - 1) for n in table["bytes"].to_pylist()])
        return pa.table({"digest": table["digest"], "task": table["task"], "bytes": table["bytes"],
                         "bin": pa.array([g[0] for g in goes], pa.int32())})
    return run


def shard_groups(groups: DataFrame, shards: int = SHARDS, task_groups: int = TASK_GROUPS) -> DataFrame:
    """``digest, shard`` of every group (digest, bytes)."""
    spark = groups.sparkSession
    groups = stage(groups, "shard-groups")
    tasks = 1 + groups.count() // task_groups
    task = F.pmod(F.xxhash64("digest"), F.lit(tasks)).cast("int")
    dealt = stage(groups.select("digest", "bytes", task.alias("task")).groupBy("task").applyInArrow(
        _dealt(shards), "digest binary, task int, bytes long, bin int"), "shard-bins")
    # eight numbers for each task
    partials = {}
    for r in dealt.groupBy("task", "bin").agg(F.sum("bytes").alias("bytes")).collect():
        partials.setdefault(r["task"], [0] * shards)[r["bin"]] = r["bytes"]
    order = sorted(partials)
    goes, _ = differencing([partials[t] for t in order])
    places = spark.createDataFrame([(t, b, g[b]) for t, g in zip(order, goes) for b in range(shards)],
                                   "task int, bin int, shard int")
    return dealt.join(F.broadcast(places), ["task", "bin"]).select("digest", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, task_groups: int = TASK_GROUPS,
                    range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``.

    Size is the bytes of the text (null: none) and one more for its end. Rows with equal texts, null and empty ones too, stay together,
    so a group larger than a fair share makes its shard larger. Slots count from 0 in each shard without gaps.
    Repeated rows are rows of their own.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stage(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                             F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    ranges = max(16, rows.count() // (shards * range_rows))
    placed = shard_groups(groups, shards, task_groups)
    range_ = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(ranges)).cast("int")
    dealt = stage(rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard", range_.alias("range")),
                  "shards")
    counts = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    return dealt.join(counts, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.row_number().over(inside) - 1).alias("slot"))
