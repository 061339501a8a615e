"""Records of CSV files over several lines, read by as many tasks as a file has splits.

Whether a line of a CSV file begins a record depends on all before it: a quote may be open. But for one line, and so for one split,
there are only two cases, outside and inside of quotes. A first pass tells for each split how either case ends; put together in the
order of the splits, this gives the case in which each really begins. In a second pass every task joins the lines of its records. What a
record has in other splits than the one that it begins in is sent there by the number of that split.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# functions travel to the executors with their code, whether or not this package is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# a quoted field up to its closing quote; fields that are closed on the line, each with its comma
_QUOTED = rb'[^"]*+(?:""[^"]*+)*+'
_CLOSED = rb'(?>(?:"' + _QUOTED + rb'"(?!")[^,]*+|[^",][^,]*+)?+,)*+'
_OPENS = re.compile(_CLOSED + rb'"' + _QUOTED + rb'\Z', re.DOTALL)
_STAYS = re.compile(_QUOTED + rb'\Z', re.DOTALL)
_CLOSES = re.compile(_QUOTED + rb'"(?!")[^,]*+', re.DOTALL)


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quote is open behind the line, if one is or is not before it. A quote opens a field only as its first character."""
    if not inside:
        return _OPENS.match(line) is not None
    if _STAYS.match(line):
        return True
    rest = line[_CLOSES.match(line).end():]
    return rest[:1] == b"," and _OPENS.match(rest[1:]) is not None


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return spark.read.option("lineSep", "\n").text(files).select(F.col("value").cast("binary").alias("line"), *place)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of each split in a batch, which come one after the other."""
    files, splits, at = batch.column("file").to_pylist(), batch.column("split").to_pylist(), 0
    for to in range(1, len(batch) + 1):
        if to == len(batch) or (files[to], splits[to]) != (files[at], splits[at]):
            yield (files[at], splits[at]), batch.column("line").slice(at, to - at)
            at = to


def _with_quotes(lines: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.match_substring(lines, b'"')).to_pylist()


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, for a beginning outside and inside of quotes: whether it ends inside, and whether a record begins in it."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for key, lines in _runs(batch):
            state, begins = found.setdefault(key, ([False, True], [True, False]))
            for i in _with_quotes(lines):
                line = lines[i].as_py()
                for way in (0, 1):
                    state[way] = ends_inside(line, state[way])
                    begins[way] = begins[way] or not state[way]
    for (file, split), (state, begins) in found.items():
        yield pa.RecordBatch.from_pylist([{"file": file, "split": split, "ends": state, "begins": begins}], pa.schema([
            ("file", pa.string()), ("split", pa.int64()), ("ends", pa.list_(pa.bool_())), ("begins", pa.list_(pa.bool_()))]))


def _openers(ways: list) -> dict[str, dict[int, int]]:
    """For each split that begins inside of quotes the one in which that record begins. ``ways``: in order of file and split."""
    found: dict[str, dict[int, int]] = {}
    file, inside, opener = None, False, 0
    for r in ways:
        if r["file"] != file:
            file, inside, opener = r["file"], False, r["split"]
            found[file] = {}
        if inside:
            found[file][r["split"]] = opener
        if r["begins"][inside]:
            opener = r["split"]
        inside = r["ends"][inside]
    return found


_RECORDS = pa.schema([("file", pa.string()), ("opener", pa.int64()), ("split", pa.int64()), ("header", pa.bool_()), ("record", pa.binary())])


def _joined(openers: dict[str, dict[int, int]]):
    """Lines joined to records. ``opener`` is null for a record that is whole, else the split in which it begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, parts, opener, header_due = None, False, [], None, False

        def rows(records: list[bytes], opener=None) -> pa.RecordBatch:
            nonlocal header_due
            records = [r.removesuffix(b"\r") for r in records] if opener is None else records
            kept = [r for r in records if r] if opener is None else records
            header = [False] * len(kept)
            if header_due and kept:
                header[0], header_due = True, False
            n = len(kept)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([opener] * n, pa.int64()),
                                               pa.array([key[1]] * n, pa.int64()), pa.array(header), pa.array(kept, pa.binary())], schema=_RECORDS)

        def open_rest() -> Iterator[pa.RecordBatch]:
            if key is not None and parts:
                yield rows([b"\n".join(parts)], key[1] if opener is None else opener)

        for batch in batches:
            for new, lines in _runs(batch):
                if new != key:
                    yield from open_rest()
                    key, parts = new, []
                    opener = openers[key[0]].get(key[1])
                    inside, header_due = opener is not None, key[1] == 0
                values, at, whole = lines.to_pylist(), 0, []
                for i in _with_quotes(lines):
                    if not inside:
                        whole += values[at:i]
                        at = i
                    inside_before, inside = inside, ends_inside(values[i], inside)
                    if inside_before and not inside:
                        parts += values[at:i + 1]
                        if opener is None:
                            whole.append(b"\n".join(parts))
                        else:
                            yield rows([b"\n".join(parts)], opener)
                        parts, opener, at = [], None, i + 1
                    elif not inside:
                        whole.append(values[i])
                        at = i + 1
                if inside:
                    parts += values[at:]
                else:
                    whole += values[at:]
                if whole:
                    yield rows(whole)
        yield from open_rest()
    return run


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``record, header``: every record of the files as bytes, and whether it is the first of its file. Empty lines between records are
    left out. Records end with a line feed, with or without a carriage return before it. A byte or two per split come to the driver."""
    lines = _lines(spark, files)
    ways = lines.mapInArrow(_ways, "file string, split long, ends array<boolean>, begins array<boolean>").orderBy("file", "split").collect()
    found = lines.mapInArrow(_joined(_openers(ways)), "file string, opener long, split long, header boolean, record binary")
    whole = found.where("opener IS NULL").select("record", "header")
    in_order = F.sort_array(F.collect_list(F.struct("split", "record")))
    line_feed = F.lit(bytearray(b"\n"))
    joined = F.aggregate(F.slice(F.transform(in_order, lambda p: p["record"]), F.lit(2), F.size(in_order)),
                         F.element_at(in_order, 1)["record"], lambda a, b: F.concat(a, line_feed, b))
    parted = found.where("opener IS NOT NULL").groupBy("file", "opener").agg(
        joined.alias("record"), F.bool_or("header").alias("header"))
    ended = F.when(F.endswith("record", F.lit(bytearray(b"\r"))), F.expr("substring(record, 1, octet_length(record) - 1)")).otherwise(F.col("record"))
    return whole.unionByName(parted.select(ended.alias("record"), "header"))
