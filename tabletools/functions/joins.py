"""Joining facts about groups back to the rows of the groups."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletools.sources.staging import stage

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64
HOT_ROWS = 1_000_000      # rows of one key that one task may hold


def _row_bytes(df: DataFrame):
    """Size of a row, roughly: texts, bytes and arrays by their length, 16 bytes for anything else."""
    def size(f):
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return 16 * F.size(f.name)
        return F.lit(16)

    return reduce(add, [F.coalesce(size(f), F.lit(0)).cast("long") + 16 for f in df.schema.fields])


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Whether the table is small enough to send to every executor, by counting rows and bytes."""
    n, total = df.agg(F.count("*"), F.sum(_row_bytes(df))).first()
    return n <= (BROADCAST_ROWS if rows is None else rows) and (total or 0) <= BROADCAST_BYTES


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], spread_on: str,
                     how: str = "inner", size: str | None = None, broadcast_rows: int | None = None) -> DataFrame:
    """Join ``facts`` (few rows per key) to ``rows`` (one key may hold most of them).

    The facts should be staged, as they are read twice: to be measured and to be joined. They
    are broadcast when a count shows that they are small. Otherwise both sides shuffle: on
    key and salt, so that the rows of a hot key spread over ``SALTS`` tasks by the hash of
    ``spread_on`` while each fact is repeated once per salt. With ``size``, the fact that tells the
    number of rows per key, only the facts of hot keys are repeated. Both are merge joins by hint: Spark's own estimate, the size
    of a compressed file without its repeats, may take the facts for a table to broadcast.
    """
    if fits_broadcast(facts, broadcast_rows):
        return rows.join(F.broadcast(facts), keys, how)
    if size is None:
        return _join_salted(rows, facts, keys, spread_on, how)
    hot, cold = facts.where(F.col(size) > HOT_ROWS), facts.where(F.col(size) <= HOT_ROWS)
    among_hot = join_group_facts(rows, hot, keys, spread_on)
    others = join_group_facts(rows, hot.select(*keys), keys, spread_on, "left_anti")
    return among_hot.unionByName(others.join(cold.hint("merge"), keys, how))


def _join_salted(rows: DataFrame, facts: DataFrame, keys: list[str], spread_on: str, how: str) -> DataFrame:
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_on)), F.lit(SALTS)))
    spread = facts.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return salted.join(spread.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Per key the rows of ``first``; those of ``second`` where ``first`` has none.

    A shuffled anti join may split a hot key at run time (adaptive skew join), as no other
    shuffle depends on it.
    """
    have = stage(first.select(key).distinct(), "keys")
    left = second.join(F.broadcast(have) if fits_broadcast(have) else have, key, "left_anti")
    return first.unionByName(left.select(*first.columns))
