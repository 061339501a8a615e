"""Most frequent values and distinct counts of text columns, however long the texts: hashes of 8 bytes are counted, not texts.

A value is known by a 64-bit hash. Counting hashes ranks them by number, ties by the first characters of the text; the places of the ranking
that are asked for are settled by the texts themselves. Where ties share these characters, more of the text is read, of such
texts only. A second hash tells when texts of one hash are not the same: the count then starts over under another hash. So results
are exact, and a whole text leaves its partition only if it is among the result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletools.functions.kinds import col

SHOWN = 64              # first characters that a count carries along
SEEDS = 8
GROWTH = 4              # how much more of a text is read each time that ties share all of it so far


def value_hash(value: Column, seed: int) -> Column:
    """A 64-bit hash of a text, another one for each seed."""
    return F.xxhash64(value, F.lit(seed))


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])


def _facts(value: Column, seed: int) -> Column:
    """What is counted in place of a text."""
    return F.when(value.isNotNull(), F.struct(
        value_hash(value, seed).alias("h"), value_hash(value, -1 - seed).alias("again"), F.substring(value, 1, SHOWN).alias("shown"),
        (F.char_length(value) > SHOWN).alias("longer")))


def _hashed(texts: DataFrame, seed: int) -> DataFrame:
    """(i, fact): a row per value that is not null."""
    facts = F.array(*[F.struct(F.lit(i).alias("i"), _facts(F.col(c), seed).alias("fact")) for i, c in enumerate(texts.columns)])
    return texts.select(F.explode(facts).alias("f")).select("f.i", "f.fact").where("fact IS NOT NULL")


def _merged(hashed: DataFrame, *keys: str) -> DataFrame:
    """Counts per hash. ``split``: texts of this hash are not all the same."""
    return hashed.groupBy(*keys, "h").agg(
        F.count("*").alias("n"), F.min("shown").alias("shown"), F.max("longer").alias("longer"),
        (F.min("again") != F.max("again")).alias("split"))


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """{column: number of distinct values that are not null}. Values are told apart by two hashes, 16 bytes."""
    counts = dict.fromkeys(columns, 0)
    if columns:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col(c).isNotNull(), value_hash(F.col(c), 0)).alias("h"),
                                   value_hash(F.col(c), -1).alias("again")) for i, c in enumerate(_texts(df, columns).columns)])
        rows = _texts(df, columns).select(F.explode(pairs).alias("f")).select("f.*").where("h IS NOT NULL").distinct()
        counts |= {columns[r["i"]]: r["count"] for r in rows.groupBy("i").count().collect()}
    return counts


class _Split(Exception):
    """Texts that differ share a hash."""


def _check(rows: list) -> list:
    if any(r["split"] for r in rows):
        raise _Split
    return rows


def _least_of_ties(texts: DataFrame, column: str, n: int, k: int, start: str, seed: int) -> list[int]:
    """Hashes of the k least texts among those that begin with ``start`` and occur n times. Each round reads what follows of the texts
    that begin as the one in doubt."""
    found, length = [], SHOWN
    while True:
        value = F.col(column)
        facts = F.struct(value_hash(value, seed).alias("h"), value_hash(value, -1 - seed).alias("again"), F.lit(True).alias("longer"),
                         F.substring(value, len(start) + 1, length).alias("shown"))
        rows = texts.where(F.startswith(value, F.lit(start))).select(facts.alias("fact")).select("fact.*")
        top = _check(_merged(rows).where(F.col("n") == n).orderBy("shown", "h").limit(k + 1).collect())
        if len(top) <= k or top[k - 1]["shown"] != top[k]["shown"]:
            return found + [r["h"] for r in top[:k]]
        doubt = top[k]["shown"]
        sure = [r["h"] for r in top if r["shown"] < doubt]
        found, k, start, length = found + sure, k - len(sure), start + doubt, GROWTH * length


def _top_hashes(texts: DataFrame, k: int, seed: int) -> tuple[list[tuple[int, str, int]], dict[int, list[int]]]:
    """(results (i, value, n) of columns whose best values are short, {i: hashes of the best values} of others)."""
    ranked = Window.partitionBy("i").orderBy(F.desc("n"), "shown", "h")
    facts = _hashed(texts, seed).select("i", "fact.*")
    best = _merged(facts, "i").withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1)
    by_column: dict[int, list] = {}
    for r in _check(best.orderBy("i", "place").collect()):
        by_column.setdefault(r["i"], []).append(r)
    known, hashes = [], {}
    for i, rows in by_column.items():
        last = rows[k - 1] if len(rows) > k else None
        if last and (last["n"], last["shown"]) == (rows[k]["n"], rows[k]["shown"]):
            sure = [r["h"] for r in rows if (-r["n"], r["shown"]) < (-last["n"], last["shown"])]
            hashes[i] = sure + _least_of_ties(texts, f"c{i}", last["n"], k - len(sure), last["shown"], seed)
        elif any(r["longer"] for r in rows[:k]):
            hashes[i] = [r["h"] for r in rows[:k]]
        else:
            known += [(i, r["shown"], r["n"]) for r in rows[:k]]
    return known, hashes


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, value, n, rank): the k most frequent values of each column that are not null, ties by value, values as text."""
    schema = "column string, value string, n bigint"
    spark = df.sparkSession
    ranked = Window.partitionBy("column").orderBy(F.desc("n"), "value")

    def with_rank(counted: DataFrame) -> DataFrame:
        return counted.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    if not columns or k < 1:
        return with_rank(spark.createDataFrame([], schema))
    texts = _texts(df, columns)
    for seed in range(SEEDS):
        try:
            known, hashes = _top_hashes(texts, k, seed)
            break
        except _Split:
            continue
    else:
        raise RuntimeError(f"Texts that differ share a hash under each of {SEEDS} seeds.")
    result = spark.createDataFrame([(columns[i], v, n) for i, v, n in known], schema)
    if hashes:
        wanted = {i: value_hash(F.col(f"c{i}"), seed).isin(own) for i, own in hashes.items()}
        values = F.array(*[F.when(w, F.struct(F.lit(columns[i]).alias("column"), F.col(f"c{i}").alias("value"))) for i, w in wanted.items()])
        rows = texts.where(reduce(or_, [F.coalesce(w, F.lit(False)) for w in wanted.values()]))
        long = rows.select(F.explode(values).alias("v")).where("v IS NOT NULL").groupBy("v.column", "v.value").agg(F.count("*").alias("n"))
        result = result.unionByName(long)
    return with_rank(result)
