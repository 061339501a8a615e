"""Texts as arrays of lines. A text stays in its row: nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletools.functions.kinds import col

_RARE_BREAK = r"[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) \
    + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(_SPACE))


def without_hashes(line: Column) -> Column:
    return strip(F.ltrim(line, F.lit("#")))


def with_lines(df: DataFrame, text: str, id: str, stripped: bool = True,
               mark: str | None = None) -> DataFrame:
    """(id, text, lines). A final line break ends the last line and starts no new one.

    A text without ``mark`` (in any case) is not split at all, its lines are NULL. Each step is
    a column of its own, so that a later use reads it instead of splitting again.
    """
    body = col(text)
    split = F.when(body.rlike(_RARE_BREAK), F.split(body, LINE_BREAK, -1)).otherwise(F.split(body, "\n", -1))
    if mark is not None:
        split = F.when(F.contains(F.lower(body), F.lit(mark.lower())), split)
    parts = df.select(col(id).alias("id"), body.alias("text"), split.alias("lines"))
    ended = F.when(F.element_at("lines", -1) == "", F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines"))
    lined = parts.withColumn("lines", ended)
    return lined.withColumn("lines", F.transform("lines", strip)) if stripped else lined


def exploded(df: DataFrame, array: Column | str, *names: str) -> DataFrame:
    """(other columns, position, element) per element, for every column but the array itself.

    The outer form with a test on the result: for the plain form Spark puts a test of the
    array in front of the scan, and so would compute the array several times.
    """
    position, element = names
    kept = [c for c in df.columns if c != array]
    return df.select(*[col(c) for c in kept], F.posexplode_outer(array).alias(position, element)) \
        .where(F.col(position).isNotNull())


def first_where(array: str, condition) -> Column:
    """1-based position of the first element that meets the condition, NULL if none does."""
    return F.array_min(F.transform(array, lambda e, i: F.when(condition(e), i + 1)))


def last_where(array: str, condition) -> Column:
    """1-based position of the last element that meets the condition, NULL if none does."""
    return F.array_max(F.transform(array, lambda e, i: F.when(condition(e), i + 1)))


def starts_with_any(line: Column, *marks: str) -> Column:
    met = F.startswith(line, F.lit(marks[0]))
    for mark in marks[1:]:
        met = met | F.startswith(line, F.lit(mark))
    return met


def starts_with_tag(line: Column, tag: str) -> Column:
    """In any case, after white space; the cheap test comes first."""
    return F.contains(F.upper(line), F.lit(tag.upper())) & F.startswith(F.upper(strip(line)), F.lit(tag.upper()))
