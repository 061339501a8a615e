"""Taking rows out of a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.functions.joins import fits_broadcast
from tabletools.sources.staging import stage


def without(docs: DataFrame, dropped: DataFrame, keys: dict) -> DataFrame:
    """The rows of ``docs``, with its columns, that are not among ``dropped``. ``keys``: for each column of ``dropped`` the
    expression on ``docs`` that equals it; nulls are equal. The dropped keys are broadcast if a count shows that
    they are few, so that texts stay where they are; else both sides shuffle."""
    dropped = stage(dropped.select(*[F.col(c).alias(f"_dropped_{c}") for c in keys]), "dropped")
    same = [e.eqNullSafe(dropped[f"_dropped_{c}"]) for c, e in keys.items()]
    return docs.join(F.broadcast(dropped) if fits_broadcast(dropped) else dropped, same, "left_anti")


def one_text_each(docs: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """``doc_id, text`` and the label of the documents in ``wanted`` (doc_id, label; few rows): one row of each, however often it repeats,
    with the largest of its texts in the order of their bytes."""
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    return rows.groupBy("doc_id", label).agg(F.max("text").alias("text"))
