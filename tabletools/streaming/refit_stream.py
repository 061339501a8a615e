"""Rows that arrive as a stream, without those that came before, and cleaning rules fitted on all that has come.

Spark's state keeps a fingerprint of 16 bytes per row, for ever or as long as a watermark allows. Each batch writes its new rows, and the digits of
its numbers, into folders named by the number of the batch; a batch that is run again after a failure writes over its own. Digits of
batches add up, so medians and fences are fitted from sums, and only cells that hold a wanted rank are looked up in the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabletools.functions.kinds import NUMERIC, col, columns_of
from tabletools.functions.quantiles import digit_cells
from tabletools.operators.cleaning import CleaningModel, fit_cleaning
from tabletools.sources.staging import staging_path

_ROWS, _CELLS = "rows", "cells"


def distinct_stream(stream: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The rows of a stream that have not come before. With ``event_time`` fingerprints are forgotten once a row's time is ``delay``
    behind the latest: the state stays bounded, and a repeat that comes later than that is kept."""
    everything = [col(c) for c in stream.columns]
    prints = ["_print_" + "_" * len(max(stream.columns, key=len)), "_again_" + "_" * len(max(stream.columns, key=len))]
    marked = stream.withColumn(prints[0], F.xxhash64(*everything)).withColumn(prints[1], F.xxhash64(F.lit(1), *everything))
    if event_time is None:
        return marked.dropDuplicates(prints).drop(*prints)
    return marked.withWatermark(event_time, delay or "0 seconds").dropDuplicatesWithinWatermark(prints).drop(*prints)


def append_distinct_stream(stream: DataFrame, folder: str, checkpoint: str | None = None, event_time: str | None = None,
                           delay: str | None = None) -> StreamingQuery:
    """Write what is new of the input at hand under ``folder`` and stop. Started again with its checkpoint it goes on where it was: a row is
    written once, whatever fails in between."""
    root, numbers = folder.rstrip("/"), columns_of(stream, NUMERIC)

    def write(batch: DataFrame, number: int) -> None:
        name = f"{number:012d}"
        batch.write.mode("overwrite").parquet(f"{root}/{_ROWS}/{name}")
        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{root}/{_ROWS}/{name}")
        # last, as a batch counts once its cells are whole
        digit_cells(written, numbers).write.mode("overwrite").parquet(f"{root}/{_CELLS}/{name}")

    return distinct_stream(stream, event_time, delay).writeStream.outputMode("append").foreachBatch(write) \
        .option("checkpointLocation", checkpoint or staging_path(stream.sparkSession, "stream-state")) \
        .trigger(availableNow=True).start()


def _batches(spark: SparkSession, root: str) -> list[str]:
    """The names of the batches that are whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{_CELLS}/*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(s.getPath().getParent().getName() for s in found or [])


def _read(spark: SparkSession, root: str, kind: str, schema: T.StructType | str) -> DataFrame:
    names = _batches(spark, root)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{kind}/{n}" for n in names])


def stream_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows that :func:`append_distinct_stream` has written."""
    return _read(spark, folder.rstrip("/"), _ROWS, schema)


def refit_cleaning(spark: SparkSession, folder: str, schema: T.StructType) -> CleaningModel:
    """The rules of ``fit_cleaning`` for all rows that have come: the same as for one table of them, with the first and longest pass of its
    quantiles taken from the sums of the batches."""
    cells = _read(spark, folder.rstrip("/"), _CELLS, "column string, cell long, n long, lo long, hi long")
    return fit_cleaning(stream_rows(spark, folder, schema), distinct=True, cells=cells)
