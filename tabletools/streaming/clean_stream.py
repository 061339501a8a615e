"""Rows that arrive later, cleaned by the rules fitted on the rows so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabletools.operators.cleaning import CleaningModel
from tabletools.sources.staging import staging_path


def clean_stream(model: CleaningModel, stream: DataFrame) -> DataFrame:
    """Fill, clip and date steps are per row, so they need no state; duplicates stay."""
    return model.transform(stream, dedup=False)


def append_clean_stream(model: CleaningModel, stream: DataFrame, path: str,
                        checkpoint: str | None = None) -> StreamingQuery:
    """Append the cleaned rows to a Parquet table and stop when the input at hand is read."""
    spark = stream.sparkSession
    return clean_stream(model, stream).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint or staging_path(spark, "stream-state")) \
        .trigger(availableNow=True).start(path)
