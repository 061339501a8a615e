"""Tables staged in the shared folder of the cluster.

A staged table is Parquet, so later jobs still prune columns and push filters
down, and it outlives the executors that wrote it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_unset: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own, per application, only where
    it is unset and all runs in one process, as in tests. On a cluster an unset folder is an error, as executors do not
    see each other's files."""
    root = spark.conf.get(CONF, None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"Set {CONF} to a folder that the driver and all executors share.")
    application = spark.sparkContext.applicationId
    if application not in _unset:
        _unset[application] = tempfile.mkdtemp(prefix="tabletools-")
    return _unset[application]


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path per call, so that no two runs share a file."""
    return f"{staging_root(spark).rstrip('/')}/tabletools/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the table once and go on from the written copy (cuts the lineage)."""
    path = staging_path(df.sparkSession, label)
    _staged.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Delete the tables that this application has staged, once the results that were built on them are written. Returns their number."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
