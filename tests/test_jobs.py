"""How many Spark jobs an operator starts: each is a pass over its columns, and a wait."""

import uuid

import pytest
from pyspark.sql import functions as F

import tabletools as tt


@pytest.fixture
def jobs(spark):
    def count(work) -> int:
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "counted")
        try:
            work()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    return count


def test_boxes_of_small_groups(spark, jobs):
    df = spark.range(5000).select((F.col("id") % 40).cast("string").alias("g"), F.rand(3).alias("v"))
    assert jobs(lambda: tt.box_data(df, "g", "v").collect()) <= 13


def test_correlations_with_gaps_take_one_pass(spark, jobs):
    df = spark.range(3000).select(*[F.when(F.rand(i) > 0.1, F.rand(i + 50)).alias(f"c{i}") for i in range(12)])
    df = tt.stage(df, "gapped")
    assert jobs(lambda: tt.correlation_matrix(df).collect()) <= 5


def test_date_formats_of_many_columns_take_one_pass(spark, jobs):
    from tabletools import constants as K
    from tabletools.operators.cleaning import _date_formats
    forms = ["yyyy-MM-dd", "yyyy/M/d", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd'T'HH:mm"]
    when = F.timestamp_seconds(F.col("id") * 86_400 + 60)
    df = spark.range(300).select(*[F.date_format(when, f).alias(f"c{i}") for i, f in enumerate(forms)],
                                 F.when(F.col("id") % 4 > 0, F.date_format(when, "yyyy-MM-dd")).otherwise("2024-99-99").alias("bad"),
                                 F.when(F.col("id") % 9 > 0, F.date_format(when, "yyyy-MM-dd")).otherwise("2024-01-01 10:00").alias("mixed"))
    df = tt.stage(df, "dates")
    chosen = {}
    assert jobs(lambda: chosen.update(_date_formats(df, dict.fromkeys(df.columns, 1.0)))) <= 2
    names = list(K.DATE_FORMATS)
    assert chosen == {"c0": names[0], "c1": names[1], "c2": "yyyy-M-d H:m:s[.SSSSSSSSS]", "c3": "yyyy/M/d'T'H:m", "mixed": names[0]}
