import random

import pytest
from pyspark.sql import functions as F

import tabletools as tt
import tabletools.functions.quantiles as quantiles

SCHEMA = "id int, v double, w long, s string, t timestamp"


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([None, rng.gauss(0, 1), 500.0]), rng.choice([None, 1, 2, 3, 900]), rng.choice("abc"), None) for i in range(n)]


def feed(spark, folder, data):
    df = spark.createDataFrame(data, SCHEMA).withColumn("t", F.timestamp_seconds(F.col("id") + 1000)).coalesce(1)
    df.write.mode("append").parquet(str(folder / "in"))
    return df


def run(spark, folder, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    tt.append_distinct_stream(stream, str(folder / "out"), str(folder / "check"), **options).awaitTermination(180)
    return schema


def found(table):
    return sorted([tuple(r) for r in table.collect()], key=str)


def rules(model):
    return model.rows, model.missing, model.dropped, model.medians, model.modes, model.fences, model.outliers, model.formats


def test_three_batches_equal_their_union(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantiles, "LISTED_ROWS", 20)
    data = rows(300, 1)
    for part in (data[:150], data[100:220] + data[:40], data[200:] + data[290:]):
        feed(spark, tmp_path, part)
    schema = run(spark, tmp_path)
    union = spark.createDataFrame(data, SCHEMA).withColumn("t", F.timestamp_seconds(F.col("id") + 1000))
    assert found(tt.stream_rows(spark, str(tmp_path / "out"), schema)) == found(union)
    mine, whole = tt.refit_cleaning(spark, str(tmp_path / "out"), schema), tt.fit_cleaning(union)
    assert rules(mine) == rules(whole)
    assert found(mine.cleaned()) == found(whole.cleaned())


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    data = rows(120, 2)
    feed(spark, tmp_path, data[:50])
    run(spark, tmp_path)
    feed(spark, tmp_path, data[40:90])
    feed(spark, tmp_path, data[:10] + data[80:])
    schema = run(spark, tmp_path)
    assert run(spark, tmp_path) == schema                  # nothing new
    out = tt.stream_rows(spark, str(tmp_path / "out"), schema)
    assert sorted(r.id for r in out.collect()) == list(range(120))


def test_a_batch_that_fails_half_way_is_written_again(spark, tmp_path, monkeypatch):
    import tabletools.streaming.refit_stream as refit
    data = rows(60, 3)
    feed(spark, tmp_path, data[:30])
    real = refit.digit_cells

    def crash(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(refit, "digit_cells", crash)
    with pytest.raises(Exception, match="crash"):
        run(spark, tmp_path)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert tt.stream_rows(spark, str(tmp_path / "out"), schema).count() == 0          # a batch is seen whole or not
    monkeypatch.setattr(refit, "digit_cells", real)
    feed(spark, tmp_path, data[20:])
    run(spark, tmp_path)
    assert sorted(r.id for r in tt.stream_rows(spark, str(tmp_path / "out"), schema).collect()) == list(range(60))


def test_a_watermark_forgets(spark, tmp_path):
    data = rows(100, 4)
    for part in (data[:20], data[10:100], data[:5]):
        feed(spark, tmp_path, part)
    schema = run(spark, tmp_path, event_time="t", delay="10 seconds")
    out = tt.stream_rows(spark, str(tmp_path / "out"), schema)
    assert sorted(r.id for r in out.collect()) == list(range(100))                     # late rows go, near repeats too


def test_nothing_has_come(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    assert tt.stream_rows(spark, str(tmp_path / "none"), schema).count() == 0
    assert tt.refit_cleaning(spark, str(tmp_path / "none"), schema).fences == {}


def test_an_arrival_is_one_batch_whatever_its_files(spark, tmp_path, monkeypatch):
    import catalog.cleaning as catalog
    places = []

    def place(_, label):
        places.append(label)
        return str(tmp_path / label)

    monkeypatch.setattr(catalog, "staging_path", place)
    monkeypatch.setattr(catalog, "dirty", lambda s, d: s.range(0, 600, 1, 5).select(F.col("id").alias("event_id"), (F.col("id") % 50 * 1.5).alias("value")))
    assert catalog._refitted(spark, "").count() == 600
    files = [f for f in (tmp_path / "arrivals").iterdir() if f.suffix == ".parquet"]
    batches = [b for b in (tmp_path / "refit" / "rows").iterdir() if b.is_dir()]
    assert len(files) == 15 and len(batches) == 3 and len(places) == 3
