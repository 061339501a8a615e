from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabletools as tt
import tabletools.sources.files as files
import tabletools.sources.staging as staging
from tabletools.sources.jdbc import jdbc_options
from tabletools.sources.staging import stage, staging_root


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_missing_words_and_types(spark, tmp_path):
    path = write(tmp_path / "t.csv", "i,f,b,s,none,big,mixed\n1,1.5,True,x,NA,99999999999999999999,1\nNA,#N/A,,y,,1,a\n 3,-2e3,FALSE,null,NaN,2,\n4,inf,true,1d,None,3,2\n")
    df = tt.load_table(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "none": "double",
                               "big": "double", "mixed": "string"}
    assert [r.i for r in df.collect()] == [1, None, 3, 4] and [r.s for r in df.collect()] == ["x", "y", None, "1d"]
    assert [r.b for r in df.collect()] == [True, None, False, True]


def test_latin1_falls_back(spark, tmp_path):
    path = write(tmp_path / "l.csv", b"name,n\ncaf\xe9,1\n")
    assert tt.read_csv_table(spark, path).first().name == "café"
    path = write(tmp_path / "u.csv", "name,n\ncafé,1\n")
    assert tt.read_csv_table(spark, path).first().name == "café"


def test_lines_are_read_apart_unless_a_quote_stays_open(spark, tmp_path):
    path = write(tmp_path / "q.csv", 's,n\n"a ""b"" c",1\n"x, y",2\n')
    assert [tuple(r) for r in tt.load_table(spark, path).collect()] == [('a "b" c', 1), ("x, y", 2)]
    path = write(tmp_path / "o.csv", 's,n\n"one\ntwo",1\nthree,2\n')
    assert [tuple(r) for r in tt.load_table(spark, path).orderBy("n").collect()] == [("one\ntwo", 1), ("three", 2)]


def test_each_file_has_its_own_form(spark, tmp_path):
    write(tmp_path / "a.csv", "name,n\ncafé,1\n")
    write(tmp_path / "b.csv", b"name,n\ncaf\xe9,2\n")
    write(tmp_path / "c.csv", 'name,n\n"two\nlines é",3\n')
    write(tmp_path / "d.csv", "n,other\n4,x\n")
    write(tmp_path / "e.csv", "")
    table = tt.read_csv_table(spark, str(tmp_path))
    assert sorted((tuple(r) for r in table.select("n", "name", "other").collect())) == [
        ("1", "café", None), ("2", "café", None), ("3", "two\nlines é", None), ("4", None, "x")]
    forms = files._files_by_form(spark, str(tmp_path), None, None)
    assert [(e, w) for e, w, _ in forms] == [("UTF-8", False), ("ISO-8859-1", False), ("UTF-8", True), ("UTF-8", False)]


@pytest.mark.parametrize("text", [
    "a,a,b\n1,2,3\n", "a,,a,a.1,\n1,2,3,4,5\n", '"x ""y""","p,q"\n1,2\n', "\ufeffa,b\n1,2\n", "a,b\n1\n2,3\n", "\n\na,b\n1,2\n"])
def test_headers_and_short_records_as_pandas_reads_them(spark, tmp_path, text):
    path = write(tmp_path / "t.csv", text)
    expected = pd.read_csv(path, dtype=str)
    table = tt.read_csv_table(spark, path)
    assert table.columns == list(expected.columns)
    assert [tuple(r) for r in table.collect()] == [tuple(None if pd.isna(v) else v for v in r) for r in expected.to_numpy()]


def test_names_that_differ_in_case_are_told_apart(spark, tmp_path):
    table = tt.read_csv_table(spark, write(tmp_path / "t.csv", "ID,id\n1,2\n"))
    assert table.columns == ["ID", "id.1"] and tuple(table.first()) == ("1", "2")


def test_a_field_too_many_raises(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than the 2 fields"):
        tt.read_csv_table(spark, path).select("a").collect()
    with pytest.raises(pd.errors.ParserError):
        pd.read_csv(path)


def test_load_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tt.load_table(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(FileNotFoundError):
        tt.load_table(spark, str(tmp_path / "absent.parquet"))
    with pytest.raises(ValueError, match="Unsupported file extension '.txt'"):
        tt.load_table(spark, write(tmp_path / "t.txt", "x"))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' quo"ted, ', None), (2, "line\nbreak", 2.5)], "k int, s string, x double")
    path = str(tmp_path / "out.csv")
    for _ in range(2):      # writing again replaces
        tt.write_csv_table(df, path)
    back = tt.infer_types(tt.read_csv_table(spark, path)).orderBy("k")
    assert [tuple(r) for r in back.collect()] == [(1, ' quo"ted, ', None), (2, "line\nbreak", 2.5)]


def test_nan_becomes_null_on_load(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string").write.parquet(path)
    assert tt.load_table(spark, path).where("x IS NULL").count() == 1


def test_staging_uses_the_folder_of_the_session(spark):
    df = stage(spark.range(10), "numbers")
    assert df.count() == 10
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert df.inputFiles()[0].startswith("file:" + ("//" if df.inputFiles()[0].startswith("file:///") else "") + staging_root(spark))


def test_jdbc_options():
    url = tt.postgres_url("db", 5432, "sales")
    assert url == "jdbc:postgresql://db:5432/sales"
    assert jdbc_options(url, "SELECT 1 ; ", "u", "p") == {"url": url, "query": "SELECT 1", "user": "u", "password": "p",
                                                          "fetchsize": "10000", "loginTimeout": "10"}
    assert jdbc_options(url, "SELECT 1", fetchsize="5")["fetchsize"] == "5"
    sliced = jdbc_options(url, "SELECT * FROM t", partition_column="id", lower=0, upper=9, partitions=3)
    assert sliced["dbtable"] == "(SELECT * FROM t) t" and sliced["numPartitions"] == "3" and "query" not in sliced
    with pytest.raises(ValueError):
        jdbc_options(url, " ; ")
    with pytest.raises(ValueError):
        jdbc_options(url, "SELECT 1", partition_column="id")


def test_ask_sql_leaves_no_view(spark):
    df = spark.range(5)
    assert tt.ask_sql(spark, {"data": df}, "SELECT sum(id) AS s FROM {data}").first().s == 10
    assert not spark.catalog.listTables()


def test_whole_run(spark, tmp_path):
    data = [(i, float(i % 13) if i % 5 else None, "ab"[i % 2], f"2024-01-{i % 28 + 1:02d}") for i in range(120)]
    df = spark.createDataFrame(data, "id int, v double, g string, d string")
    tt.write_csv_table(df, str(tmp_path / "t.csv"))
    result = tt.analyse_file(spark, str(tmp_path / "t.csv"), target="g", task="classification", keys=["id"], depth=3)
    assert result.metrics.first().error is None
    assert list(result.chart_tables()) == ["Distribution of id", "id by g", "id vs v", "v Distribution by g", "id Over Time (d)"]
    result.save(str(tmp_path / "out"))
    assert staging.cleanup(spark) > 0 and staging.cleanup(spark) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "cleaned")).count() == 120
    assert spark.read.parquet(str(tmp_path / "out" / "analytics_numeric_summary")).count() == 2


def test_a_cluster_needs_a_named_folder(spark, monkeypatch):
    class Cluster:
        conf, sparkContext = spark.conf, type("C", (), {"master": "spark://host:7077"})()

    monkeypatch.setattr(staging, "CONF", "spark.tabletools.absent")
    with pytest.raises(ValueError, match="share"):
        staging_root(Cluster())


def test_cleanup_deletes_what_was_staged(spark):
    from pathlib import Path
    staging.cleanup(spark)
    table = stage(spark.range(10), "numbers")
    folder = Path(table.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert folder.exists() and staging.cleanup(spark) == 1 and not folder.exists()


def test_staging_without_a_named_folder(spark, monkeypatch):
    monkeypatch.setattr(staging, "CONF", "spark.tabletools.absent")
    first, second = (staging.staging_path(spark, "x") for _ in range(2))
    assert first != second and first.rsplit("/", 2)[0] == second.rsplit("/", 2)[0]
    assert not first.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert stage(spark.range(3), "numbers").count() == 3


def test_large_csv_files_are_bounded(spark, tmp_path):
    from catalog.sources import _large_files_csv
    rows = spark.range(0, 3000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("\n\"x\"")).alias("text"),
                                              F.lit("s").alias("source"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))

    def written():
        return len([f for f in Path(_large_files_csv(spark, str(tmp_path)).removeprefix("file:")).iterdir() if f.suffix == ".csv"])

    assert written() == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 6))
    try:
        assert 3 <= written() <= 4
        table = tt.read_csv_table(spark, _large_files_csv(spark, str(tmp_path)))
        assert sorted((int(r.doc_id), r.text) for r in table.collect()) == sorted((r.doc_id, r.text) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
