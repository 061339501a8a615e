import random

import pytest

import tabletools as tt
from tabletools.sources.records import ends_inside, records


def rows(table):
    return sorted([tuple(r) for r in table.collect()], key=str)


def both(spark, path, splits):
    """The same file by many tasks and by one."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        one = tt.read_csv_table(spark, path, multi_line=True)
        many = tt.read_csv_table(spark, path)
        tasks = records(spark, [path]).rdd.getNumPartitions()
        assert many.columns == one.columns
        return rows(many), rows(one), tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def field(rng):
    kind = rng.random()
    if kind < 0.3:
        return rng.choice(["", "x", "plain text", "with space ", "é🙂", "12"])
    if kind < 0.4:
        return rng.choice(['a "stray" quote', 'b"c', 'ends"'])            # unquoted, so quotes are text
    inner = "".join(rng.choice(["a", "b c", ",", "\n", "\n\n", '""', "é", '"",""', '""\n""']) for _ in range(rng.randrange(12)))
    return '"' + inner + '"'


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("splits", [64, 700])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_read_what_one_reads(spark, tmp_path, seed, splits, end):
    rng = random.Random(seed)
    records_ = [",".join([str(i), field(rng), field(rng)]) for i in range(150)]
    path = tmp_path / "t.csv"
    path.write_bytes(end.join(["id,s,t", *records_, "" if seed % 2 else '9999,"the\nlast",x']).encode())
    many, one, tasks = both(spark, str(path), splits)
    assert many == one and len(one) >= 150 and tasks > 3


def test_a_record_over_many_splits(spark, tmp_path):
    path = tmp_path / "t.csv"
    long = "\n".join(f"line {i}, and ""more""" for i in range(3000))
    path.write_text(f'id,s\n1,"{long}"\n2,short\n3,"{long}"\n')
    many, one, tasks = both(spark, str(path), 1000)
    assert many == one == [("1", long), ("2", "short"), ("3", long)] and tasks > 50


def test_header_over_lines_and_blank_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('\n\n"a\nb","c"\n\n1,"x\ny"\n\n2,z\n')
    many, one, _ = both(spark, str(path), 4)
    assert many == one == [("1", "x\ny"), ("2", "z")]


def test_latin1_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,s\n1,"caf\n'.encode() + b'\xe9"\n2,x\n')
    (tmp_path / "b.csv").write_text('id,s\n3,"d\n\ne"\n4,"f"\n')
    (tmp_path / "c.csv").write_text("id,s\n5,g\n")
    many, one, _ = both(spark, str(tmp_path), 5)
    assert many == one == [("1", "caf\né"), ("2", "x"), ("3", "d\n\ne"), ("4", "f"), ("5", "g")]


def test_a_quote_that_is_never_closed(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,s\n1,x\n2,"open\nto the end\n')
    many, _, _ = both(spark, str(path), 6)
    assert ("1", "x") in many and len(many) == 2


def slow_ends_inside(line, inside):
    state = "quoted" if inside else "start"
    for c in line:
        if state == "quoted":
            state = "closing" if c == '"' else state
        elif state == "closing":
            state = "quoted" if c == '"' else "start" if c == "," else "text"
        elif c == ",":
            state = "start"
        else:
            state = "quoted" if c == '"' and state == "start" else "text"
    return state == "quoted"


def test_state_behind_a_line():
    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choice('",a') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert ends_inside(line.encode(), inside) == slow_ends_inside(line, inside), (line, inside)
    assert not ends_inside(b'"' + b'""' * 200_000 + b'"', False)
