"""Splitting against a sequential writer, and the bytes of the written files."""

import random

import pytest
from pyspark.sql import functions as F

from mailsieve.operators.rollover import assign_parts
from mailsieve.sources.csv_files import read_csv, write_csv, write_rolled_csv
from mailsieve.sources.session import work_path


def next_fit(sizes, cap, header):
    part, filled, out = 1, header, []
    for size in sizes:
        if cap > 0 and filled + size > cap:
            part, filled = part + 1, header
        filled += size
        out.append(part)
    return out


# rows, smallest, largest line, cap, header, block (None: everything in one block)
SHAPES = [
    (300, 2, 40, 200, 20, None),
    (300, 2, 40, 200, 20, 600),
    (200, 2, 400, 100, 20, 1),
    (60, 5, 9, 8, 20, 1),
    (40, 100, 200, 60, 4, 1),
    (40, 5, 6, 10**6, 4, 1),
    (40, 5, 6, 0, 4, None),
]


@pytest.mark.parametrize("n,low,high,cap,header,block", SHAPES)
def test_parts_equal_a_single_writer(spark, n, low, high, cap, header, block):
    rng = random.Random(n + cap)
    sizes = [rng.randint(low, high) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint").repartition(3)
    got = [r.part for r in assign_parts(df, ["id"], "size", cap, header, block).orderBy("id").collect()]
    assert got == next_fit(sizes, cap, header)


def test_documented_example(spark):
    df = spark.createDataFrame([(i, 6) for i in range(3)], "id bigint, size bigint")
    assert [r.part for r in assign_parts(df, ["id"], "size", 16, 4).orderBy("id").collect()] == [1, 1, 2]


def test_no_rows(spark):
    df = spark.createDataFrame([], "id bigint, size bigint")
    assert assign_parts(df, ["id"], "size", 100, 4).collect() == []


ROWS = [(i, f'v{i}, "q"', f"two\r\nlines {i}  ") for i in range(50)]


def lines_of(spark, path, name):
    return [r.value for r in spark.read.text(f"{path}/{name}").collect()]


def test_rolled_files(spark):
    df = spark.createDataFrame(ROWS, "id int, a string, b string").repartition(4)
    path = work_path(spark, "rolled")
    stats = write_rolled_csv(df, path, "x", ("a", "b"), "id", [F.col("id").desc()], 300).orderBy("part").collect()
    expected = [f'"v{i}, ""q""",two lines {i}' for i in reversed(range(50))]
    parts = next_fit([len(line) + 1 for line in expected], 300, 4)
    assert [s.file for s in stats] == ["x.csv"] + [f"x_part{p:03d}.csv" for p in range(2, parts[-1] + 1)]
    for s in stats:
        want = ["a,b"] + [line for line, p in zip(expected, parts) if p == s.part]
        assert lines_of(spark, path, s.file) == want
        assert (s.rows, s.bytes) == (len(want) - 1, sum(len(line) + 1 for line in want))
        assert s.bytes <= 300


def test_first_file_may_be_a_header_only(spark):
    df = spark.createDataFrame([(1, "x" * 50)], "id int, a string")
    path = work_path(spark, "rolled")
    stats = write_rolled_csv(df, path, "x", ("a",), "id", ["id"], 20).orderBy("part").collect()
    assert [(s.part, s.rows, s.bytes) for s in stats] == [(1, 0, 2), (2, 1, 53)]
    assert lines_of(spark, path, "x.csv") == ["a"]
    assert lines_of(spark, path, "x_part002.csv") == ["a", "x" * 50]


def test_csv_round_trip_and_bytes(spark):
    df = spark.createDataFrame([('a "b"', "x,y"), ("", None), (" p\n q ", "#c")], "a string, b string")
    path = work_path(spark, "csv")
    write_csv(df.coalesce(1), path)
    text = [r.value for r in spark.read.text(path).collect()]
    assert text == ["a,b", '"a ""b""","x,y"', ",", "p q,#c"]
    assert [tuple(r) for r in read_csv(spark, path, ["a", "b"]).collect()] == [('a "b"', "x,y"), ("", ""), ("p q", "#c")]
