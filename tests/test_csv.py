"""CSV cells against the standard library's reader, and in any number of splits; counts and sources."""

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillscope.sources import csvtext, tables

TEXTS = [
    "", None, " lead ", "trail \t", 'q"q', "a\nb", "a\rb", "x\r", "x\r\n", ",c,", "\\N", '"', '""', "plain", "\\", 'a\\"b', "#x", "\n", "\n\n\n", " ", "é\n中文,\"\U0001f600",
    "long " * 200 + "\n" + 'x"y' * 100, "\r", "null",
]


@given(st.lists(st.text(alphabet='a,"\n\r é', max_size=8), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_cells_equal_the_standard_reader(row):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerow(row)
    assert csvtext.cells(out.getvalue()[:-1]) == row


def test_cells_without_quotes():
    assert csvtext.cells("a,,c\r") == ["a", None, "c"] and csvtext.cells('"",') == ["", None] and csvtext.cells('"open') == ["open"]


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    yield lambda n: [spark.conf.set(k, str(n)) for k in keys]
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [23, 64, 300, 1 << 20])
def test_round_trip_in_splits(spark, tmp_path, small_splits, size):
    rows = [(i, t, i % 2) for i, t in enumerate(TEXTS)] + [(None, "n", None), (99, "last", 1)]
    df = spark.createDataFrame(rows, tables.TEXT_SCHEMA)
    tables.write_csv(df.repartition(2), f"{tmp_path}/two.csv")
    tables.write_csv(df.coalesce(1), f"{tmp_path}/one.csv")
    small_splits(size)
    for path in ("two.csv", "one.csv"):
        got = tables.read_text_csv(spark, f"{tmp_path}/{path}")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    if size == 64:  # one file is read by many tasks
        assert got.rdd.getNumPartitions() > 20


def test_foreign_file(spark, tmp_path, small_splits):
    text = 'id,text,label\r\n1,"a\r\nb",0\r\n\r\n2, x ,1\r\nthree,"",\r\n4,"never closed\r\nend'
    (tmp_path / "f.csv").write_bytes(text.encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_bytes(b"id,text,label\n")
    want = [(1, "a\r\nb", 0), (2, " x ", 1), (None, "", None), (4, "never closed\r\nend", None)]
    for size in (5, 1 << 20):
        small_splits(size)
        assert sorted(map(tuple, tables.read_text_csv(spark, str(tmp_path / "f.csv")).collect()), key=repr) == sorted(want, key=repr)
        assert tables.read_text_csv(spark, str(tmp_path / "empty.csv")).count() == tables.read_text_csv(spark, str(tmp_path / "head.csv")).count() == 0


def test_rows_of_a_path_or_a_frame(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", 0), (2, None, 1)], tables.TEXT_SCHEMA)
    tables.write_csv(df, f"{tmp_path}/x.csv")
    df.write.parquet(f"{tmp_path}/x")
    want = sorted(map(tuple, df.collect()))
    for source in (df, f"{tmp_path}/x.csv", f"{tmp_path}/x"):
        assert sorted(map(tuple, tables.rows_of(spark, source).collect())) == want


def test_counts_of_a_write(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i % 3 else "test", i % 2) for i in range(100)], "id long, split string, label int").repartition(5)
    got = tables.write_counted(df, lambda x: tables.write_partitioned(x, f"{tmp_path}/p", "split", "label"), "split", "label", values={"split": ["train", "test"], "label": [0, 1]})
    back = {(r["split"], r["label"]): r["count"] for r in spark.read.parquet(f"{tmp_path}/p").groupBy("split", "label").count().collect()}
    assert {(r["split"], r["label"]): r["n"] for r in got} == back
    assert tables.write_counted(df, lambda x: tables.write_csv(x, f"{tmp_path}/c")) == [{"n": 100}]
