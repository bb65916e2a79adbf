import os

import pytest
from pyspark.sql import functions as F

from loggrove import schemas
from loggrove.sources.stored import StoredTable


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "filename string, entry string, value string")


@pytest.fixture
def table(tmp_path):
    return StoredTable(str(tmp_path / "t"), schemas._schema("filename STRING, entry STRING, value STRING"), ("filename",), 4)


def test_rows_of_a_key_are_replaced_and_others_stay(spark, table):
    assert rows_of(table.read(spark)) == []
    table.replace(frame(spark, [(f"f{k}", "e", "1") for k in range(20)] + [(None, "e", "1")]))
    table.replace(frame(spark, [("f3", "e", "2"), ("f3", "g", "2"), (None, "e", "2")]))
    want = [(f"f{k}", "e", "1") for k in range(20) if k != 3] + [("f3", "e", "2"), ("f3", "g", "2"), (None, "e", "2")]
    assert rows_of(table.read(spark)) == sorted(want, key=str)
    # a second time nothing changes; keys without rows lose theirs
    table.replace(frame(spark, [("f3", "e", "2"), ("f3", "g", "2"), (None, "e", "2")]))
    table.replace(frame(spark, []), frame(spark, [("f4", "", ""), ("none", "", "")]))
    assert rows_of(table.read(spark)) == sorted([r for r in want if r[0] != "f4"], key=str)
    assert rows_of(table.read(spark, frame(spark, [("f3", "", ""), (None, "", "")]))) == sorted([("f3", "e", "2"), ("f3", "g", "2"), (None, "e", "2")], key=str)


def test_a_broken_run_leaves_the_old_rows(spark, table):
    table.replace(frame(spark, [("a", "e", "1"), ("b", "e", "1")]))
    broken = frame(spark, [("a", "e", "2")]).withColumn("value", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.replace(broken)
    assert rows_of(table.read(spark)) == [("a", "e", "1"), ("b", "e", "1")]
    table.replace(frame(spark, [("a", "e", "2")]))
    assert rows_of(table.read(spark)) == [("a", "e", "2"), ("b", "e", "1")]
    # what a run left that died while it wrote, and states that no reader needs any more, go
    os.makedirs(f"{table.path}/data/run=00000001-dead/bucket=0")
    table.replace(frame(spark, [("a", "e", "3"), ("b", "e", "3")]))
    assert table.clean(spark, keep=1) == 3 and rows_of(table.read(spark)) == [("a", "e", "3"), ("b", "e", "3")]


def test_a_reader_keeps_its_rows_while_others_are_written(spark, table):
    table.replace(frame(spark, [("a", "e", "1")]))
    before = table.read(spark)
    table.replace(frame(spark, [("a", "e", "2")]))
    assert rows_of(before) == [("a", "e", "1")] and rows_of(table.read(spark)) == [("a", "e", "2")]


def test_ten_thousand_files_make_few_folders_and_one_of_them_rewrites_one_bucket(spark, table):
    many = spark.range(10_000).select(F.concat(F.lit("f"), F.col("id")).alias("filename"), F.lit("e").alias("entry"), F.col("id").cast("string").alias("value"))
    table.replace(many)
    folders = lambda: {os.path.join(d, x) for d, names, _ in os.walk(f"{table.path}/data") for x in names if x.startswith("bucket=")}
    before = folders()
    assert len(before) == 4 and table.read(spark).count() == 10_000
    table.replace(frame(spark, [("f77", "e", "new")]))
    assert len(folders() - before) == 1 and table.read(spark).count() == 10_000
    assert [r.value for r in table.read(spark).where("filename = 'f77'").collect()] == ["new"]


def test_keys_that_are_not_to_be_replaced_and_other_bucket_counts_are_errors(spark, table):
    with pytest.raises(Exception, match="not to be replaced"):
        table.replace(frame(spark, [(f"f{k}", "e", "1") for k in range(20)]), frame(spark, [("f1", "", "")]))
    table.replace(frame(spark, [("a", "e", "1")]))
    with pytest.raises(ValueError, match="buckets"):
        StoredTable(table.path, table.schema, table.keys, 8).read(spark)


def test_several_columns_make_a_key_and_null_is_one(spark, tmp_path):
    t = StoredTable(str(tmp_path / "s"), schemas._schema("a STRING, b STRING, n BIGINT"), ("a", "b"), 3)
    of = lambda *rows: spark.createDataFrame(list(rows), "a string, b string, n long")
    for _ in range(2):
        t.replace(of(("x", None, 1), (None, "x", 2), ("x", "y", 3)))
    t.replace(of((None, "x", 5)))
    assert rows_of(t.read(spark)) == sorted([("x", None, 1), (None, "x", 5), ("x", "y", 3)], key=str)
