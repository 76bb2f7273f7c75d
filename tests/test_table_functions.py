"""Table functions of pipe tables, from SQL."""

import pytest
from pyspark.sql import functions as F

from orderly.functions import tables

TEXT = "intro\n| name | size |\n| --- | ---: |\n| a | 1 |\n|b|\n| c | 3 | more |\nrest | x |\n| d | 4 |\n\n| other |\n|---|\n| e |\n| name | size |\n|:-:|---|\n| f | 6 |"


def test_rows_under_the_header_asked_for():
    assert list(tables.parsed(TEXT, ["name", "size"])) == [(3, "a", "1"), (4, "b", None), (5, "c", "3"), (14, "f", "6")]
    assert list(tables.parsed(TEXT, ["other"]))[0] == (11, "e") and list(tables.parsed(None, ["x"])) == [] and list(tables.parsed("| x |", ["x"])) == []


def test_lateral_and_partition_by(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "no table"), (4, "| name | size |\n|-|-|\n| z | 9 |")], "id long, text string")
    one = spark.sql("SELECT d.id, p.* FROM {d} d, LATERAL pipe_rows(d.text, '| name | size |') p", d=df)
    expected = [(1, 3, "a", "1"), (1, 4, "b", None), (1, 5, "c", "3"), (1, 14, "f", "6"), (4, 2, "z", "9")]
    assert one.columns == ["id", "line", "name", "size"] and sorted(map(tuple, one.collect())) == expected
    lines = df.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    two = spark.sql("SELECT * FROM pipe_lines(TABLE(SELECT id, line, text FROM {l}) PARTITION BY id ORDER BY (line), 'name|size')", l=lines)
    assert sorted(map(tuple, two.collect())) == expected


@pytest.mark.parametrize("header", ["'a|a'", "'a||b'", "d.text", "NULL"])
def test_headers_must_be_constant_and_distinct(spark, header):
    tables.register(spark)
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(Exception, match="header"):
        spark.sql(f"SELECT p.* FROM {{d}} d, LATERAL pipe_rows(d.text, {header}) p", d=df).collect()
