"""Readers against the standard library's."""

import csv
import random

import pytest

from orderly.sources import readers

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    spark.conf.set(SPLIT, "150")
    yield
    spark.conf.unset(SPLIT)


def cell(rng):
    return "".join(rng.choice(["a", "é", "b,", '"', '""', "\n", "\r\n", "\r", " ", "", "'", "\\", "\\n", "long text " * 3]) for _ in range(rng.randint(0, 9)))


def written(folder, name, rows, ends="\n", mark="", last=True):
    lines = [",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') or not c else c for c in row) for row in rows]
    path = folder / name
    path.write_bytes((mark + ends.join(lines) + (ends if last else "")).encode())
    return path


def read_plainly(path):
    """(record, last line, cells) by the standard library, which doesn't count blank lines as records."""
    with path.open(encoding="utf-8-sig", newline="") as handle:
        reader = csv.reader(handle)
        return [(k, at, row) for k, (at, row) in enumerate(((reader.line_num, row) for row in reader if row), 1)]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(3))
def test_records_over_lines_and_splits(spark, tmp_path, small_splits, ends, seed):
    rng = random.Random(seed)
    files = [written(tmp_path, f"f{k}.csv", [["id", "text"], *[[str(i), cell(rng)] for i in range(60)]], ends, "﻿" * (k == 0), k != 1) for k in range(3)]
    rows = readers.csv_records(spark, str(tmp_path)).collect()
    for path in files:
        own = sorted((r for r in rows if r.path.endswith(path.name)), key=lambda r: r.record)
        plain = read_plainly(path)
        assert [(r.record, r.last_line) for r in own] == [(k, at) for k, at, _ in plain]
        assert [next(csv.reader([r.text], strict=True)) if "\n" not in r.text and "\r" not in r.text else next(csv.reader(r.text.splitlines(keepends=True))) for r in own if "\r" not in r.text] == [row for r, (_, _, row) in zip(own, plain, strict=True) if "\r" not in r.text]
        begins = [1, *[r.last_line + 1 for r in own[:-1]]]
        assert [r.line for r in own] == begins
    texts = {r.id: r.text for r in readers.strict_csv(spark, str(files[0]), ["id", "text"], "id", "[0-9]+").collect()}
    assert texts == {row[0]: row[1] for _, _, row in read_plainly(files[0])[1:]}


def test_one_long_record_spans_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {k} "quoted", and more' for k in range(500))
    path = written(tmp_path, "f.csv", [["id", "text"], ["1", "x"], ["2", long], ["3", "\r\n\r\n"], ["4", "y"]])
    got = readers.strict_csv(spark, str(path), ["id", "text"], "id", "[0-9]").orderBy("record").collect()
    assert [(r.id, r.text) for r in got] == [("1", "x"), ("2", long), ("3", "\r\n\r\n"), ("4", "y")]
    assert [(r.line, r.last_line) for r in got] == [(2, 2), (3, 502), (503, 505), (506, 506)]


def test_blank_lines_are_lines_but_no_records(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes(b'\n\nid,text\n\r\n1,"a\n\nb"\n\n\r2,c\n')
    got = readers.strict_csv(spark, str(path), ["id", "text"], "id", "[0-9]").orderBy("record").collect()
    assert [(r.record, r.line, r.last_line, r.id, r.text) for r in got] == [(2, 5, 7, "1", "a\n\nb"), (3, 10, 10, "2", "c")]
    assert [(k, at) for k, at, _ in read_plainly(path)] == [(1, 3), (2, 7), (3, 10)]


def test_empty_cells_and_null_cells(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('id,text\n1,\n2,""\n3, x \n')
    got = readers.strict_csv(spark, str(path), ["id", "text"], "id", "[0-9]").orderBy("id").collect()
    assert [r.text for r in got] == [None, "", " x "]


@pytest.mark.parametrize(("text", "what"), [
    ('id,text\n1,"open\n2,x\n', "a quote is not closed"), ("id,txt\n1,x\n", "wrong header"), ("id,text\n1,x\n1,y\n", "repeated id"),
    ("id,text\nx1,y\n", "malformed id"), ('id,text\n"1\n",y\n', "malformed id"), ("id,text\n1,x,y\n", "malformed|incorrect"), ("id,text\n1\n", "malformed|incorrect"),
])
def test_faults_are_errors(spark, tmp_path, text, what):
    path = tmp_path / "f.csv"
    path.write_text(text)
    with pytest.raises(Exception, match=f"(?i){what}"):
        readers.strict_csv(spark, str(path), ["id", "text"], "id", "[0-9]").collect()


def test_an_empty_file_has_no_records(spark, tmp_path):
    (tmp_path / "f.csv").write_text("")
    assert readers.csv_records(spark, str(tmp_path)).collect() == []
