"""Byte-offset tails and range scans, reader by reader and through Spark."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from orderly.sources import files


def tail_reader(folder, chunk):
    return files.TailReader({"path": str(folder), "suffix": ".log", "chunkBytes": str(chunk)})


def lines_of(reader, start, end):
    return [(r["path"].rsplit("/", 1)[-1], r["at"], r["line"]) for span in reader.partitions(start, end) for batch in reader.read(span) for r in batch.to_pylist()]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_every_line_comes_once_however_files_are_cut(tmp_path, chunk, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 5)
    rng, expected = random.Random(chunk), []
    for name in ("a.log", "b.log"):
        data = b""
        for _ in range(40):
            line = "".join(rng.choice("xyé \t") for _ in range(rng.randint(0, 20)))
            expected.append((name, len(data), line))
            data += line.encode() + rng.choice([b"\n", b"\r\n"])
        (tmp_path / name).write_bytes(data + b"torn")
    (tmp_path / "_hidden.log").write_text("no\n")
    (tmp_path / "other.txt").write_text("no\n")
    reader = tail_reader(tmp_path, chunk)
    end = reader.latestOffset()
    assert sorted(lines_of(reader, {}, end)) == sorted(expected)
    assert lines_of(reader, end, end) == []


def test_a_torn_line_waits_for_its_end(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntw")
    reader = tail_reader(tmp_path, 3)
    first = reader.latestOffset()
    assert lines_of(reader, {}, first) == [("a.log", 0, "one")]
    with log.open("ab") as f:
        f.write(b"o\nthree\n")
    second = reader.latestOffset()
    assert lines_of(reader, first, second) == [("a.log", 4, "two"), ("a.log", 8, "three")]
    log.write_bytes(b"x\n")
    with pytest.raises(ValueError, match="shrunk"):
        reader.partitions(second, reader.latestOffset())


def test_no_files_and_no_line_ends(tmp_path):
    reader = tail_reader(tmp_path / "none", 8)
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []
    (tmp_path / "a.log").write_bytes(b"no end yet")
    reader = tail_reader(tmp_path, 8)
    assert set(reader.latestOffset().values()) == {0} and lines_of(reader, {}, reader.latestOffset()) == []


def test_a_tailing_stream_goes_on_where_it_was(spark, tmp_path):
    def run():
        stream = files.parsed_json(files.tail_lines(spark, str(tmp_path / "in"), ".log", 16), "v long, w string")
        stream.writeStream.format("parquet").trigger(availableNow=True).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
        return sorted((r.v, r.w) for r in spark.read.schema("v long, w string").parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "a.log"
    log.write_text('{"v": 1, "w": "a"}\nno json\n{"v": "x"}\n\n{"v": 2, "w"')
    assert run() == [(1, "a")]
    with log.open("a") as f:
        f.write(': "é"}\n')
    (tmp_path / "in" / "b.log").write_text('{"v": 3}\n')
    assert run() == [(1, "a"), (2, "é"), (3, None)]
    assert run() == [(1, "a"), (2, "é"), (3, None)]


def range_reader(folder, chunk, most, *filters):
    reader = files.RangeReader({"path": str(folder), "suffix": ".bin", "chunkBytes": str(chunk), "partitionBytes": str(most)})
    return reader, list(reader.pushFilters(list(filters)))


def test_only_the_bytes_asked_for_are_read(tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.bin").write_bytes(bytes(range(100)))
    reader, left = range_reader(tmp_path, 10, 30, GreaterThanOrEqual(("start",), 35), LessThan(("start",), 75), EqualTo(("path",), f"{tmp_path}/1.bin"), IsNotNull(("path",)))
    spans = reader.partitions()
    assert [(s.path[-5:], s.start, s.end) for s in spans] == [("1.bin", 40, 70), ("1.bin", 70, 80)] and all(s.end - s.start <= 30 for s in spans)
    rows = [r for s in spans for b in reader.read(s) for r in b.to_pylist()]
    assert [(r["start"], r["length"], r["content"]) for r in rows] == [(k, 10, bytes(range(k, k + 10))) for k in (40, 50, 60, 70)]
    assert len(left) == 1 and isinstance(left[0], IsNotNull)
    whole, _ = range_reader(tmp_path, 33, 1000)
    assert sum(s.end - s.start for s in whole.partitions()) == 300
    none, _ = range_reader(tmp_path, 10, 30, In(("path",), ("x",)), EqualTo(("path",), f"{tmp_path}/1.bin"))
    assert [r for s in none.partitions() for b in none.read(s) for r in b.to_pylist()] == []


def test_ranges_through_spark(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 4)
    (tmp_path / "empty.bin").write_bytes(b"")
    df = files.byte_ranges(spark, str(tmp_path), 100, ".bin", 200)
    rows = df.where((F.col("start") > 100) & (F.col("start") <= 900) & (F.length("content") == 100)).orderBy("start").collect()
    assert [r.start for r in rows] == [200, 300, 400, 500, 600, 700, 800, 900] and bytes(rows[0].content) == (bytes(range(256)) * 4)[200:300]
    last = df.where("start = 1000").collect()
    assert [(r.length, bytes(r.content)) for r in last] == [(24, bytes(range(232, 256)))]
    assert df.where("start < 0").collect() == []


def test_headers_from_44_bytes(spark, tmp_path):
    data = b"\0" * 400
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 436) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44_100, 176_400, 4, 16) + b"data" + struct.pack("<I", len(data)) + data)
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "other.wav").write_bytes(b"x" * 100)
    assert [(r.channels, r.rate, r.bits, r.frames) for r in files.wav_headers(spark, str(tmp_path)).collect()] == [(2, 44_100, 16, 100)]
