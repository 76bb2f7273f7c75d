"""Archives of arrays against numpy's own, and what of them is read."""

import io

import numpy as np
import pytest
from pyspark.sql import types as T

from orderly.sources import archives

ARRAYS = {"t": np.arange(1000) / 7, "n": np.arange(1000, dtype=np.int32) - 5, "flag": np.arange(1000) % 3 == 0, "vec": np.arange(4000, dtype=np.float32).reshape(1000, 4), "name": np.array([f"é{k}" for k in range(1000)])}
SCHEMA = {"t": T.DoubleType(), "n": T.IntegerType(), "flag": T.BooleanType(), "vec": T.ArrayType(T.FloatType()), "name": T.StringType()}


class Counted(io.BytesIO):
    """A file that counts the bytes it gives."""

    given = 0

    def read(self, n=-1):
        data = super().read(n)
        self.given += len(data)
        return data


def reader(folder, names, rows=300):
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(n, SCHEMA.get(n, T.LongType())) for n in names]])
    return archives.ArchiveReader({"path": str(folder), "rowsPerPartition": str(rows)}, schema)


def rows_of(source):
    return [r for p in source.partitions() for b in source.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_arrays_that_numpy_wrote(tmp_path, save):
    save(tmp_path / "a.npz", **ARRAYS)
    source = reader(tmp_path, list(ARRAYS))
    assert len(source.partitions()) == (4 if save is np.savez else 1)
    rows = rows_of(source)
    assert [r["row"] for r in rows] == list(range(1000))
    for name, values in ARRAYS.items():
        assert [r[name] for r in rows] == values.tolist()


@pytest.mark.parametrize("compress", [True, False])
def test_numpy_reads_what_the_sink_writes(compress):
    data = archives.packed(ARRAYS, compress)
    back = np.load(io.BytesIO(data))
    assert set(back) == set(ARRAYS) and all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in ARRAYS.items())
    assert data == archives.packed(ARRAYS, compress)


def test_other_arrays_are_not_read(tmp_path):
    """Of a stored archive only the directory, headers and the rows asked for are read."""
    data = archives.packed({"big": np.zeros(500_000), "t": np.arange(2_000.0)}, False)
    f = Counted(data)
    member = archives.directory(f, len(data))["t"]
    stream = archives.Stream(f, member)
    assert archives.described(stream) == (np.dtype("<f8"), (2_000,))
    stream.skip(1_000 * 8)
    assert np.frombuffer(stream.read(16), "<f8").tolist() == [1000.0, 1001.0]
    assert f.given < 80_000 < len(data)


def test_compressed_members_in_small_reads(monkeypatch):
    monkeypatch.setattr(archives, "READ", 97)
    data = archives.packed(ARRAYS, True)
    f = io.BytesIO(data)
    stream = archives.Stream(f, archives.directory(f, len(data))["t"])
    archives.described(stream)
    stream.skip(8 * 123)
    assert np.frombuffer(stream.read(8 * 500), "<f8").tolist() == ARRAYS["t"][123:623].tolist()
    assert len(stream.read(10**9)) == 8 * (1000 - 623) and stream.read(8) == b""


def test_faults(tmp_path):
    np.savez(tmp_path / "a.npz", t=np.zeros(3), n=np.zeros(4, np.int32))
    with pytest.raises(ValueError, match="no array x"):
        reader(tmp_path, ["x"]).partitions()
    with pytest.raises(ValueError, match="different lengths"):
        reader(tmp_path, ["t", "n"]).partitions()
    (tmp_path / "b.npz").write_bytes(b"no archive" * 10)
    with pytest.raises(ValueError, match="no end record"):
        reader(tmp_path, ["t"]).partitions()
    np.savez(tmp_path / "b.npz", t=np.array([{}], object))
    with pytest.raises(ValueError, match="objects"):
        reader(tmp_path, ["t"]).partitions()


def test_nothing_there(tmp_path):
    assert rows_of(reader(tmp_path / "none", ["t"])) == []
    np.savez(tmp_path / "a.npz", t=np.zeros(0))
    assert rows_of(reader(tmp_path, ["t"])) == []


def test_round_trip_through_spark(spark, tmp_path):
    rows = [(k % 3, k // 3, float(k) if k % 5 else None, [k, k + 1], f"w{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "key long, at long, v double, pair array<long>, word string")
    for _ in range(2):  # written again, files are replaced
        archives.write_archives(df, "key", "at", ["v", "pair", "word"], str(tmp_path / "out"), rows_a_file=8)
    assert len(list((tmp_path / "out").iterdir())) == 9
    got = archives.read_archives(spark, str(tmp_path / "out"), "word string, pair array<long>, v double", rows_per_partition=3).collect()
    assert sorted((r.word, list(r.pair), r.v if r.v == r.v else None) for r in got) == sorted((w, p, v) for _, _, v, p, w in rows)
    first = sorted((r.row, r.word) for r in got if r.path.endswith("/1-00001.npz"))
    assert first == [(k, f"w{3 * (8 + k) + 1}") for k in range(8)]
