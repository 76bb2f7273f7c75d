"""Archives of arrays (.npz: a zip of .npy members, one a column): a scan that reads the directory of each archive and no array that isn't asked for, and a
sink that writes one archive for each stretch of a group."""

from __future__ import annotations

import ast
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

from orderly.session import materialize
from orderly.sources.files import listed, place

# Fixed values of the zip and array formats: signatures, sizes of headers, methods.
END, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, CENTRAL_SIZE, LOCAL_SIZE, LONGEST_COMMENT = 22, 46, 30, 65_535
STORED, DEFLATED = 0, 8
MAGIC = b"\x93NUMPY"
READ = 1 << 20
ROWS = 1 << 16
# Folders of more files than FEW: small files are not opened when a scan is planned, and are read in bundles of so many bytes and files.
FEW, SMALL, BUNDLE_BYTES, BUNDLE_FILES = 1_000, 1 << 20, 16 << 20, 1_000


@dataclass
class Member:
    """An array in an archive: how its bytes are kept, from where on, and how many."""

    name: str
    method: int
    header: int
    packed: int
    size: int


def directory(f, size: int) -> dict[str, Member]:
    """The members of an archive by name, from the records at its end. Only these are read."""
    tail = min(size, END_SIZE + LONGEST_COMMENT)
    f.seek(size - tail)
    data = f.read(tail)
    at = data.rfind(END)
    if at < 0:
        raise ValueError("not an archive: no end record")
    count, length, begin = struct.unpack_from("<HII", data, at + 10)
    if count == 0xFFFF or begin == 0xFFFFFFFF:
        raise ValueError("archives of more than 4 GB or 65,534 members are not read")
    f.seek(begin)
    data, at, found = f.read(length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("not an archive: a broken directory")
        method, packed, whole = (*struct.unpack_from("<H", data, at + 10), *struct.unpack_from("<II", data, at + 20))
        name_size, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + name_size].decode()
        found[name.removesuffix(".npy")] = Member(name.removesuffix(".npy"), method, header, packed, whole)
        at += CENTRAL_SIZE + name_size + extra + comment
    return found


class Stream:
    """The bytes of a member, in order and with skips; skips in stored members are seeks."""

    def __init__(self, f, member: Member):
        f.seek(member.header)
        head = f.read(LOCAL_SIZE)
        if head[:4] != LOCAL or member.method not in (STORED, DEFLATED):
            raise ValueError(f"{member.name} can't be read: no header, or compressed in another way")
        name, extra = struct.unpack_from("<HH", head, 26)
        self.f, self.at, self.left = f, member.header + LOCAL_SIZE + name + extra, member.packed
        self.inflate, self.rest = (zlib.decompressobj(-15) if member.method == DEFLATED else None), b""

    def read(self, n: int) -> bytes:
        parts = [self.rest[:n]]
        self.rest, n = self.rest[n:], n - len(parts[0])
        while n > 0 and (self.left > 0 or self.inflate and self.inflate.unconsumed_tail):
            if self.inflate and self.inflate.unconsumed_tail:
                data = self.inflate.unconsumed_tail
            else:
                self.f.seek(self.at)
                data = self.f.read(min(self.left, READ if self.inflate else n))
                self.at, self.left = self.at + len(data), self.left - len(data)
            data = self.inflate.decompress(data, READ) if self.inflate else data
            parts.append(data[:n])
            self.rest, n = data[n:], n - len(data[:n])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if self.inflate is None:
            n -= len(self.rest)
            self.rest = b""
            self.at, self.left = self.at + n, self.left - n
        else:
            while n > 0:
                n -= len(self.read(min(n, READ)))


def described(stream: Stream) -> tuple[np.dtype, tuple[int, ...]]:
    """Type and shape of an array, from its own header; the stream stands at the first value then."""
    start = stream.read(8)
    if start[:6] != MAGIC:
        raise ValueError("not an array")
    wide = start[6] > 1
    (length,) = struct.unpack("<I" if wide else "<H", stream.read(4 if wide else 2))
    fields = ast.literal_eval(stream.read(length).decode("latin1"))
    kind, shape = np.dtype(fields["descr"]), tuple(fields["shape"])
    if kind.hasobject or fields["fortran_order"] and len(shape) > 1:
        raise ValueError("arrays of objects or in column order are not read")
    return kind, shape


@dataclass
class Rows:
    """A range of an archive's rows, or with end=None all of them."""

    path: str
    size: int
    start: int
    end: int | None


@dataclass
class Bundle(InputPartition):
    parts: list[Rows]


class ArchiveReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.suffix = options["path"], options.get("suffix", ".npz")
        self.most = int(options.get("rowsPerPartition", 1_000_000))
        self.fields = [f for f in schema.fields if f.name not in ("path", "row")]
        self.schema = schema

    def opened(self, f, size: int) -> tuple[list[Stream], list[np.dtype], list[tuple[int, ...]], bool]:
        there = directory(f, size)
        missing = [x.name for x in self.fields if x.name not in there]
        if missing:
            raise ValueError(f"no array {missing[0]}")
        members = [there[x.name] for x in self.fields]
        streams = [Stream(f, m) for m in members]
        found = [described(s) for s in streams]
        if len({shape[0] for _, shape in found}) > 1:
            raise ValueError("arrays of different lengths")
        return streams, [k for k, _ in found], [s for _, s in found], all(m.method == STORED for m in members)

    def ranges(self, path: str, size: int) -> list[Rows]:
        """Stored arrays are cut into ranges of rows; an archive with a compressed one that is asked for is read as a whole."""
        files, _ = place(self.path)
        with files.open_input_file(path) as f:
            _, _, shapes, stored = self.opened(f, size)
        n = shapes[0][0] if shapes else 0
        step = self.most if stored else max(n, 1)
        return [Rows(path, size, at, min(at + step, n)) for at in range(0, n, step)]

    def partitions(self) -> list[Bundle]:
        """Short ranges, and small archives of a folder of many, share a partition: neither tasks nor what planning opens are as many as the files."""
        found = listed(self.path, self.suffix)
        many, out, load, whole = len(found) > FEW, [], 0, False
        for path, size in found:
            closed = many and size <= SMALL
            for part in [Rows(path, size, 0, None)] if closed else self.ranges(path, size):
                own, most = (size, BUNDLE_BYTES) if closed else (part.end - part.start, self.most)
                if not out or closed != whole or load + own > most or len(out[-1].parts) >= BUNDLE_FILES:
                    out.append(Bundle([]))
                    load, whole = 0, closed
                out[-1].parts.append(part)
                load += own
        return out or [Bundle([])]

    def read(self, bundle: Bundle) -> Iterator[pa.RecordBatch]:
        files, _ = place(self.path)
        gathered, held = [], 0
        for part in bundle.parts:
            for batch in self.rows(files, part):
                gathered.append(batch)
                held += len(batch)
                if held >= ROWS or len(gathered) >= BUNDLE_FILES:
                    yield from pa.Table.from_batches(gathered).combine_chunks().to_batches()
                    gathered, held = [], 0
        if gathered:
            yield from pa.Table.from_batches(gathered).combine_chunks().to_batches()

    def rows(self, files: fs.FileSystem, part: Rows) -> Iterator[pa.RecordBatch]:
        with files.open_input_file(part.path) as f:
            streams, kinds, shapes, _ = self.opened(f, part.size)
            end = part.end if part.end is not None else shapes[0][0] if shapes else 0
            sizes = [k.itemsize * int(np.prod(s[1:])) for k, s in zip(kinds, shapes, strict=True)]
            for stream, size in zip(streams, sizes, strict=True):
                stream.skip(part.start * size)
            for at in range(part.start, end, ROWS):
                n = min(ROWS, end - at)
                columns = {"path": pa.array([part.path] * n, pa.string()), "row": pa.array(np.arange(at, at + n), pa.int64())}
                for x, stream, size, kind, shape in zip(self.fields, streams, sizes, kinds, shapes, strict=True):
                    values = np.frombuffer(stream.read(n * size), kind)
                    if len(values) * kind.itemsize != n * size:
                        raise ValueError(f"{part.path} ends within {x.name}")
                    flat = pa.array(values.astype(str) if kind.kind == "U" else values.astype(kind.newbyteorder("=")))
                    if len(shape) > 1:
                        flat = pa.FixedSizeListArray.from_arrays(flat, int(np.prod(shape[1:])))
                    columns[x.name] = flat.cast(to_arrow_type(x.dataType))
                yield pa.RecordBatch.from_arrays([columns[x.name] for x in self.schema.fields], self.schema.fieldNames())


class ArrayArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> str:
        return "path string, row long"

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options, schema)


def read_archives(spark: SparkSession, path: str, arrays: str, suffix: str = ".npz", rows_per_partition: int = 1_000_000) -> DataFrame:
    """path, row (from 0) and the arrays asked for, a column each, of all archives in a folder. Others aren't touched. Arrays of two dimensions are columns of lists; those asked for
    must have the same length."""
    spark.dataSource.register(ArrayArchive)
    reader = spark.read.format("array_archive").schema(f"path string, row long, {arrays}")
    return reader.option("path", path).option("suffix", suffix).option("rowsPerPartition", str(rows_per_partition)).load()


def npy(values: np.ndarray) -> bytes:
    """An array as a member: its header, padded so that values begin at a multiple of 64, and its bytes."""
    head = repr({"descr": values.dtype.str, "fortran_order": False, "shape": values.shape})
    pad = -(len(MAGIC) + 4 + len(head) + 1) % 64
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(head) + pad + 1) + head.encode("latin1") + b" " * pad + b"\n" + np.ascontiguousarray(values).tobytes()


def packed(arrays: dict[str, np.ndarray], compress: bool) -> bytes:
    """The archive of named arrays. Times are fixed, so equal arrays give equal bytes."""
    body, central = [], []
    at = 0
    for name, values in arrays.items():
        data, file = npy(values), f"{name}.npy".encode()
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        kept = deflate.compress(data) + deflate.flush() if compress else data
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, DEFLATED if compress else STORED, 0, 0x21, zlib.crc32(data), len(kept), len(data), len(file), 0)
        body += [LOCAL + common + file, kept]
        central.append(CENTRAL + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, at) + file)
        at += LOCAL_SIZE + len(file) + len(kept)
    listing = b"".join(central)
    return b"".join(body) + listing + END + struct.pack("<HHHHIIH", 0, 0, len(central), len(central), len(listing), at, 0)


def write_archives(df: DataFrame, key: str, index: str, columns: list[str], path: str, rows_a_file: int = 1_000_000, compress: bool = True) -> None:
    """One archive ``key-part.npz`` for every ``rows_a_file`` places of every key, whose rows stand in the order of index (from 0). Null numbers are NaN, so columns of integers may
    hold none. A file appears whole, and a repeated task replaces it by the same bytes; a key with most of the rows has many files, not a large one."""
    files, where = place(path)

    def put(key: str, part: int, held: list[pa.RecordBatch]) -> str:
        rows, arrays = pa.Table.from_batches(held), {}
        for c in columns:
            values = rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            if values.dtype == object:
                values = np.stack([np.asarray(v) for v in values]) if isinstance(values[0], list | np.ndarray) else np.array(values.tolist(), str)
            arrays[c] = values
        name = f"{key}-{int(part):05d}.npz"
        files.create_dir(where, recursive=True)
        fresh = f"{where}/_{uuid.uuid4().hex}"
        with files.open_output_stream(fresh) as f:
            f.write(packed(arrays, compress))
        files.move(fresh, f"{where}/{name}")
        return name

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, part and index; those of one file are held."""
        now, held, names = None, [], []
        for batch in batches:
            places = list(zip(batch.column("__key").to_pylist(), batch.column("__part").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end > start:
                    if held and places[start] != now:
                        names.append(put(*now, held))
                        held = []
                    now = places[start]
                    held.append(batch.slice(start, end - start))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])
            names = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([put(*now, held)])], ["name"])

    parts = df.select(F.col(key).cast("string").alias("__key"), F.col(index).alias("__index"), F.floor(F.col(index) / rows_a_file).alias("__part"), *columns)
    # The number is given, so the files aren't written by as few tasks as their bytes would make.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    dealt = parts.repartition(tasks, "__key", "__part").sortWithinPartitions("__key", "__part", "__index")
    materialize(dealt.mapInArrow(write, "name string"))
