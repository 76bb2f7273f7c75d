"""Files by byte: a stream of the lines that growing files gain, and a scan of ranges that seeks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BLOCK = 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, or of one file, by name. Hidden ones, which begin with a dot or an underscore, are left out."""
    files, where = place(path)
    found = files.get_file_info(where)
    if found.type == fs.FileType.NotFound:
        return []
    infos = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith(suffix) and i.base_name[0] not in "._")


@dataclass
class Span(InputPartition):
    """Bytes from start up to end of a file; begin and limit bound what may be read around them."""

    path: str
    start: int
    end: int
    begin: int = 0
    limit: int = 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.chunk = int(options.get("chunkBytes", 64 << 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """For every file, where its last whole line ends: a torn last line waits for its end."""
        files, _ = place(self.path)
        out = {}
        for path, size in listed(self.path, self.suffix):
            at = size
            with files.open_input_file(path) as f:
                while at > 0:
                    start = max(0, at - BLOCK)
                    f.seek(start)
                    found = f.read(at - start).rfind(b"\n")
                    if found >= 0:
                        at = start + found + 1
                        break
                    at = start
            out[path] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = []
        for path, to in end.items():
            begin = start.get(path, 0)
            if to < begin:
                raise ValueError(f"{path} has shrunk from {begin} to {to} bytes")
            spans += [Span(path, at, min(at + self.chunk, to), begin, to) for at in range(begin, to, self.chunk)]
        return spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        """The lines that begin within the span. One that begins before it belongs to the span before."""
        files, _ = place(self.path)
        with files.open_input_file(span.path) as f:
            skipping = span.start > span.begin
            at = span.start - skipping  # a line that begins at the start follows a line end
            f.seek(at)
            rest, lines, places = b"", [], []
            while at < span.limit:
                data = f.read(min(BLOCK, span.limit - at))
                if not data:
                    break
                at += len(data)
                if skipping:
                    found = data.find(b"\n")
                    if found < 0:
                        continue
                    data, skipping = data[found + 1 :], False
                rest += data
                *whole, rest = rest.split(b"\n")
                begun = at - len(rest) - sum(len(w) + 1 for w in whole)
                for line in whole:
                    if begun < span.end:
                        lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                        places.append(begun)
                    begun += len(line) + 1
                if len(lines) >= 1000:
                    yield self._batch(span.path, places, lines)
                    lines, places = [], []
                if begun >= span.end:
                    break
            yield self._batch(span.path, places, lines)

    def _batch(self, path: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["path", "at", "line"])

    def commit(self, end: dict) -> None:
        pass


class ByteTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_tail"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, suffix: str = "", chunk_bytes: int = 64 << 20) -> DataFrame:
    """A stream (path, at, line) of the lines that files in a folder gain, each with the byte at which it begins. Progress is a byte of every file, so a
    restart neither loses nor repeats a line; a last line without its end is held back until the end comes. Large growth is read in parts of
    ``chunk_bytes``. Executors open the files, so the folder must be one that all see. A file that shrinks is an error."""
    spark.dataSource.register(ByteTail)
    return spark.readStream.format("byte_tail").option("path", path).option("suffix", suffix).option("chunkBytes", str(chunk_bytes)).load()


def parsed_json(lines: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON lines; a line that is no JSON of that schema is skipped."""
    mark = "__torn"
    fields = F.from_json("line", f"{schema}, {mark} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark})
    return lines.select(fields.alias("f")).where(F.col(f"f.{mark}").isNull() & F.col("f").isNotNull()).select("f.*").drop(mark)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.chunk, self.most = int(options.get("chunkBytes", 64 << 10)), int(options.get("partitionBytes", 64 << 20))
        self.low, self.high, self.paths = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds of start and names of files decide what is read; what is left goes to Spark."""
        for f in filters:
            column, value = f.attribute if hasattr(f, "attribute") else (), getattr(f, "value", None)
            if column == ("path",) and isinstance(f, EqualTo | In):
                names = {value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = names if self.paths is None else self.paths & names
            elif column == ("start",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and value is not None:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    top = value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            else:
                yield f

    def partitions(self) -> list[Span]:
        spans, step = [], max(1, self.most // self.chunk) * self.chunk
        for path, size in listed(self.path, self.suffix):
            if self.paths is None or path in self.paths:
                first = -(-self.low // self.chunk) * self.chunk
                last = size if self.high is None else min(size, -(-self.high // self.chunk) * self.chunk)
                spans += [Span(path, at, min(at + step, last)) for at in range(first, last, step)]
        return spans or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.end > span.start:
            files, _ = place(self.path)
            with files.open_input_file(span.path) as f:
                f.seek(span.start)
                rows, size, at = [], 0, span.start
                while at < span.end:
                    data = f.read(min(self.chunk, span.end - at))
                    rows.append((span.path, at, len(data), data))
                    at, size = at + self.chunk, size + len(data)
                    if size >= BLOCK:
                        yield self._batch(rows)
                        rows, size = [], 0
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = {"path": pa.string(), "start": pa.int64(), "length": pa.int32(), "content": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start long, length int, content binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def byte_ranges(spark: SparkSession, path: str, chunk_bytes: int, suffix: str = "", partition_bytes: int = 64 << 20) -> DataFrame:
    """Files cut into (path, start, length, content) of ``chunk_bytes`` each, in tasks of at most ``partition_bytes``. Conditions on path and
    start are pushed into the scan, which seeks to what is asked for and reads no other byte."""
    spark.dataSource.register(ByteRanges)
    spark.conf.set(PUSHDOWN, "true")
    options = {"path": path, "suffix": suffix, "chunkBytes": str(chunk_bytes), "partitionBytes": str(partition_bytes)}
    return spark.read.format("byte_ranges").options(**options).load()


def little_endian(content: Column, at: int, size: int) -> Column:
    """The unsigned number in so many bytes from a place, counted from 0."""
    digits = F.hex(F.substring(content, at + 1, size))
    swapped = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("long")


def wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, channels, rate, bits and frames of canonical WAV files, from 44 bytes of each."""
    head = byte_ranges(spark, path, 44, ".wav").where((F.col("start") == 0) & (F.col("length") == 44))
    c = F.col("content")
    channels, bits = little_endian(c, 22, 2), little_endian(c, 34, 2)
    frames = F.try_divide(little_endian(c, 40, 4), channels * (bits / 8))
    return head.where(F.substring(c, 1, 4) == F.lit(b"RIFF")).select("path", channels.alias("channels"), little_endian(c, 24, 4).alias("rate"), bits.alias("bits"), frames.cast("long").alias("frames"))
