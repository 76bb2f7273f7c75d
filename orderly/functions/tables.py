"""Table functions for SQL: pipe tables in texts, with columns named by their headers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def separates(line: str) -> bool:
    bare = line.strip()
    return bare.startswith("|") and bare.endswith("|") and len(bare) > 1 and not bare.strip("|:- ") and "-" in bare


def parsed(text: str | None, names: list[str]) -> Iterator[tuple]:
    """(line, cells...) of the rows below a header of these names and its separator, up to the end of the table."""
    header, inside = None, False
    for number, line in enumerate((text or "").split("\n")):
        bare = line.strip()
        table = bare.startswith("|") and bare.endswith("|") and len(bare) > 1
        if inside and table:
            found = cells(line)[: len(names)]
            yield (number, *found, *[None] * (len(names) - len(found)))
        elif header is not None and separates(line):
            inside = header == names
        else:
            inside = False
        header = cells(line) if table and not inside else None


def names_of(header: AnalyzeArgument) -> list[str]:
    """The columns of a constant header, which the query names."""
    if not header.isConstantExpression or not isinstance(header.value, str):
        raise ValueError("the header must be a constant text such as 'name | size'")
    found = cells(header.value)
    if len(set(found)) < len(found) or not all(found):
        raise ValueError("a header's names must differ and not be empty")
    return found


class PipeRows:
    """pipe_rows(text, header): the rows of the tables with that header in one text, to be used with LATERAL."""

    @staticmethod
    def analyze(text: AnalyzeArgument, header: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(T.StructType([T.StructField("line", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names_of(header)]]))

    def eval(self, text: str, header: str) -> Iterator[tuple]:
        yield from parsed(text, cells(header))


class PipeLines:
    """pipe_lines(TABLE(select key, line, text) PARTITION BY key ORDER BY (line), header): the rows of tables whose lines are rows of a relation, a table for each partition. The
    first column is the key, the last the line's text."""

    def __init__(self) -> None:
        self.key, self.lines, self.names = None, [], []

    @staticmethod
    def analyze(rows: AnalyzeArgument, header: AnalyzeArgument) -> AnalyzeResult:
        key = rows.dataType.fields[0]
        return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), T.StructField("line", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names_of(header)]]))

    def eval(self, row: Row, header: str) -> None:
        self.key, self.names = row[0], cells(header)
        self.lines.append((row[-1] or "").replace("\n", " "))

    def terminate(self) -> Iterator[tuple]:
        for found in parsed("\n".join(self.lines), self.names):
            yield (self.key, *found)


def register(spark: SparkSession) -> None:
    """Make pipe_rows and pipe_lines known to SQL."""
    spark.udtf.register("pipe_rows", udtf(PipeRows))
    spark.udtf.register("pipe_lines", udtf(PipeLines))
