"""Strict readers of text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.session import materialize


def csv(spark: SparkSession, path: str, schema: T.StructType | str, exact: bool = False) -> DataFrame:
    """CSV with a header. exact: the header must be the schema's names in order; otherwise an error, at reading. A byte
    order mark before the first name is taken off by the reader."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("mode", "FAILFAST")
    return reader.schema(schema).option("enforceSchema", str(not exact).lower()).csv(path)


# The null value is what the parser gives cells without quotes or characters; quoted ones are empty strings.
CELLS = {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "FAILFAST", "nullValue": "\u0000"}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files as texts, where quoted cells may hold line ends (\\n, \\r\\n or \\r): path, record (from 1, blank lines
    not counted), line and last_line (the physical lines it begins and ends on, from 1) and text.

    Quotes are counted on each line of each split of a file, and their parity before a split follows from the splits before it: a line end ends a record where
    the number of quotes before it is even. Lines of a record are put together over the borders of splits; a record of one line is never
    moved for that. So quotes may only stand around cells or doubled within them, which the parser of cells checks. A quote that is still open at the end of a file is an error, at reading."""
    value = F.when(F.col("_metadata.file_block_start") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))  # a mark before the first line
    raw = spark.read.option("lineSep", "\n").text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    parts = F.split("value", r"(?<=\r)(?!\z)", -1)
    pieces = raw.select("path", "start", "row", (F.size(parts) - 1).alias("last"), F.posexplode(parts).alias("at", "piece"))
    carriage = F.col("piece").endswith("\r")
    end = F.when(~carriage, "\n").when(F.col("at") == F.col("last"), "\r\n").otherwise("\r")
    bare = F.regexp_replace("piece", r"\r\z", "")
    lines = materialize(pieces.select("path", "start", "row", "at", bare.alias("body"), end.alias("end"), (F.length("piece") - F.length(F.replace("piece", F.lit('"'), F.lit("")))).alias("quotes"), (F.length(bare) == 0).alias("blank")))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("path", "start").orderBy("row", "at")

    def before(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.coalesce(F.sum(name).over(earlier), F.lit(0)))

    splits = lines.groupBy("path", "start").agg(F.sum("quotes").alias("quotes_before"), F.count("*").alias("lines_before"))
    splits = before(before(splits, "quotes_before"), "lines_before")

    def placed(df: DataFrame) -> DataFrame:
        there = df.join(splits, ["path", "start"]).withColumn("line", F.col("lines_before") + F.row_number().over(run))
        upto = F.col("quotes_before") + F.sum("quotes").over(run)
        there = there.withColumns({"inside": (upto - F.col("quotes")) % 2 == 1, "open": upto % 2 == 1})
        return there.withColumns({"first": F.when(~F.col("inside") & ~F.col("blank"), F.col("line")), "dropped": ~F.col("inside") & F.col("blank")})

    marks = placed(lines.drop("body", "end")).groupBy("path", "start").agg(F.max("first").alias("carried"), F.count("first").alias("records_before"))
    marks = before(marks.withColumn("carried", F.last("carried", ignorenulls=True).over(earlier)), "records_before")
    whole = placed(lines).join(marks, ["path", "start"]).where(~F.col("dropped"))
    whole = whole.select(
        "path", (F.col("records_before") + F.count("first").over(run)).alias("record"), F.coalesce(F.last("first", ignorenulls=True).over(run), "carried").alias("begun"),
        "line", "body", "end", "inside", "open",
    )
    alone = ~F.col("inside") & ~F.col("open")
    single = whole.where(alone).select("path", "record", F.col("line"), F.col("line").alias("last_line"), F.col("body").alias("text"))
    several = whole.where(~alone).groupBy("path", "record").agg(F.min("begun").alias("line"), F.sort_array(F.collect_list(F.struct("line", "body", "end", "open"))).alias("l"))
    final = F.element_at("l", -1)
    joined = F.concat(F.array_join(F.transform(F.slice("l", 1, F.size("l") - 1), lambda x: F.concat(x["body"], x["end"])), ""), final["body"])
    text = F.when(final["open"], F.raise_error(F.concat(F.lit("a quote is not closed in "), "path", F.lit(", line "), F.col("line").cast("string")))).otherwise(joined)
    return single.unionByName(several.select("path", "record", "line", final["line"].alias("last_line"), text.alias("text")))


def strict_csv(spark: SparkSession, path: str, columns: list[str], id_col: str, pattern: str) -> DataFrame:
    """Records of CSV files as strings, with path, record, line and last_line as csv_records() has them. It is an error, at reading, if a
    header is not the columns in order, a record has more or fewer cells, an id doesn't match the pattern in full or occurs twice in all files. An empty
    cell is NULL without quotes and an empty string with them."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    cells = csv_records(spark, path).withColumn("r", F.from_csv("text", schema, CELLS))

    def complain(what: str):
        return F.raise_error(F.concat(F.lit(f"{what} in "), "path", F.lit(", line "), F.col("line").cast("string")))

    named_so = F.coalesce(F.array(*[F.col("r")[c] for c in columns]) == F.array(*[F.lit(c) for c in columns]), F.lit(False))
    header = F.when((F.col("record") == 1) & ~named_so, complain("wrong header")).otherwise(F.col("record") > 1)
    rows = cells.where(header).select("path", "record", "line", "last_line", "r.*")
    named = F.when(F.coalesce(~F.col(id_col).rlike(f"^(?:{pattern})\\z"), F.lit(True)), complain("malformed id")).otherwise(F.col(id_col))
    once = Window.partitionBy(id_col).orderBy("path", "line")
    again = F.when(F.row_number().over(once) > 1, complain("repeated id")).otherwise(F.col(id_col))
    return rows.withColumn(id_col, named).withColumn(id_col, again)


def cells(spark: SparkSession, path: str, sep: str, at_least: int) -> DataFrame:
    """Lines of text without a header as arrays of cells, in files whose lines may differ in length; shorter ones are left out."""
    rows = spark.read.text(path).select(F.split("value", F.lit(sep), -1).alias("cells"))
    return rows.where(F.size("cells") >= at_least)


def lexicon(spark: SparkSession, csv_path: str | None, tsv_path: str | None) -> DataFrame:
    """word, syllables, source from ragged CSV (second and last cell, six at least) and TSV (first and second cell)."""
    parts = []
    if csv_path:
        c = cells(spark, csv_path, ",", 6)
        parts.append(c.select(F.col("cells")[1].alias("word"), F.split(F.trim(F.element_at("cells", -1)), r"\s+").alias("syllables"), F.lit("csv").alias("source")))
    if tsv_path:
        c = cells(spark, tsv_path, "\t", 2)
        parts.append(c.select(F.col("cells")[0].alias("word"), F.split(F.trim(F.col("cells")[1]), r"\s+").alias("syllables"), F.lit("tsv").alias("source")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a line that does not fit the schema is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """One row per file of JSON, with its path, in files matched by a pattern."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(glob).withColumn("path", F.col("_metadata.file_path"))


def audio_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, channels, rate and bits of canonical WAV files, from their first 44 bytes. The source reads whole files
    all the same, each into one row, so files are limited to 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length >= 44")
    head = F.hex(F.substring("content", 1, 44))

    def number(at: int, size: int) -> Column:
        swapped = F.concat(*[F.substring(head, 2 * (at + k) + 1, 2) for k in reversed(range(size))])
        return F.conv(swapped, 16, 10).cast("long")

    return files.select("path", F.col("length").alias("bytes"), number(22, 2).alias("channels"), number(24, 4).alias("rate"), number(34, 2).alias("bits"))


def markdown_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row number and cells of the pipe tables in a text; separator lines are left out."""
    lines = texts.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "s"))
    inside = lines.where(F.trim("s").rlike(r"^\|.*\|$") & ~F.trim("s").rlike(r"^\|[\s:|-]+\|$"))
    body = F.regexp_replace(F.trim("s"), r"^\||\|$", "")
    return inside.select(id_col, "line", F.transform(F.split(body, r"\|"), lambda c: F.trim(c)).alias("cells"))
