"""Expectations as queries that return the rows that break them, fingerprints and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def dense_ids(rows: DataFrame, key: str) -> DataFrame:
    """One row: whether the ids are 0 to n - 1 without gaps or repeats."""
    one = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n"), F.count_distinct(key).alias("d"))
    return one.select((F.col("lo") == 0).alias("starts_at_0"), ((F.col("hi") - F.col("lo") + 1 == F.col("n")) & (F.col("d") == F.col("n"))).alias("dense"), "n")


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row that does not depend on the order of rows: their number and the sum of the first 60 bits of their SHA-256. A
    row is hashed as its cells in text form, each with its length before it, NULL as -1."""
    cells = [F.concat(F.coalesce(F.length(F.col(c).cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns]
    head = F.conv(F.substring(F.sha2(F.concat_ws("|", *cells), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(head), F.lit(0)).cast("string").alias("fingerprint"))


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path and problem for every file (path, sha256, bytes) that the two manifests do not share unchanged."""
    l, r = left.alias("l"), right.alias("r")
    both = l.join(r, F.col("l.path") == F.col("r.path"), "full_outer")
    problem = (
        F.when(F.col("r.path").isNull(), "missing").when(F.col("l.path").isNull(), "unexpected")
        .when(F.col("l.bytes") != F.col("r.bytes"), "size").when(F.col("l.sha256") != F.col("r.sha256"), "hash")
    )
    return both.select(F.coalesce("l.path", "r.path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


def manifest(spark, path: str) -> DataFrame:
    """path, sha256 and bytes of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def overlaps(rows: DataFrame, key: str, start: str, end: str, slack: float = 0.0) -> DataFrame:
    """Rows that begin before the one before them in their key has ended."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    return rows.withColumn("previous_end", before).where(F.col("previous_end") > F.col(start) + slack)
