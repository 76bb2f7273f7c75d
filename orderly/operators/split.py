"""Leak-free grouped splits and status rules of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderly.session import materialize


def by_hash(group: Column, dev: int = 10, test: int = 10, seed: str = "1") -> Column:
    """train, dev or test from a hash of the group: whole groups move together, on any cluster alike."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), group.cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < dev, "dev").when(bucket < dev + test, "test").otherwise("train")


def greedy(records: DataFrame, group: str, tokens: str, seed: str = "1", share: float = 0.1, block: int = 2000) -> DataFrame:
    """group, split: whole groups in hash order go to dev while they fit the row target, unless they would take the last
    training occurrence of a token; then the rest go to test alike. ``tokens`` is an array column.

    The choice is sequential over groups: each pass reads them in hash order, about ``block`` at a time, until its target
    is met or no group is left. A group is a row with its number of rows and its count of each token, added up in
    Spark. The driver holds the counts of all tokens and the groups chosen. Groups beyond the target can never fit."""
    target = round(records.count() * share)
    each = records.select(group, F.explode(tokens).alias("t")).groupBy(group, "t").agg(F.count("*").alias("n"))
    each = materialize(each)
    have = {r["t"]: r["n"] for r in each.groupBy("t").agg(F.sum("n").alias("n")).collect()}
    counts = each.groupBy(F.col(group).alias("__g")).agg(F.collect_list(F.struct("t", "n")).alias("counts"))
    sized = materialize(records.groupBy(group).agg(F.count("*").alias("rows")))
    small = sized.where(F.col("rows") <= target).join(counts, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    hashed = small.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col(group).cast("string")), 256))
    groups = materialize(hashed)
    blocks = groups.repartitionByRange(-(-groups.count() // block) or 1, "h", group).sortWithinPartitions("h", group)
    chosen: dict = {}
    for name in ("dev", "test"):
        room = target
        for row in blocks.toLocalIterator() if room else ():
            used = row["counts"] or []
            if row[group] in chosen or row["rows"] > room or any(have[t] - n < 1 for t, n in used):
                continue
            for t, n in used:
                have[t] -= n
            room -= row["rows"]
            chosen[row[group]] = name
            if not room:
                break
    kind = records.schema[group].dataType.simpleString()
    picked = records.sparkSession.createDataFrame(list(chosen.items()), f"__g {kind}, split string")
    split = F.coalesce("split", F.lit("train")).alias("split")
    return sized.join(picked, F.col(group).eqNullSafe(F.col("__g")), "left").select(group, split)


def status(missing: Column, conflict: Column, excluded: Column) -> Column:
    """The first reason that holds, in the order of missing, conflict and explicit exclusion."""
    return F.when(missing, "excluded_missing_audio").when(conflict, "excluded_duplicate_audio_conflict").when(excluded, "excluded_explicit").otherwise("ready")
