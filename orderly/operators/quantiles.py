"""Exact quantiles of a whole column without bringing its values together.

``percentile`` keeps every distinct value of a group in one task. Within a recording or a cohort that is right; over a
whole large table the quantile is closed in on instead: approximate quantiles give a bracket around the rank, one count
shows how many values lie before it, and the bracket shrinks until what it holds fits one small sorted list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderly.session import materialize

MOST = 1_000_000
ACCURACY = 10_000


def value_at(values: DataFrame, rank: int, n: int, most: int) -> tuple[float, float]:
    """The values at a rank (from 0) and at the next one (the last once more at the end)."""
    low, high, below, inside = float("-inf"), float("inf"), 0, n
    while inside > most:
        at, margin = (rank - below) / inside, 3 / ACCURACY
        shares = [max(0.0, at - margin), min(1.0, at + margin + 1 / inside)]
        part = values.where(F.col("v").between(low, high))
        a, b = part.agg(F.percentile_approx("v", shares, ACCURACY).alias("q")).first()["q"]
        row = values.agg(F.count_if(F.col("v") < a).alias("below"), F.count_if(F.col("v").between(a, b)).alias("inside")).first()
        if not (row["below"] <= rank and rank + 1 < row["below"] + row["inside"] or rank == n - 1):
            break  # the approximation missed: what follows still holds the rank
        if row["inside"] >= inside:
            break  # ties fill the bracket
        low, high, below, inside = a, b, row["below"], row["inside"]
    # Ties as counts, so that the list is short even where the bracket is not.
    counts = values.where(F.col("v").between(low, high)).groupBy("v").count().orderBy("v")
    found, passed = [], below
    for row in counts.toLocalIterator():
        passed += row["count"]
        while len(found) < 2 and passed > min(rank + len(found), n - 1):
            found.append(row["v"])
        if len(found) == 2:
            break
    return found[0], found[-1]


def exact(df: DataFrame, value: Column, shares: tuple[float, ...], most: int = MOST) -> list[float | None]:
    """Quantiles of the values that are not NULL, linear between neighbours; None where there are none. What leads to the values runs once: they
    are written to the shared folder."""
    values = materialize(df.select(value.cast("double").alias("v")).where("v IS NOT NULL"))
    n = values.count()
    if n <= most:
        row = values.agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("q")).first()
        return list(row["q"]) if n else [None] * len(shares)
    out = []
    for share in shares:
        place = share * (n - 1)
        rank = min(int(place), n - 1)
        a, b = value_at(values, rank, n, most)
        out.append(a + (b - a) * (place - rank))
    return out


def neighbours(df: DataFrame, value: Column, shares: tuple[float, ...], most: int = MOST) -> list[tuple[float, float, float] | None]:
    """For each quantile, the values on both sides of its place and how far it lies between them; None where there are none. For quantiles of a rising function of the values:
    that function is taken of these two."""
    values = materialize(df.select(value.cast("double").alias("v")).where("v IS NOT NULL"))
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    ranks = [min(int(place), n - 1) for place in places]
    if n <= most:
        listed = values.agg(F.array_sort(F.collect_list("v")).alias("v"))
        found = listed.select(*[F.array(F.get("v", F.lit(r)), F.get("v", F.lit(min(r + 1, n - 1)))) for r in ranks]).first()
    else:
        found = [value_at(values, rank, n, most) for rank in ranks]
    return [(a, b, place - rank) for (a, b), place, rank in zip(found, places, ranks, strict=True)]


def dealt_by_range(rows: DataFrame, group: str, order: list[str], weight: Column) -> DataFrame:
    """rows with upto, the running total of the weight within their group in the given order, and whole, the group's total.
    Ranges of (group, order) are summed one by one and what lies before each is added, so no group is sorted in one task."""
    cut = materialize(rows.withColumn("__w", weight).repartitionByRange(group, *order).withColumn("__p", F.spark_partition_id()))
    sums = cut.groupBy(group, "__p").agg(F.sum("__w").alias("__s"))  # a row for each range and group in it
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select(
        F.col(group).alias("__g"), F.col("__p").alias("__q"), (F.sum("__s").over(before) - F.col("__s")).alias("__start"), F.sum("__s").over(Window.partitionBy(group)).alias("whole")
    )
    inside = Window.partitionBy(group, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("upto", F.sum("__w").over(inside))
    joined = summed.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn("upto", F.col("upto") + F.col("__start")).drop("__w", "__p", "__g", "__q", "__start")


def exact_by(df: DataFrame, group: str, value: Column, shares: dict[str, float], most: int = MOST, written: bool = False) -> DataFrame:
    """group with a column for each of the named quantiles of its values that are not NULL. Groups of up to ``most``
    values are aggregated as they are; larger ones are counted by value and ranked over ranges of values. What leads to the values runs once: they are written to the
    shared folder, unless df is a table already (``written``)."""
    values = df.select(group, value.cast("double").alias("v")).where("v IS NOT NULL")
    values = values if written else materialize(values)
    largest = values.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return values.groupBy(group).agg(*[F.percentile("v", F.lit(float(s))).alias(n) for n, s in shares.items()])
    ranked = dealt_by_range(values.groupBy(group, "v").count(), group, ["v"], F.col("count"))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    found = []
    for name, share in shares.items():
        place = share * (F.col("whole") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return ranked.groupBy(group).agg(*found)


def ranked_share(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """df with share: the row's rank in its group by value and tie, divided by the group's number of rows."""
    ranked = dealt_by_range(df, group, [value, tie], F.lit(1))
    return ranked.withColumn("share", F.col("upto") / F.col("whole")).drop("upto", "whole")
