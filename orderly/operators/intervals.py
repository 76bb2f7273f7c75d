"""Joins on time: nearest in time, points in intervals, proximity; unions, tilings and offsets of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderly.functions import scalar as S


def asof(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, right_id: str) -> DataFrame:
    """left with the latest row of right at or before its time (right_id breaks ties), NULL where there is none. One
    sort of both tables together: no pair of rows is ever made."""
    names = [c for c in right.columns if c not in (key,)]
    tagged = left.select("*", F.struct(F.col(left_t).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[right_id].dataType).alias("id")).alias("__o"), F.lit(None).cast(right.select(F.struct(*names).alias("r")).schema["r"].dataType).alias("__r"))
    other = right.select(F.col(key), F.struct(F.col(right_t).alias("t"), F.lit(0).alias("side"), F.col(right_id).alias("id")).alias("__o"), F.struct(*names).alias("__r"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    window = Window.partitionBy(key).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__r", F.last("__r", True).over(window)).where("__o.side = 1").select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in names])


def nearest_on_grid(left: DataFrame, right: DataFrame, key: str, step: float, tolerance: float) -> DataFrame:
    """left (key, t, ...) with the row of a regular grid right (key, k, t2, ...) at the nearest index, matched where it
    lies within the tolerance; others keep NULL. An equi-join on the computed index."""
    found = left.withColumn("k", S.rint(F.col("t") / step))
    near = right.withColumn("__hit", F.lit(True))
    out = found.join(near, [key, "k"], "left")
    ok = F.coalesce(F.abs(F.col("t2") - F.col("t")) <= tolerance, F.lit(False))
    values = [c for c in right.columns if c not in (key, "k")]
    return out.select(*left.columns, *[F.when(ok, F.col(c)).alias(c) for c in values], ok.alias("matched"))


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, bucket: float, how: str = "inner") -> DataFrame:
    """Points with the half-open intervals [start, end) of their key that hold them: an equi-join on key and time
    bucket (an interval stands in every bucket that it touches) with the range as its rest."""
    cut = intervals.where(F.col(end) > F.col(start)).withColumn(
        "__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)))
    )
    cut = cut.withColumnRenamed(key, "__k")
    left = points.withColumn("__at", F.floor(F.col(t) / bucket))
    inside = (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__b")) & (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))
    return left.join(cut, inside, how).drop("__at", "__b", "__k")


def first_in_intervals(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, bucket: float, order: str) -> DataFrame:
    """Every point once, with the first (by ``order``) of the intervals of its key that hold it, or NULLs. Repeated points
    come once."""
    names = [c for c in intervals.columns if c not in (key, start, end)]
    met = in_intervals(points.distinct(), intervals, key, t, start, end, bucket, "left")
    first = F.min_by(F.struct(*names), F.struct(order, *[c for c in names if c != order])).alias("__first")
    return met.groupBy(*points.columns).agg(first).select(*points.columns, "__first.*")


def zip_positions(left: DataFrame, right: DataFrame, keys: list[str], same: list[str] | None = None) -> DataFrame:
    """Rows of two ordered lists side by side by key and position, as far as the shorter goes. Columns in ``same`` stand on
    both sides and must agree; a pair that differs is an error."""
    same = same or []
    other = right.withColumnsRenamed({c: f"__{c}" for c in same})
    paired = left.join(other, keys)
    for c in same:
        bad = ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        paired = paired.withColumn(c, F.when(bad, F.raise_error(F.concat(F.lit(f"{c} differs at "), F.to_json(F.struct(*keys))))).otherwise(F.col(c)))
    return paired.drop(*[f"__{c}" for c in same])


def union_length(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The length of the union of each key's intervals, with the number of merged ones; touching intervals merge."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) > reach).cast("long"), F.lit(1))
    islands = intervals.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(key, "__island").agg(F.min(start).alias("a"), F.max(end).alias("b"))
    return merged.groupBy(key).agg(F.count("*").alias("islands"), F.sum(F.col("b") - F.col("a")).alias("length"))


def tiling(intervals: DataFrame, key: str, start: str, end: str, label: str, total_start, total_end) -> DataFrame:
    """key, xmin, xmax, label: disjoint intervals and, with empty labels, the gaps around them, so that the whole span
    is covered."""
    order = Window.partitionBy(key).orderBy(start)
    known = intervals.select(key, F.col(start).alias("xmin"), F.col(end).alias("xmax"), F.col(label).alias("label"), total_start.alias("__a"), total_end.alias("__b"))
    order = Window.partitionBy(key).orderBy("xmin")
    before = known.select(key, F.coalesce(F.lag("xmax").over(order), F.col("__a")).alias("lo"), F.col("xmin").alias("hi"))
    last = known.groupBy(key).agg(F.max("xmax").alias("lo"), F.max("__b").alias("hi"))
    gaps = before.unionByName(last).where("hi > lo").select(key, F.col("lo").alias("xmin"), F.col("hi").alias("xmax"), F.lit("").alias("label"))
    return known.select(key, "xmin", "xmax", "label").unionByName(gaps)


def offsets(children: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """start and end of each child in its parent: running sums of the sizes."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return children.withColumn("end", F.sum(size).over(window)).withColumn("start", F.col("end") - F.col(size))


def near_flag(rows: DataFrame, key: str, t: str, flag: str, within: int) -> DataFrame:
    """near: some row of the key within so much of this one's time (itself included) has the flag."""
    window = Window.partitionBy(key).orderBy(t).rangeBetween(-within, within)
    return rows.withColumn("near", F.max(F.col(flag).cast("int")).over(window) == 1)
