"""Frame tables: screening, jumps, runs, gap filling, smoothing and banding.

A frame table has a recording key, a frame index that orders it, and measures; NULL stands for a missing value. Every
window is partitioned by the recording, so frames of different recordings never meet."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderly.functions import scalar as S
from orderly.operators.quantiles import neighbours


def by(rec: str = "rec", i: str = "i") -> Window:
    return Window.partitionBy(rec).orderBy(i)


def jump_pairs(frames: DataFrame, limit: float = 7.0) -> DataFrame:
    """jump_pair: this voiced frame and the next lie more than ``limit`` semitones apart."""
    following = F.lead("f").over(by())
    step = F.abs(12 * F.log2(F.greatest(following, F.lit(1.0)) / F.greatest(F.col("f"), F.lit(1.0))))
    return frames.withColumn("jump_pair", F.coalesce((F.col("f") > 0) & (following > 0) & (step > limit), F.lit(False)))


def jump_mask(frames: DataFrame, limit: float = 7.0) -> DataFrame:
    """jump: a pair that jumps begins between two frames before and one after."""
    around = by().rowsBetween(-2, 1)
    return jump_pairs(frames, limit).withColumn("jump", F.max("jump_pair").over(around))


def screen(frames: DataFrame, min_strength: float = 0.6, min_rms: float = -45.0, min_run: int = 5) -> DataFrame:
    """reliable: voiced, strong and loud enough, not near a jump, and in a run of at least so many frames like that."""
    ok = (F.col("f") > 0) & (F.col("strength") >= min_strength) & (F.col("rms") >= min_rms) & ~F.col("jump")
    passed = label_runs(jump_mask(frames).withColumn("__ok", F.coalesce(ok, F.lit(False))), "__ok", "__run")
    return passed.withColumn("reliable", F.coalesce(F.col("__run_length") >= min_run, F.lit(False))).drop("__ok", "__run", "__run_length")


def label_runs(frames: DataFrame, mask: str, out: str = "run") -> DataFrame:
    """``out``: a number for each run of frames on which the mask holds (null elsewhere), and its length."""
    change = (F.col(mask) != F.coalesce(F.lag(mask).over(by()), ~F.col(mask))).cast("long")
    numbered = frames.withColumn("__island", F.sum(change).over(by().rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("rec", "__island")
    return (
        numbered.withColumn(out, F.when(F.col(mask), F.min("i").over(island)))
        .withColumn(f"{out}_length", F.when(F.col(mask), F.count("*").over(island)))
        .drop("__island")
    )


def runs(frames: DataFrame, mask: str, at_least: int = 1) -> DataFrame:
    """rec, start, end (exclusive) and length of every run of at least so many frames."""
    labelled = label_runs(frames, mask).where(F.col("run").isNotNull())
    table = labelled.groupBy("rec", F.col("run").alias("start")).agg((F.max("i") + 1).alias("end"), F.count("*").alias("length"))
    return table.where(F.col("length") >= at_least)


def fill_gaps(frames: DataFrame, value: str, most: int = 3) -> DataFrame:
    """``value`` with gaps of at most so many frames filled linearly in time between both neighbours."""
    before = by().rowsBetween(Window.unboundedPreceding, -1)
    after = by().rowsBetween(1, Window.unboundedFollowing)
    known = F.col(value).isNotNull()

    def near(column: str, window: Window, last: bool) -> Column:
        picked = F.when(known, F.col(column))
        return (F.last(picked, True) if last else F.first(picked, True)).over(window)

    ext = frames.select(
        "*",
        near(value, before, True).alias("__v0"),
        near("t", before, True).alias("__t0"),
        near("i", before, True).alias("__i0"),
        near(value, after, False).alias("__v1"),
        near("t", after, False).alias("__t1"),
        near("i", after, False).alias("__i1"),
    )
    line = F.col("__v0") + F.try_divide((F.col("__v1") - F.col("__v0")) * (F.col("t") - F.col("__t0")), F.col("__t1") - F.col("__t0"))
    fits = (F.col("__i1") - F.col("__i0") - 1) <= most
    return ext.withColumn(f"{value}_filled", F.coalesce(F.col(value), F.when(fits, line))).drop("__v0", "__t0", "__i0", "__v1", "__t1", "__i1")


def whole_runs(frames: DataFrame, value: str, at_least: int = 5) -> DataFrame:
    """The frames of all runs of at least so many known values, with run, run_length and k, the place in the run from 0."""
    known = label_runs(frames.withColumn("__known", F.col(value).isNotNull()), "__known").where(F.col("run_length") >= at_least)
    return known.withColumn("k", (F.col("i") - F.col("run")).cast("int")).drop("__known")


def in_run() -> Window:
    return Window.partitionBy("rec", "run").orderBy("i")


def median5(runs: DataFrame, value: str) -> DataFrame:
    """``value``_median over five frames of a run (from whole_runs), whose ends repeat their outermost value."""
    first = F.first(value).over(in_run())
    last = F.last(value).over(in_run().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    five = []
    for step in (-2, -1, 0, 1, 2):
        place = F.col("k") + step
        five.append(F.when(place < 0, first).when(place >= F.col("run_length"), last).otherwise(F.lag(value, -step).over(in_run())))
    return runs.withColumn(f"{value}_median", F.element_at(F.array_sort(F.array(*five)), 3))


def smoothing_weights(points: int) -> list[list[float]]:
    """For each place among so many points, the weights that give the value there of the parabola fitted to them all."""
    powers = np.vander(np.arange(points) - points // 2, 3).astype(float)
    return (powers @ np.linalg.pinv(powers)).round(12).tolist()


def savgol9(runs: DataFrame, value: str) -> DataFrame:
    """``value``_smooth: Savitzky-Golay over nine frames of a run (from whole_runs; over the greatest odd number of frames
    where it is shorter), of second order. Near a run's ends the parabola of the outermost window is read off."""
    around = F.collect_list(value).over(in_run().rowsBetween(-8, 8))
    half = F.floor((F.least(F.lit(9), F.col("run_length")) - 1) / 2).cast("int")
    middle = F.greatest(half, F.least(F.col("k"), F.col("run_length").cast("int") - 1 - half))
    first = F.least(F.col("k"), F.lit(8)) + middle - half - F.col("k")  # the window's begin in the frames around
    out = F.lit(None).cast("double")
    for points in (5, 7, 9):
        table = F.lit(smoothing_weights(points))
        weights = F.element_at(table, F.col("k") - middle + points // 2 + 1)
        window = F.slice("__around", first + 1, F.lit(points))
        total = F.aggregate(F.zip_with(window, weights, lambda x, w: x * w), F.lit(0.0), lambda acc, x: acc + x)
        out = F.when(half == points // 2, total).otherwise(out)
    return runs.withColumn("__around", around).withColumn(f"{value}_smooth", out).drop("__around")


def moving_rms(frames: DataFrame, value: str, half: int, zero_padded: bool = False) -> DataFrame:
    """``value``_rms over 2 half + 1 frames. Beyond the ends the outermost value is repeated, or counts as zero."""
    width = 2 * half + 1
    square = F.col(value) * F.col(value)
    total = F.sum(square).over(by().rowsBetween(-half, half))
    if not zero_padded:
        place, n = F.row_number().over(by()), F.count("*").over(Window.partitionBy("rec"))
        whole = by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before, behind = F.greatest(half + 1 - place, F.lit(0)), F.greatest(half - (n - place), F.lit(0))
        total = total + before * F.first(square).over(whole) + behind * F.last(square).over(whole)
    return frames.withColumn(f"{value}_rms", F.sqrt(total / width))


def log_bounds(frames: DataFrame, value: str = "f", low: float = 0.05, high: float = 0.95, bands: int = 5) -> DataFrame:
    """One row: lo and hi, quantiles taken in the logarithm (linear interpolation), and the edges between them. Values equal to a bound are common, and whether they lie beyond it hangs on the last
    bit; so these few logarithms are those of the C library, as in databases, not of Java's, which round otherwise."""
    ends = []
    for found in neighbours(frames, F.when(F.col(value) > 0, F.col(value)), (low, high)):
        ends.append(None if found is None else math.exp(math.log(found[0]) * (1 - found[2]) + math.log(found[1]) * found[2]))
    edges = None
    if None not in ends:
        first, last = map(math.log, ends)
        edges = [math.exp(first + k * (last - first) / bands) for k in range(bands + 1)]
    return frames.sparkSession.createDataFrame([(*ends, edges)], "lo double, hi double, edges array<double>")


def five_level(frames: DataFrame, bounds: DataFrame) -> DataFrame:
    """level, t_value and saturated for every frame; bounds is one row, so it is broadcast. Edges that it doesn't have follow from lo and hi."""
    bounds = bounds if "edges" in bounds.columns else bounds.withColumn("edges", S.log_edges(F.col("lo"), F.col("hi")))
    return frames.crossJoin(F.broadcast(bounds)).withColumns(
        {
            "level": S.band(F.col("f"), F.col("edges")),
            "t_value": S.t_value(F.col("f"), F.col("lo"), F.col("hi")),
            "saturated": (F.col("f") < F.col("lo")) | (F.col("f") > F.col("hi")),
        }
    )


def segments_of_labels(frames: DataFrame, label: str, blank: Column | None = None) -> DataFrame:
    """Run-length segments: rec, seq start, label, first and last time, peak value and its time."""
    change = (~F.col(label).eqNullSafe(F.lag(label).over(by()))) | (F.row_number().over(by()) == 1)
    numbered = frames.withColumn("__seg", F.sum(change.cast("long")).over(by().rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("rec", F.col("__seg").alias("seq"), F.col(label).alias("label")).agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.max("f").alias("peak"), F.count("*").alias("n"),
        F.min_by("t", F.struct((-F.col("f")).alias("a"), F.col("i").alias("b"))).alias("peak_t"),
    )
    return out if blank is None else out.where(~blank)
