"""Append-only event logs as streams: latest state by key, early stopping, windows with watermarks."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, path: str, schema: T.StructType | str, files: int = 1) -> DataFrame:
    """JSON lines that arrive as files in a folder; lines that are no JSON are dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("mode", "DROPMALFORMED").json(path)


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, batch or stream (update mode)."""
    fields = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("last")).select(key, "last.*")


def tumbling(events: DataFrame, at: str, length: str, late: str, value: str) -> DataFrame:
    """Counts and sums in windows of fixed length; rows later than ``late`` are left out of a stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    grouped = timed.withWatermark(at, late).groupBy(F.window(at, length))
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, at: str, length: str, slide: str, late: str, value: str) -> DataFrame:
    """Counts and sums in windows of fixed length that begin every ``slide``."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    grouped = timed.withWatermark(at, late).groupBy(F.window(at, length, slide))
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def changes(events: DataFrame, key: str, order: str, value: str, ends: tuple[str, ...] = ()) -> DataFrame:
    """The rows (key, order, value: text) of a stream whose value differs from that of the row before, in order within each
    trigger; after one of the ``ends`` nothing more comes of that key. Rows older than the last one are left out."""
    kind = events.schema[key].dataType.simpleString()

    def update(ids: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for step, now in rows[[order, value]].itertuples(index=False):
            if last in ends or (at is not None and step <= at):
                continue
            if now != last:
                out.append({key: ids[0], order: int(step), value: now})
            at, last = int(step), now
        if at is not None:
            state.update((at, last))
        yield pd.DataFrame(out, columns=[key, order, value])

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {order} long, {value} string", "at long, last string", "append", GroupStateTimeout.NoTimeout)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """A writer of JSON lines that only ever adds files to a folder. Started again with the same checkpoint it goes on after what
    was committed."""
    return events.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def run_for(writer, seconds: float, done=None, poll: float = 0.5) -> str:
    """Start a stream and stop it gracefully at the end of a time budget, or as soon as ``done()`` holds, when what has arrived is processed:
    'finished' (it ended by itself), 'done' or 'stopped'. Progress stays in the writer's checkpoint."""
    running, end = writer.start(), time.monotonic() + seconds
    while not running.awaitTermination(poll):
        over = time.monotonic() >= end
        if over or (done is not None and done()):
            if not over:
                running.processAllAvailable()
            running.stop()
            return "stopped" if over else "done"
    return "finished"


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's rows with less than ``gap`` between neighbours."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    grouped = timed.withWatermark(at, late).groupBy(key, F.session_window(at, gap))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def early_stop_fold(points: Column, min_delta: float, patience: int, from_step: int = 0) -> Column:
    """A fold over an array of (step, value) in order: best, stale, stopped_at (-1: never). A value improves only if it is
    below the best by more than ``min_delta``; staleness counts after ``from_step``."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.lit(-1).cast("long").alias("stopped_at"))

    def step(state: Column, p: Column) -> Column:
        better = p["value"] < state["best"] - min_delta
        stale = F.when(better, 0).when(p["step"] > from_step, state["stale"] + 1).otherwise(state["stale"]).cast("int")
        over = state["stopped_at"] >= 0
        return F.when(over, state).otherwise(
            F.struct(
                F.when(better, p["value"]).otherwise(state["best"]).alias("best"),
                stale.alias("stale"),
                F.when(stale >= patience, p["step"]).otherwise(F.lit(-1).cast("long")).cast("long").alias("stopped_at"),
            )
        )

    return F.aggregate(points, start, step)


def early_stop_stream(events: DataFrame, key: str, min_delta: float, patience: int) -> DataFrame:
    """The same fold kept as state over a stream of (key, step, value): one row for each key and trigger."""
    kind = events.schema[key].dataType.simpleString()

    def update(ids: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, stale, stopped = state.get if state.exists else (float("inf"), 0, -1)
        for part in parts:
            for at, value in part.sort_values("step")[["step", "value"]].itertuples(index=False):
                if stopped >= 0:
                    break
                if value < best - min_delta:
                    best, stale = float(value), 0
                else:
                    stale += 1
                stopped = int(at) if stale >= patience else -1
        state.update((best, stale, stopped))
        yield pd.DataFrame([{key: ids[0], "best": best, "stale": stale, "stopped_at": stopped}])

    return events.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, best double, stale int, stopped_at long", "best double, stale int, stopped_at long", "update", GroupStateTimeout.NoTimeout
    )
