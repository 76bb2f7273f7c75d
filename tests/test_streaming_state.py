"""Event-time joins, the sink that holds batches once, state with timers, and the way back of replaced folders."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from orderly.sources import writers
from orderly.streaming import joins, processors

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def folder_stream(spark, path, schema):
    os.makedirs(path, exist_ok=True)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(path))


def add(spark, path, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={number}")


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


LEFT, RIGHT = "user long, l long, l_at timestamp", "user long, r long, r_at timestamp"


def test_interval_join_drops_state_and_gives_unmatched_rows(spark, tmp_path):
    left, right = (folder_stream(spark, tmp_path / n, s) for n, s in (("l", LEFT), ("r", RIGHT)))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    joined = joins.interval_join(left, right, "user", "l_at", "r_at", "10 minutes", "5 minutes", "leftOuter")
    batches = [
        ([(1, 1, at(0)), (1, 2, at(1)), (2, 3, at(2))], [(1, 10, at(5)), (1, 11, at(0)), (3, 12, at(3))]),
        ([(1, 4, at(100))], [(1, 13, at(11)), (2, 14, at(13))]),  # 13 is within ten minutes of 2, not of 1; 14 comes too late for 3
        ([(1, 5, at(101)), (9, 6, at(2))], [(1, 15, at(104))]),  # 6 is behind the watermark
        ([(7, 7, at(500))], [(7, 16, at(500))]),
        ([(7, 8, at(501))], [(7, 17, at(501))]),
    ]
    for number, (l_rows, r_rows) in enumerate(batches):
        add(spark, tmp_path / "l", number, l_rows, LEFT)
        add(spark, tmp_path / "r", number, r_rows, RIGHT)
        run(joins.exactly_once(joined, out, state))
    got = {(r.l, r.r) for r in joins.committed(spark, out, joined.schema).collect()}
    assert {(1, 10), (2, 10), (2, 13), (4, 15), (5, 15), (3, None)} <= got
    assert got <= {(1, 10), (2, 10), (2, 13), (4, 15), (5, 15), (3, None), (7, 17)} and not any(l == 6 for l, _ in got)


def test_batches_are_the_same_join_without_state(spark):
    left, right = spark.createDataFrame([(1, 1, at(0)), (2, 2, at(0))], LEFT), spark.createDataFrame([(1, 5, at(10)), (1, 6, at(11)), (1, 7, at(0))], RIGHT)
    rows = joins.interval_join(left, right, "user", "l_at", "r_at", "10 minutes", "1 minute").collect()
    assert [(r.user, r.l, r.r) for r in rows] == [(1, 1, 5)]


def test_a_repeated_batch_is_held_once(spark, tmp_path):
    """The sink fails behind its write, so the stream repeats that batch when it is started again."""
    add(spark, tmp_path / "in", 0, [(1,), (2,)], "v long")
    stream, out, state = folder_stream(spark, tmp_path / "in", "v long"), str(tmp_path / "out"), str(tmp_path / "state")

    def failing(batch, number):
        joins.put_batch(batch, number, out)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(stream.writeStream.option("checkpointLocation", state).foreachBatch(failing))
    assert joins.committed(spark, out, "v long").count() == 2
    run(joins.exactly_once(stream, out, state))
    add(spark, tmp_path / "in", 1, [(3,)], "v long")
    run(joins.exactly_once(stream, out, state))
    assert sorted((r.v, r.batch) for r in joins.committed(spark, out, "v long").collect()) == [(1, 0), (2, 0), (3, 1)]
    os.makedirs(f"{out}/_2-torn")
    spark.range(5).write.mode("overwrite").parquet(f"{out}/_2-torn")  # an attempt that never was moved into place
    assert joins.committed(spark, out, "v long").count() == 3


def test_nothing_committed_yet(spark, tmp_path):
    assert joins.committed(spark, str(tmp_path / "none"), "v long").collect() == []


EVALS = "run string, id long, ts timestamp, value double"


def monitor(spark, tmp_path, parts, **changed):
    stream, out, state = folder_stream(spark, tmp_path / "in", EVALS), str(tmp_path / "out"), str(tmp_path / "state")
    settings = {"late": "1 minute", "min_delta": 0.1, "patience": 3, "from_step": 2, "budget": 3600.0, "silence": 600.0} | changed
    seen = processors.monitored(stream, **settings)
    for number, rows in enumerate(parts):
        add(spark, tmp_path / "in", number, rows, EVALS)
        run(joins.exactly_once(seen, out, state, "update"))
    rows = joins.committed(spark, out, seen.schema).orderBy("run", "batch").collect()
    return {name: [(r.step, round(r.best, 3), r.stale, r.stopped_at, r.reason, round(r.elapsed)) for r in rows if r.run == name] for name in {r.run for r in rows}}


def test_head_only_steps_and_patience_over_restarts(spark, tmp_path):
    got = monitor(spark, tmp_path, [
        [("a", 1, at(0), 1.0), ("a", 2, at(1), 1.0), ("b", 1, at(0), 1.0)],
        [("a", 3, at(2), 0.95), ("a", 4, at(3), 0.8), ("b", 2, at(1), 0.5)],
        [("a", 5, at(4), 0.8), ("a", 6, at(5), 0.75), ("a", 7, at(6), 0.9), ("a", 8, at(7), 0.1)],
    ])
    assert got["a"][0] == (2, 1.0, 0, -1, "", 60)  # the second step is within the head-only phase
    assert got["a"][1] == (4, 0.8, 0, -1, "", 180)
    assert got["a"][-1] == (7, 0.8, 3, 7, "early_stopping", 360)  # and nothing after it counts
    assert got["b"][0] == (1, 1.0, 0, -1, "", 0)


def test_time_without_gaps_goes_on_after_restarts(spark, tmp_path):
    falling = lambda k: 100.0 - k
    got = monitor(spark, tmp_path, [[("a", k, at(k), falling(k)) for k in range(5)], [("a", 5, at(65), falling(5)), ("a", 6, at(70), falling(6))], [("a", 7, at(75), falling(7))]], budget=800.0)
    assert [g[-1] for g in got["a"] if g[4] != "silence"][:2] == [240, 540]  # the hour between is no time spent
    assert got["a"][-1][3:5] == (8, "wall_time_limit") and got["a"][-1][5] == 840


def test_silence_ends_a_run_by_a_timer(spark, tmp_path):
    got = monitor(spark, tmp_path, [[("a", 1, at(0), 1.0), ("b", 1, at(0), 1.0)], [("b", 2, at(9), 0.5), ("b", 3, at(18), 0.2)], [("a", 2, at(17), 0.5)]])
    assert [g[4] for g in got["a"]][:2] == ["", "silence"]
    assert got["a"][-1][:2] == (2, 0.5) or got["a"][-1][4] == "silence"  # rows behind the watermark are left out
    assert all(g[4] == "" for g in got["b"])


def test_first_source_falls_back_and_gives_changes_only(spark, tmp_path):
    schema = "key long, id long, source string, value double"
    stream, out, state = folder_stream(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "state")
    found = processors.first_source(stream, ("file", "status", "log"))
    parts = [
        [(1, 1, "log", 0.5), (1, 2, "log", 0.4), (2, 1, "other", 9.0)],
        [(1, 3, "log", 0.4), (2, 2, "status", 0.3)],
        [(1, 4, "status", 0.2), (1, 5, "log", 0.1)],
        [(1, 6, "log", 0.05), (1, 3, "status", 7.0)],
        [(1, 8, "file", 0.01), (2, 9, "status", None), (2, 8, "status", 0.25)],
    ]
    for number, rows in enumerate(parts):
        add(spark, tmp_path / "in", number, [r for r in rows if r[3] is not None], schema)
        run(joins.exactly_once(found, out, state, "update"))
    rows = joins.committed(spark, out, found.schema).orderBy("key", "batch").collect()
    assert [(r.batch, r.source, r.value) for r in rows if r.key == 1] == [(0, "log", 0.4), (2, "status", 0.2), (4, "file", 0.01)]
    assert [(r.batch, r.source, r.value) for r in rows if r.key == 2] == [(1, "status", 0.3), (4, "status", 0.25)]


def test_a_failing_move_leaves_the_old_folder(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    writers.publish(spark.range(3).select(F.col("id").cast("double").alias("v")), path)
    monkeypatch.setattr(writers, "moved", lambda files, new, target: False)
    with pytest.raises(OSError, match="could not move"):
        writers.publish(spark.range(2).select(F.col("id").cast("double").alias("v")), path)
    assert spark.read.json(path).count() == 3
