"""Findings of the third round: results to the last bit, archives in many files, runs kept as state."""

import base64
import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.functions import scalar as S
from orderly.operators import frames
from orderly.sources import archives


def test_base64_of_long_texts_is_one_line(spark):
    text = "é" * 200
    found = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(S.base64_text(F.col("t"))).collect()
    assert [r[0] for r in found] == [base64.b64encode(text.encode()).decode(), None, ""]


def test_log_bounds_are_those_of_the_c_library(spark):
    """Java's exp(log(v)) is off by one bit less or more at these values, so v would lie within a bound that it lies beyond, or the reverse."""
    for v in (200.0625, 200.1125, 200.205, 200.31):
        rows = spark.createDataFrame([(v,)] * 3, "f double")
        bounds = frames.log_bounds(rows)
        want = math.exp(math.log(v))
        assert bounds.first()["lo"] == bounds.first()["hi"] == want
        assert [r.saturated for r in frames.five_level(rows, bounds).collect()] == [v != want] * 3


def test_log_bounds_between_values_and_without_any(spark):
    rows = spark.createDataFrame([(100.0 + k,) for k in range(11)] + [(None,), (0.0,)], "f double")
    bounds = frames.log_bounds(rows).first()
    assert bounds["lo"] == math.exp(math.log(100) * 0.5 + math.log(101) * 0.5) and len(bounds["edges"]) == 6
    empty = frames.log_bounds(rows.where("f < 0")).first()
    assert (empty["lo"], empty["hi"], empty["edges"]) == (None, None, None)


def test_means_are_added_up_in_order(spark):
    """The sum of these is 4.8 in one order and a bit less in others."""
    values = [0.7, 0.1, 0.3, 0.2, 0.6, 0.4, 0.9, 0.1, 0.5, 0.4, 0.3, 0.3]
    for order in (values, values[::-1], sorted(values), sorted(values)[::-1]):
        total = 0.0
        for v in order:
            total += v
        rows = [(k, v) for k, v in enumerate(order)]
        rows = rows[1::2] + rows[::2][::-1] + [(50, None)]
        assert spark.createDataFrame(rows, "i long, v double").repartition(5).agg(S.ordered_avg("v", "i")).first()[0] == total / 12


def test_many_small_archives_share_partitions(tmp_path, monkeypatch):
    """Planning opens none of them, and the tasks are far fewer than the files."""
    monkeypatch.setattr(archives, "FEW", 20)
    monkeypatch.setattr(archives, "BUNDLE_FILES", 30)
    for k in range(100):
        np.savez_compressed(tmp_path / f"{k:03d}.npz", t=np.arange(k % 4) + 10.0 * k)
    np.savez(tmp_path / "zz.npz", t=np.arange(300_000.0))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), T.StructField("t", T.DoubleType())])
    source = archives.ArchiveReader({"path": str(tmp_path), "rowsPerPartition": "100000"}, schema)
    opened, true = [], archives.ArchiveReader.opened
    monkeypatch.setattr(archives.ArchiveReader, "opened", lambda self, f, size: (opened.append(1), true(self, f, size))[1])
    parts = source.partitions()
    assert len(opened) == 1 and len(parts) == 4 + 3  # four bundles, and the large one in three ranges
    rows = [r for p in parts for b in source.read(p) for r in b.to_pylist()]
    small = [(r["path"][-7:-4], r["row"], r["t"]) for r in rows if not r["path"].endswith("zz.npz")]
    assert small == [(f"{k:03d}", i, 10.0 * k + i) for k in range(100) for i in range(k % 4)]
    assert [r["t"] for r in rows if r["path"].endswith("zz.npz")] == list(range(300_000))


def test_archives_are_written_by_many_tasks(spark, tmp_path):
    df = spark.range(64).select((F.col("id") % 16).alias("k"), F.floor(F.col("id") / 16).alias("at"), F.col("id").cast("double").alias("v"))
    seen = []
    true = archives.materialize
    archives.materialize = lambda d: (seen.append(d.select(F.spark_partition_id()).distinct().count()), true(d))[1]
    try:
        archives.write_archives(df, "k", "at", ["v"], str(tmp_path / "out"), 4)
    finally:
        archives.materialize = true
    assert seen[0] > 1 and len(list((tmp_path / "out").iterdir())) == 16


def test_state_comes_with_the_rows_of_a_key(spark, tmp_path):
    """No calls to the state store for each key: the time of these streams went with the number of keys."""
    from orderly.streaming import processors

    rows = spark.readStream.schema("key long, run long, id long, source string, value double, ts timestamp").parquet(str(tmp_path))
    for found in (processors.first_source(rows, ("a", "b")), processors.monitored(rows.select("run", "id", "ts", "value"), "1 hour", 0.5, 8, 5, 9.0, 9.0)):
        plan = found._jdf.queryExecution().logical().toString()
        assert "WithState" in plan and "TransformWithState" not in plan


def test_scores_do_not_depend_on_the_pieces_worked_on(monkeypatch):
    from orderly.llm import contextmix as cm

    rng = np.random.default_rng(1)
    units = [(int(rng.integers(cm.CLASSES)), bytes(rng.integers(97, 110, int(rng.integers(1, 9))).astype(np.uint8))) for _ in range(500)]
    seen = rng.integers(0, 9, cm.SLOTS).astype(np.float32)
    model = cm.Mixer(seen, np.floor(seen / 2))
    whole, widths, true = model.log10(units), [], cm.bases
    monkeypatch.setattr(cm, "PIECE", 100)
    monkeypatch.setattr(cm, "bases", lambda keys: (widths.append(len(keys)), true(keys))[1])
    assert np.array_equal(model.log10(units), whole) and max(widths) == 100
