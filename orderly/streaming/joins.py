"""Joins of two streams in event time, and a sink that holds every batch once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderly.sources.writers import replace_folder


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, after: str, late: str, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys where the right one comes later than the left one, by ``after`` at most. Both sides carry a watermark of ``late``, from
    which Spark derives when a row can find no partner any more: a left row leaves the state once the watermark has passed its time and ``after``, a right row
    once it has passed its time. With how="leftOuter" a left row without partner comes out at that moment. Columns other than the key must
    differ. Batches give the same rows without any state."""
    one = left.withWatermark(left_at, late).withColumnRenamed(key, "__left")
    two = right.withWatermark(right_at, late).withColumnRenamed(key, "__right")
    soon = (F.col(right_at) > F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {after}"))
    return one.join(two, (F.col("__left") == F.col("__right")) & soon, how).withColumnRenamed("__left", key).drop("__right")


def put_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write one batch of a stream as the folder batch=<number> under path. The folder appears whole, and in place of an earlier one of that number."""
    fresh = f"{path.rstrip('/')}/_{number}-{uuid.uuid4().hex}"
    batch.write.parquet(fresh)
    replace_folder(batch.sparkSession, fresh, f"{path.rstrip('/')}/batch={number}")


def exactly_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A writer that leaves every batch of a stream once under path, however often batches are repeated after failures: a repeated batch has the
    number it had and replaces what the first attempt left. Read it with committed()."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: put_batch(batch, number, path))


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """What exactly_once() has written, with the number of the batch; unfinished attempts are hidden by their names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    return spark.read.option("basePath", path).schema(schema).parquet(path).withColumn("batch", F.col("batch").cast("long"))
