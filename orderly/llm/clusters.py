"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors become integers, floor(scale * component). In every round a task tabulates, for each dimension, the squared difference of every
integer value that occurs there to every centroid's component; distances to all centroids are gathers from these small
tables and their sums. What leaves a task are a sum for each centroid and dimension and counts, so a round moves k x d numbers a task
whatever the number of vectors or of copies of one vector, and only k x d sums reach the driver.

All arithmetic is exact: 64-bit integers where the values are small enough, Python integers otherwise. Integers beyond 64 bits and distances
or inertias beyond them saturate. Vectors of another length and those with null or non-finite components are left out; a null
id is hashed as an empty string and kept. Repeated rows count as often as they are there; equal hashes of ids go by the components. With fewer vectors than k there are as
many centroids as vectors; an empty table gives no rows. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderly.session import bounded_batches, materialize

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SMALL = 2**27  # up to here, sums of 64 squared differences fit 62 bits
MOST = 2**63 - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v) with v as integers, of the vectors that are whole."""
    whole = (F.size(vec_col) == dimensions) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(whole).select(F.col(id_col).alias("id"), value.alias("v"))


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the least hashes of their ids."""
    hashed = rows.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256).alias("h"), "v")
    return [list(r["v"]) for r in hashed.orderBy("h", "v").limit(k).collect()]


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors by centroids, gathered from a table for each dimension."""
    exact = np.int64 if max(np.abs(vectors.astype(float)).max(initial=0), np.abs(centroids.astype(float)).max(initial=0)) <= SMALL else object
    out = np.zeros((len(vectors), len(centroids)), exact)
    for j in range(vectors.shape[1]):
        occurring, place = np.unique(vectors[:, j], return_inverse=True)
        table = (occurring.astype(exact)[:, None] - centroids[:, j].astype(exact)[None, :]) ** 2
        out += table[place]
    return out


def matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floors of their vectors' means, those without vectors as they were."""
    k, d = len(centroids), len(centroids[0])
    places = np.array(centroids, object)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d), object), np.zeros(k, np.int64)
        for batch in batches:
            vectors = matrix(batch.column("v"), d)
            if len(vectors):
                nearest = distances(vectors, places).argmin(axis=1)
                wide = object if np.abs(vectors.astype(float)).max() > SMALL else np.int64
                for c in np.unique(nearest):
                    sums[c] += vectors[nearest == c].astype(wide).sum(axis=0).astype(object)
                counts += np.bincount(nearest, minlength=k)
        at = np.flatnonzero(np.repeat(counts, d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array([Decimal(int(x)) for x in sums.reshape(-1)[at]], pa.decimal128(38, 0)), pa.array(np.repeat(counts, d)[at], pa.int64())], ["at", "total", "n"]
        )

    parts = rows.select("v").mapInArrow(summed, "at long, total decimal(38,0), n long")
    out = np.array(centroids, object).reshape(-1)
    for r in parts.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k x d rows
        out[r["at"]] = int(r["total"]) // r["n"]
    return out.reshape(k, d).tolist()


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of every vector, the smaller number among equally near ones."""
    d = len(centroids[0])
    places = np.array(centroids, object)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(matrix(batch.column("v"), d), places)
                best = far.argmin(axis=1)
                least = [min(int(x), MOST) for x in far[np.arange(len(best)), best]]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["id", "cluster", "distance"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(nearest, f"id {id_type}, cluster int, distance long")


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS
) -> DataFrame:
    """One row per kept vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = integers(vectors, id_col, vec_col, dimensions, scale)
    centroids = first_centroids(rows, k)
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], f"{id_col} {rows.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    assigned = materialize(assign(rows, centroids))
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = min(sum(sums.values()), MOST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(c, min(sums.get(c, 0), MOST), inertia, h) for c, h in enumerate(digest)], schema)  # k rows
    joined = assigned.join(F.broadcast(table), "cluster")
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
