"""Sharding into k shards of nearly equal bytes by Karmarkar-Karp differencing of indivisible groups.

Rows with equal texts form a group, which stays together. Groups are summed first (one narrow row each, whatever the
number of copies) and dealt to buckets by a hash; in every bucket the differencing method keeps a heap of partial
partitions, combines the two of largest spread in opposite order, and ends with one partition into k parts. The
partitions of ``per_node`` buckets are combined in the same way, and those of as many such nodes, up to a single one: a
level's tasks see k sums for each node below them, and the parts are renamed by joins on the way down. Nothing but the
number of groups goes to the driver.

Null texts count no bytes and form one group with empty ones. Repeated rows are rows of their own, null ids too. Slots are dealt
within a shard over salted blocks of about ``block_rows``, so no shard and no group of copies is ranked in a single task. Input columns other
than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.session import materialize

SHARDS = 40
OVERHEAD = 16
PER_BUCKET = 20_000
PER_NODE = 500
BLOCK_ROWS = 65_536


def combine(partials: list[np.ndarray]) -> list[np.ndarray]:
    """For each partial partition (k sums in ascending order), the final part that each of its sums goes to. Partial
    partitions are combined two at a time, those of largest spread first, one in ascending and one in descending
    order of its sums."""
    sums = [np.asarray(p, np.int64) for p in partials]
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: dict[int, tuple[int, int, np.ndarray]] = {}
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(total, kind="stable").astype(np.int16)
        made[len(sums)] = (a, b, order)
        sums[a] = sums[b] = None
        sums.append(total[order])
        heapq.heappush(heap, (-int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    parts: list[np.ndarray | None] = [None] * len(sums)
    if sums:
        parts[-1] = np.arange(len(sums[-1]))
    for node in range(len(sums) - 1, -1, -1):
        if node in made:
            a, b, order = made[node]
            back = np.empty(len(order), np.int64)
            back[order] = parts[node]
            parts[a], parts[b] = back, back[::-1]
            parts[node] = None
    return parts[: len(partials)]


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, 0 to k - 1, of every size under k-way differencing. The parts' sums ascend."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    start = np.zeros((len(sizes), k), np.int64)
    start[:, -1] = sizes
    return np.array([p[-1] for p in combine(list(start))], np.int64)


def combined(parts: DataFrame, shards: int, per_node: int) -> DataFrame:
    """From (bucket, part, bytes): (bucket, part, shard), by differencing over the levels of a tree of buckets."""
    schema = "bucket long, part int, node long, up int, bytes long"

    def joined(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="bucket", columns="part", values="bytes").reindex(columns=range(shards)).fillna(0).sort_index()
        order = np.argsort(table.to_numpy(np.int64), axis=1, kind="stable")
        finals = combine(list(np.take_along_axis(table.to_numpy(np.int64), order, axis=1)))
        up = np.empty_like(order)
        np.put_along_axis(up, order, np.array(finals), axis=1)
        return pd.DataFrame(
            {"bucket": np.repeat(table.index.to_numpy(np.int64), shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(table)), "node": ids[0], "up": up.reshape(-1).astype(np.int32), "bytes": table.to_numpy(np.int64).reshape(-1)}
        )

    levels, current = [], parts
    while True:
        nodes = current.withColumn("node", F.floor(F.col("bucket") / per_node).cast("long"))
        levels.append(materialize(nodes.groupBy("node").applyInPandas(joined, schema)))
        current = levels[-1].groupBy(F.col("node").alias("bucket"), F.col("up").alias("part")).agg(F.sum("bytes").alias("bytes"))
        if levels[-1].select("node").distinct().limit(2).count() < 2:
            break
    names = levels[-1].select("bucket", "part", F.col("up").alias("shard"))
    for level in reversed(levels[:-1]):
        above = names.select(F.col("bucket").alias("node"), F.col("part").alias("up"), "shard")
        names = level.join(above, ["node", "up"]).select("bucket", "part", "shard")
    return names


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    overhead: int = OVERHEAD,
    per_bucket: int = PER_BUCKET,
    per_node: int = PER_NODE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("h"),
        )
    )
    groups = materialize(narrow.groupBy("h", "crc", "size").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    buckets = max(1, -(-groups.count() // per_bucket))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(5)), F.lit(buckets)))
    schema = T.StructType([*groups.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("part", T.IntegerType())])

    def parted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "h", "crc", "size"]).reset_index(drop=True)
        return group.assign(part=difference(group["bytes"].to_numpy(np.int64), shards).astype(np.int32))[schema.fieldNames()]

    placed = materialize(dealt.groupBy("bucket").applyInPandas(parted, schema))
    names = combined(placed.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")), shards, per_node)
    assigned = materialize(placed.join(names, ["bucket", "part"]).select("h", "crc", "size", "shard", "n"))
    cut = assigned.groupBy("shard").agg(F.ceil(F.sum("n") / block_rows).alias("blocks"))  # a row for each shard
    rows = narrow.join(assigned.drop("n"), ["h", "crc", "size"]).join(F.broadcast(cut), "shard")
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("id", "h", F.lit(11)), F.col("blocks"))).drop("blocks"))
    counts = rows.groupBy("shard", "block").count()
    first = counts.withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).drop("count")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "h")) - 1)
    return ranked.join(first, ["shard", "block"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("first") + F.col("rank")).cast("long").alias("slot"),
    )
