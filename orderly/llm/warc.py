"""Fixity audit of WARC replicas by Merkle trees.

Pages become WARC records, laid end to end in files of ``per_file`` ids, in the order of their ids. A record's bytes are
hashed; ranges of ``range_bytes`` of a file's offsets hash the (offset, digest) pairs of the records that begin in
them, in order; every ``fanout`` nodes are hashed into one above them until a file has a single root. Two replicas are compared by
their roots, and only the children of nodes that differ are compared further, down to ranges and then to records. A
record is ``changed``, ``missing`` (not in the replica), ``extra`` (only there) or, where its range was never opened
or it compares equal, ``ok``.

Everything is a DataFrame operation on digests: record bytes are hashed where they are read and never shuffled, and
nothing but the trees' height goes to the driver. Equal records of an id are laid out as one entry with their number, and
a file with many more records than ids (an id of many versions, or pages without an id) is cut into volumes, so that no page
makes a larger group than another. Null urls and pages count as empty; pages without an id are file -1.
Repeated rows are records of their own. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderly.session import materialize

PER_FILE = 1024
RANGE_BYTES = 65_536
FANOUT = 8


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC resource record, as text."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = PER_FILE, stored: Column | None = None) -> DataFrame:
    """The index of a replica: id, file, volume, offset, length, digest. stored: the bytes found in the replica's record, from
    the columns id and record (none where the record is lost); by default the record as it was written."""
    rows = pages.select(F.col(id_col).alias("id"), record(F.col(id_col), F.col(url_col), F.col(html_col)).alias("record"))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("id") / per_file), F.lit(-1)).cast("long"))
    rows = rows.select(
        "id",
        "file",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2(F.col("record").cast("binary"), 256).alias("written"),
        F.sha2((F.col("record") if stored is None else stored).cast("binary"), 256).alias("digest"),
    )
    entries = materialize(rows.groupBy("id", "file", "length", "written", "digest").agg(F.count("*").alias("copies")))
    cut = materialize(entries.groupBy("file").agg(F.ceil(F.count("*") / (4 * per_file)).alias("volumes")))
    volume = F.pmod(F.xxhash64("id", "written"), F.col("volumes")).cast("int")
    before = Window.partitionBy("file", "volume").orderBy("id", "written").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.col("length") * F.col("copies")
    placed = entries.join(cut, "file").withColumn("volume", volume).withColumn("offset", F.sum(span).over(before) - span)
    found = placed.where("digest IS NOT NULL").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return found.select("id", "file", "volume", (F.col("offset") + F.col("copy") * F.col("length")).alias("offset"), "length", "digest")


FILE = ["file", "volume"]


def hashed(nodes: DataFrame, below: str, node: Column) -> DataFrame:
    """file, volume, node and the digest over the nodes (or records) below it, in their order."""
    pairs = F.sort_array(F.collect_list(F.struct(below, "digest")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p[below].cast("string"), p["digest"])), "\n")
    return nodes.groupBy(*FILE, node.alias("node")).agg(F.sha2(text, 256).alias("digest"))


def ranges(index: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lowest nodes: one for the records that begin in each range."""
    return hashed(index, "offset", F.floor(F.col("offset") / range_bytes))


def above(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes over every ``fanout`` nodes."""
    return hashed(nodes, "node", F.floor(F.col("node") / fanout))


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys under which the two sides' digests differ or one is absent."""
    both = left.select(*keys, F.col("digest").alias("l")).join(right.select(*keys, F.col("digest").alias("r")), keys, "full_outer")
    return both.where(~F.col("l").eqNullSafe(F.col("r")))


def locate(index: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """file, volume, offset, l and r (the two digests) of every record that differs, found from the roots down. Every level
    of the two trees is written once."""
    deepest = index.select("offset").unionByName(replica.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = [[materialize(ranges(side, range_bytes)) for side in (index, replica)]]
    most = deepest // range_bytes
    while most > 0:
        levels.append([materialize(above(nodes, fanout)) for nodes in levels[-1]])
        most //= fanout
    bad = materialize(differing(*levels[-1], [*FILE, "node"]).select(*FILE, "node"))
    for below in reversed(levels[:-1]):
        parents = bad.withColumnRenamed("node", "parent")
        opened = [nodes.withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, [*FILE, "parent"], "left_semi") for nodes in below]
        bad = materialize(differing(*opened, [*FILE, "node"]).select(*FILE, "node"))
    records = [side.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, [*FILE, "node"], "left_semi") for side in (index, replica)]
    return differing(*records, [*FILE, "offset"])


def audit(index: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per record of either side: id, file, volume, offset, length, digest, replica_digest, verdict."""
    index, replica = materialize(index), materialize(replica)
    found = materialize(locate(index, replica, range_bytes, fanout))
    place = [*FILE, "offset"]
    verdict = F.when(F.col("n").isNull(), "ok").when(F.col("r").isNull(), "missing").otherwise("changed")
    names = ["id", *place, "length"]
    known = index.join(found.withColumn("n", F.lit(1)), place, "left").select(
        *names, "digest", F.when(F.col("n").isNull(), F.col("digest")).otherwise(F.col("r")).alias("replica_digest"), verdict.alias("verdict")
    )
    only = found.where("l IS NULL").join(replica, place).select(*names, F.lit(None).cast("string").alias("digest"), F.col("digest").alias("replica_digest"), F.lit("extra").alias("verdict"))
    return known.unionByName(only)
