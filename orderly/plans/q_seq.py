"""Queries of sequence programs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderly.operators import frames as O
from orderly.operators import seqdp as D
from orderly.plans.base import frames, query, r6
from orderly.session import shared_dir
from orderly.sources.tables import table
from orderly.streaming import joins as SJ
from orderly.streaming import logs as L
from orderly.streaming import processors as SP


@query("FDP1_ctc_alignment")
def ctc_alignment(spark, sf):
    """Vectors in the order of their ids as emissions, blocks of 24 as utterances, aligned to four labels each."""
    e = table(spark, sf, "embeddings").withColumn("utt", F.floor(F.col("vec_id") / 24))
    rows = e.select("utt", F.col("vec_id").alias("frame"), F.col("embedding").alias("logp"), F.array(*[F.pmod(F.col("utt") * 7 + k * 5, F.lit(63)).cast("int") + 1 for k in range(4)]).alias("labels"))
    found = D.aligned_frames(rows, "utt", "labels")
    return found.select("utt", "frame", "state", "position", r6("score").alias("score"), "feasible")


@query("W15_targets")
def targets(spark, sf):
    """High and low targets of the gap-filled runs of every recording."""
    fr = frames(spark, sf).withColumn("st", 12 * F.log2(F.greatest(F.col("value"), F.lit(1.0)) / 100)).withColumn("on_", F.col("value") >= 1)
    runs = O.label_runs(fr, "on_").where("run_length >= 10").select("rec", "run", "t", F.col("st").alias("y"))
    return D.targets(runs, "rec").withColumns({c: r6(c) for c in ("time", "prominence", "start", "end")})


@query("early_stop", """WITH RECURSIVE {FR}, st AS (SELECT DISTINCT rec, 0::BIGINT AS i, 'Infinity'::DOUBLE AS best, 0 AS stale, -1::BIGINT AS stopped FROM fr
  UNION ALL SELECT s.rec, f.i, CASE WHEN s.stopped < 0 AND f.value < s.best - 0.5 THEN f.value ELSE s.best END, CASE WHEN s.stopped >= 0 THEN s.stale WHEN f.value < s.best - 0.5 THEN 0 ELSE s.stale + 1 END,
    CASE WHEN s.stopped >= 0 THEN s.stopped WHEN f.value >= s.best - 0.5 AND s.stale + 1 >= 8 THEN f.i ELSE -1 END FROM st s JOIN fr f ON f.rec = s.rec AND f.i = s.i + 1)
SELECT rec, round(best, 6) AS best, stale::INT AS stale, stopped AS stopped_at FROM st QUALIFY row_number() OVER (PARTITION BY rec ORDER BY i DESC) = 1""")
def early_stop(spark, sf):
    """Events of a user as evaluations: the value is the loss."""
    fr = frames(spark, sf).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("step"), "value"))).alias("p"))
    return fr.select("rec", L.early_stop_fold(F.col("p"), 0.5, 8).alias("s")).select("rec", r6("s.best").alias("best"), "s.stale", "s.stopped_at")


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/events.parquet*")


def drained(spark, stream, mode: str, keys: tuple[str, ...] = ()):
    """Everything that a stream has at hand, run to its end. In update mode every trigger appends the rows that it
    changed, and the last version of each key counts; state behind the watermark is dropped. In complete mode (session windows, which
    have no update mode) the sink keeps the last version of the whole result."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch, number):
        batch.withColumn("__trigger", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(sink).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    if mode == "complete":
        return out.drop("__trigger")
    names = [c for c in out.columns if c not in (*keys, "__trigger")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*names), "__trigger").alias("last")).select(*keys, "last.*")


@query("stream_tumbling", """SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1""")
def stream_tumbling(spark, sf):
    windows = L.tumbling(event_stream(spark, sf).select("ts", "value"), "ts", "1 hour", "1 day", "value")
    out = drained(spark, windows, "update", ("start",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("total").alias("total"))


@query("stream_sliding", """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP - k * INTERVAL '1 hour' AS start, value FROM events, (SELECT unnest(range(0, 3)) AS k))
SELECT start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY start""")
def stream_sliding(spark, sf):
    windows = L.sliding(event_stream(spark, sf).select("ts", "value"), "ts", "3 hours", "1 hour", "1 day", "value")
    out = drained(spark, windows, "update", ("start",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("total").alias("total"))


@query("K9_append_log", """SELECT user_id, event_id, event_type FROM events""")
def append_log(spark, sf):
    """The events as a JSON log that only grows, written by a stream and tailed by another one."""
    base = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    L.append_log(event_stream(spark, sf).select("user_id", "event_id", "event_type"), f"{base}/log", f"{base}/one").trigger(availableNow=True).start().awaitTermination()
    tailed = L.tail(spark, f"{base}/log", "user_id long, event_id long, event_type string", 100)
    tailed.writeStream.format("parquet").trigger(availableNow=True).option("path", f"{base}/out").option("checkpointLocation", f"{base}/two").start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_session", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP + INTERVAL '2 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf):
    found = L.sessions(event_stream(spark, sf).select("user_id", "ts"), "user_id", "ts", "2 hours", "1 day")
    out = drained(spark, found, "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_latest", """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_latest(spark, sf):
    out = drained(spark, L.latest(event_stream(spark, sf).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id"), "update", ("user_id",))
    return out.select("user_id", "event_id", "event_type", r6("value").alias("value"))


@query("stream_changes", """WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS was, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, event_type FROM e WHERE coalesce(over_, 0) = 0 AND event_type IS DISTINCT FROM was""")
def stream_changes(spark, sf):
    """The states of every user as they change, until the first error."""
    rows = event_stream(spark, sf).select("user_id", "event_id", "event_type")
    return drained(spark, L.changes(rows, "user_id", "event_id", "event_type", ("error",)), "append", ("user_id", "event_id"))


@query("stream_event_join", """SELECT c.user_id, c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL '3 hours'
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_event_join(spark, sf):
    """Purchases within three hours of a click of the same user: both streams in event time, into the sink that holds every batch once."""
    rows = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("clicked"))
    purchases = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("bought"))
    pairs = SJ.interval_join(clicks, purchases, "user_id", "clicked", "bought", "3 hours", "1 day").select("user_id", "click", "purchase")
    base = f"{shared_dir(spark)}/join-{uuid.uuid4().hex}"
    SJ.exactly_once(pairs, f"{base}/out", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return SJ.committed(spark, f"{base}/out", pairs.schema).drop("batch")


def restarted(spark, parts, build, keys):
    """The last version of each key that a stream gives when parts arrive as one file folder each, and it is started anew for every part from the state it
    had left."""
    base = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    for number, part in enumerate(parts):
        part.write.parquet(f"{base}/in/part={number}")
        stream = build(spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in"))
        SJ.exactly_once(stream, f"{base}/out", f"{base}/state", "update").trigger(availableNow=True).start().awaitTermination()
    out = SJ.committed(spark, f"{base}/out", stream.schema)
    names = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("last")).select(*keys, "last.*")


@query("stream_early_stop", """WITH RECURSIVE e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6::DOUBLE AS moment, value FROM events),
st AS (SELECT DISTINCT run, 0::BIGINT AS i, NULL::DOUBLE AS moment, 'Infinity'::DOUBLE AS best, 0::BIGINT AS stale, -1::BIGINT AS stopped, 0.0::DOUBLE AS elapsed FROM e
  UNION ALL SELECT run, i, moment, best, stale, CASE WHEN stale >= 8 OR elapsed >= 1209600 THEN i ELSE -1 END, elapsed FROM (
    SELECT s.run, e.i, e.moment, CASE WHEN e.value < s.best - 0.5 THEN e.value ELSE s.best END AS best,
      CASE WHEN e.value < s.best - 0.5 THEN 0 WHEN e.i > 5 THEN s.stale + 1 ELSE s.stale END AS stale,
      s.elapsed + CASE WHEN e.moment - s.moment <= 172800 THEN e.moment - s.moment ELSE 0 END AS elapsed
    FROM st s JOIN e ON e.run = s.run AND e.i = s.i + 1 WHERE s.stopped < 0)),
l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY run ORDER BY i DESC) = 1)
SELECT run, i AS step, round(best, 6) AS best, stale, stopped AS stopped_at, CASE WHEN stale >= 8 THEN 'early_stopping' WHEN stopped >= 0 THEN 'wall_time_limit'
  WHEN moment + 172800 <= (SELECT max(moment) FROM e) - 3600 THEN 'silence' ELSE '' END AS reason, round(elapsed, 3) AS elapsed FROM l""")
def stream_early_stop(spark, sf):
    """Events of a user as evaluations of a run, with five steps before staleness counts, a budget of two weeks without gaps over two days, and an end on silence. The stream is started anew
    in the middle."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    middle = rows.agg(F.expr("timestamp_micros(bigint((min(unix_micros(ts)) + max(unix_micros(ts))) / 2))").alias("m")).first()["m"]
    parts = [rows.where(F.col("ts") <= F.lit(middle)), rows.where(F.col("ts") > F.lit(middle))]
    found = restarted(spark, parts, lambda s: SP.monitored(s, "1 hour", 0.5, 8, 5, 14 * 86_400.0, 2 * 86_400.0), ("run",))
    return found.select("run", "step", r6("best").alias("best"), "stale", "stopped_at", "reason", F.round("elapsed", 3).alias("elapsed"))


@query("stream_fallback", """WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT user_id AS key, event_type AS source, round(v, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END) = 1""")
def stream_fallback(spark, sf):
    """The last value of every user: of the signups if there is one, else of the purchases, else of the clicks. The stream is started anew in the middle."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("source"), "value")
    middle = rows.agg(F.expr("(min(id) + max(id)) / 2").alias("m")).first()["m"]
    found = restarted(spark, [rows.where(F.col("id") <= middle), rows.where(F.col("id") > middle)], lambda s: SP.first_source(s, ("signup", "purchase", "click")), ("key",))
    return found.select("key", "source", r6("value").alias("value"))


@query("latest_snapshot", """SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1""")
def latest_snapshot(spark, sf):
    return L.latest(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")


@query("ranked_runs", """WITH {FR}, c AS (SELECT rec, kind, count(*) AS n FROM fr GROUP BY 1, 2) SELECT rec, kind, n, row_number() OVER (PARTITION BY rec ORDER BY n DESC, kind)::INT AS r FROM c QUALIFY row_number() OVER (PARTITION BY rec ORDER BY n DESC, kind) <= 2""")
def ranked_runs(spark, sf):
    c = frames(spark, sf).groupBy("rec", "kind").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("n"), "kind"))).where("r <= 2")
