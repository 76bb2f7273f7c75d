"""Queries that join: nearest in time, intervals, look-ups, semi and anti joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderly.functions import scalar as S
from orderly.operators import intervals as I
from orderly.operators.checks import manifest_diff
from orderly.operators.quantiles import exact_by
from orderly.operators.seqdp import edit_operations
from orderly.plans.base import EPOCH_US, frames, micros, query, r6, tokens
from orderly.sources.tables import table


@query("J1_asof", f"""WITH o AS (SELECT o_custkey AS k, o_orderkey AS ok, epoch_us(o_orderdate) AS ot, o_totalprice AS p FROM orders),
e AS (SELECT l_orderkey AS lk, l_linenumber AS ln, l_suppkey AS k, epoch_us(l_shipdate) AS et FROM lineitem GROUP BY ALL)
SELECT lk, ln, ok, round(p, 6) AS price FROM (SELECT e.*, o.ok, o.p, row_number() OVER (PARTITION BY lk, ln, e.k, et ORDER BY ot DESC NULLS LAST, ok DESC) AS r
  FROM e LEFT JOIN o ON o.k = e.k AND o.ot <= e.et) WHERE r = 1""")
def asof(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ok"), micros(F.col("o_orderdate")).alias("ot"), F.col("o_totalprice").alias("p"))
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("lk"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("k"), micros(F.col("l_shipdate")).alias("et")).distinct()
    return I.asof(e, o, "k", "et", "ot", "ok").select("lk", "ln", "ok", r6("p").alias("price"))


@query("J2_nearest_tolerance", """WITH {FR}, g AS (SELECT rec, i AS k, i * 0.01::DOUBLE + (eid % 10 - 4) * 0.001::DOUBLE AS t2, value AS v2 FROM fr)
SELECT fr.rec, fr.i, round(CASE WHEN abs(t2 - t) <= 0.0041::DOUBLE THEN v2 END, 6) AS v2, coalesce(abs(t2 - t) <= 0.0041::DOUBLE, false) AS matched
FROM fr LEFT JOIN g ON g.rec = fr.rec AND g.k = round_even(fr.t / 0.01::DOUBLE, 0)::BIGINT""")
def nearest(spark, sf):
    fr = frames(spark, sf)
    grid = fr.select("rec", F.col("i").alias("k"), (F.col("i") * F.lit(0.01) + (F.col("eid") % 10 - 4) * F.lit(0.001)).alias("t2"), F.col("value").alias("v2"))
    return I.nearest_on_grid(fr.select("rec", "i", "t"), grid, "rec", 0.01, 0.0041).select("rec", "i", r6("v2").alias("v2"), "matched")


@query("J3_range", """WITH {FR}, {TOK} SELECT tok.rec, tok, count(*) AS n, round(sum(value), 6) AS total FROM tok JOIN fr ON fr.rec = tok.rec AND t >= a AND t < b GROUP BY tok.rec, tok""")
def range_join(spark, sf):
    fr = frames(spark, sf)
    found = I.in_intervals(fr.select("rec", "t", "value"), tokens(fr), "rec", "t", "a", "b", 0.2)
    return found.groupBy("rec", "tok").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("J5_point_in_interval", """WITH {FR}, {TOK}, s AS (SELECT rec, tok, a, a + 0.2::DOUBLE AS b FROM tok)
SELECT fr.rec, fr.i, s.tok FROM fr LEFT JOIN s ON s.rec = fr.rec AND t >= a AND t < b QUALIFY row_number() OVER (PARTITION BY fr.rec, fr.i ORDER BY s.tok) = 1""")
def point_in_interval(spark, sf):
    """Intervals overlap here: the first that holds a point counts."""
    fr = frames(spark, sf)
    long = tokens(fr).withColumn("b", F.col("a") + F.lit(0.2))
    return I.first_in_intervals(fr.select("rec", "i", "t"), long, "rec", "t", "a", "b", 0.2, "tok").select("rec", "i", "tok")


@query("J6_zip", """WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT u.conv_id, u.k, length(u.text)::BIGINT AS asked, length(a.text)::BIGINT AS said FROM c u JOIN c a ON a.conv_id = u.conv_id AND a.k = u.k WHERE u.role = 'user' AND a.role = 'assistant'""")
def zipped(spark, sf):
    c = table(spark, sf, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long"))
    u = c.where("role = 'user'").select("conv_id", "k", F.length("text").cast("long").alias("asked"), (F.col("k") % 2).alias("parity"))
    a = c.where("role = 'assistant'").select("conv_id", "k", F.length("text").cast("long").alias("said"), (F.col("k") % 2).alias("parity"))
    return I.zip_positions(u, a, ["conv_id", "k"], ["parity"]).drop("parity")


@query("J7_left_default", """SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def left_default(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("J8_must_hit", """SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def must_hit(spark, sf):
    n = F.broadcast(table(spark, sf, "nation"))  # a fixed dimension of 25 rows
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))


@query("J12_leak", """SELECT t.doc_id FROM documents t SEMI JOIN (SELECT text FROM documents WHERE doc_id % 10 = 0) v ON v.text = t.text WHERE t.doc_id % 10 <> 0""")
def leak(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    held = docs.where("doc_id % 10 = 0").select("h").distinct()
    return docs.where("doc_id % 10 != 0").join(held, "h", "left_semi").select("doc_id")


@query("J12_coverage", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT DISTINCT w FROM w WHERE doc_id % 10 = 0 AND w NOT IN (SELECT w FROM w WHERE doc_id % 10 <> 0)""")
def coverage(spark, sf):
    """Words of the held-out documents that the others lack."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w"))
    sides = words.groupBy("w").agg(F.bool_and(F.col("doc_id") % 10 == 0).alias("only"))  # one pass, and no word is joined
    return sides.where("only").select("w")


@query("J13_manifest_diff", """WITH l AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents WHERE doc_id % 50 <> 1),
r AS (SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 50 = 2 THEN sha256(text || '.') ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 50 = 3 THEN strlen(text)::BIGINT + 1 ELSE strlen(text)::BIGINT END AS bytes FROM documents WHERE doc_id % 50 <> 4)
SELECT * FROM (SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'unexpected' WHEN l.bytes <> r.bytes THEN 'size' WHEN l.sha256 <> r.sha256 THEN 'hash' END AS problem
FROM l FULL JOIN r ON l.path = r.path) WHERE problem IS NOT NULL""")
def manifests(spark, sf):
    d = table(spark, sf, "documents")
    path, size = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long")
    k = F.col("doc_id") % 50
    left = d.where(k != 1).select(path, F.sha2("text", 256).alias("sha256"), size.alias("bytes"))
    right = d.where(k != 4).select(path, F.sha2(F.when(k == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"), F.when(k == 3, size + 1).otherwise(size).alias("bytes"))
    return manifest_diff(left, right)


@query("J14_proximity", """WITH {FR} SELECT rec, i, bool_or(kind = 'error') OVER (PARTITION BY rec ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND 7200000000 FOLLOWING) AS near FROM fr""")
def proximity(spark, sf):
    fr = frames(spark, sf).withColumn("bad", F.col("kind") == "error")
    return I.near_flag(fr, "rec", "us", "bad", 7_200_000_000).select("rec", "i", "near")


@query("J15_pairs", """SELECT count(*) AS n, round(sum(l_quantity), 6) AS q FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))""")
def pairs(spark, sf):
    wanted = spark.sql("SELECT * FROM VALUES ('A', 'F'), ('N', 'O') AS t(l_returnflag, l_linestatus)")
    hit = table(spark, sf, "lineitem").join(F.broadcast(wanted), ["l_returnflag", "l_linestatus"], "left_semi")
    return hit.agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("q"))


@query("J16_edit_alignment")
def edit_alignment(spark, sf):
    """Positions of all words of neighbouring texts aligned by edit operations."""
    docs = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    both = docs.join(docs.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    kind = "array<struct<op:string,i:int,j:int>>"

    @F.pandas_udf(kind)
    def ops(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": o, "i": i, "j": j} for o, i, j in edit_operations(list(x), list(y))] for x, y in zip(a, b, strict=True)])

    return both.withColumn("o", F.explode(ops("w", "v"))).select("item_id", "o.*")


@query("T5_tiling", """WITH {FR}, {TOK}, s AS (SELECT rec, tok, a AS xmin, a + 0.07::DOUBLE AS xmax FROM tok), e AS (SELECT rec, max(t) + 1 AS stop FROM fr GROUP BY rec),
g AS (SELECT s.rec, coalesce(lag(xmax) OVER (PARTITION BY s.rec ORDER BY xmin), 0) AS lo, xmin AS hi FROM s UNION ALL SELECT s.rec, max(xmax), max(stop) FROM s JOIN e ON e.rec = s.rec GROUP BY s.rec)
SELECT rec, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, tok::VARCHAR AS label FROM s UNION ALL SELECT rec, round(lo, 6), round(hi, 6), '' FROM g WHERE hi > lo""")
def tiling(spark, sf):
    fr = frames(spark, sf)
    spans = tokens(fr).select("rec", F.col("tok").cast("string").alias("label"), F.col("a").alias("s"), (F.col("a") + F.lit(0.07)).alias("e"))
    spans = spans.join(fr.groupBy("rec").agg((F.max("t") + 1).alias("stop")), "rec")
    tiles = I.tiling(spans, "rec", "s", "e", "label", F.lit(0.0), F.col("stop"))
    return tiles.select("rec", r6("xmin").alias("xmin"), r6("xmax").alias("xmax"), "label")


@query("A21_union", """WITH x AS (SELECT o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS s, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 60 AS e FROM orders),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT k, count(*) AS islands, sum(b - a)::BIGINT AS length FROM (SELECT k, isl, min(s) AS a, max(e) AS b FROM i GROUP BY k, isl) GROUP BY k""")
def union_length(spark, sf):
    day = F.floor(micros(F.col("o_orderdate")) / F.lit(86_400_000_000)).cast("long")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), day.alias("s"), (day + F.col("o_orderkey") % 60).alias("e"))
    return I.union_length(rows, "k", "s", "e")


@query("W24_offsets", """SELECT conv_id, turn, (sum(length(text)) OVER w - length(text))::BIGINT AS start, (sum(length(text)) OVER w)::BIGINT AS "end" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def offsets(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return I.offsets(c, "conv_id", "turn", "n").select("conv_id", "turn", "start", "end")


@query("P2_agreement", """WITH {FR}, g AS (SELECT rec, i, lag(f) OVER (PARTITION BY rec ORDER BY i) AS f2, f FROM fr)
SELECT rec, count(*) FILTER (WHERE f > 0 AND f2 > 0 AND abs(12 * log2(f2 / f)) <= 1) AS required, count(*) FILTER (WHERE f > 0 AND NOT coalesce(abs(12 * log2(f2 / f)) > 1, false)) AS not_rejected FROM g GROUP BY rec""")
def agreement(spark, sf):
    fr = frames(spark, sf).withColumn("f2", F.lag("f").over(Window.partitionBy("rec").orderBy("i")))
    apart = F.abs(S.cents(F.col("f2"), F.col("f"))) / 100
    require = (F.col("f") > 0) & (F.col("f2") > 0) & (apart <= 1)
    reject = (F.col("f") > 0) & ~F.coalesce(apart > 1, F.lit(False))
    return fr.groupBy("rec").agg(F.count_if(require).alias("required"), F.count_if(reject).alias("not_rejected"))


@query("A7_compare", """WITH {FR}, g AS (SELECT *, lag(f) OVER (PARTITION BY rec ORDER BY i) AS f2 FROM fr), c AS (SELECT *, abs(1200 * log2(f2 / f)) AS ce FROM g)
SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS scope, count(ce) AS both_voiced, round(avg((f > 0)::INT), 6) AS voiced, round(median(ce), 6) AS median_cents, round(quantile_cont(ce, 0.95), 6) AS p95_cents,
  round(avg((ce > 100)::INT), 6) AS over_100, round(avg((ce > 600)::INT), 6) AS over_600 FROM c GROUP BY GROUPING SETS ((), (kind))""")
def compare(spark, sf):
    fr = frames(spark, sf).withColumn("f2", F.lag("f").over(Window.partitionBy("rec").orderBy("i")))
    scopes = fr.select(F.explode(F.array(F.lit("all"), F.col("kind"))).alias("scope"), "f", F.abs(S.cents(F.col("f2"), F.col("f"))).alias("ce"))
    marks = exact_by(scopes, "scope", F.col("ce"), {"median_cents": 0.5, "p95_cents": 0.95})
    counts = scopes.groupBy("scope").agg(
        F.count("ce").alias("both_voiced"), r6(F.avg((F.col("f") > 0).cast("int"))).alias("voiced"),
        r6(F.avg((F.col("ce") > 100).cast("int"))).alias("over_100"), r6(F.avg((F.col("ce") > 600).cast("int"))).alias("over_600"),
    )
    return counts.join(marks, "scope", "left").withColumns({n: r6(n) for n in ("median_cents", "p95_cents")})
