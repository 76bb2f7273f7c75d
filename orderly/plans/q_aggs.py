"""Queries that aggregate: profiles, cohorts, breakdowns, error rates, counts, sets and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderly.functions import scalar as S
from orderly.operators import cohort as C
from orderly.operators.quantiles import exact_by
from orderly.plans.base import frames, micros, query, r6
from orderly.sources.tables import table

COH = """coh AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END || CASE WHEN l.toxic = 1 THEN '_toxic' ELSE '_clean' END AS grp,
  CASE WHEN d.doc_id % 5 <> 0 THEN ln(d.n_chars) - 6 END AS d_st FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def cohorts(spark, sf):
    """labelled documents as tokens: a 2 x 2 group, the source as cluster, a measure that is sometimes NULL."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, sf, "labels"), "doc_id")
    grp = F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "_toxic").otherwise("_clean"))
    return rows.select("doc_id", "lang", "source", grp.alias("grp"), F.when(F.col("doc_id") % 5 != 0, F.log("n_chars") - 6).alias("d_st"))


def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query("A2_profile", """WITH {FR} SELECT kind, count(value) AS n, """ + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{int(q * 100)}" for q in (0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1)) + " FROM fr GROUP BY kind")
def profile(spark, sf):
    shares = (0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1)
    fr = frames(spark, sf).select("kind", "value")
    marks = exact_by(fr, "kind", F.col("value"), {f"q{int(q * 100)}": q for q in shares})
    counts = fr.groupBy("kind").agg(F.count("value").alias("n"))
    return counts.join(marks, "kind", "left").select("kind", "n", *[r6(f"q{int(q * 100)}").alias(f"q{int(q * 100)}") for q in shares])


@query("A4_log_z", """WITH {FR}, s AS (SELECT kind, avg(ln(nullif(value, 0))) AS m, stddev_pop(ln(nullif(value, 0))) AS s FROM fr GROUP BY kind)
SELECT fr.kind, count(*) AS n, round(max((ln(nullif(value, 0)) - m) / nullif(s, 0)), 6) AS z_max, round(min((ln(nullif(value, 0)) - m) / nullif(s, 0)), 6) AS z_min FROM fr JOIN s ON s.kind = fr.kind GROUP BY fr.kind""")
def log_z(spark, sf):
    fr = frames(spark, sf)
    stats = fr.groupBy("kind").agg(F.avg(F.log("value")).alias("m"), F.stddev_pop(F.log("value")).alias("s"))
    z = S.log_z(F.col("value"), F.col("m"), F.col("s"))
    return fr.join(stats, "kind").groupBy("kind").agg(F.count("*").alias("n"), r6(F.max(z)).alias("z_max"), r6(F.min(z)).alias("z_min"))


@query("A6_segments", """WITH {FR} SELECT rec, (i - 1) // 24 AS seg, round(avg((f IS NOT NULL)::INT), 6) AS valid, round(median(rms), 6) AS rms, round(median(rms - rms2), 6) AS db, round(median(f), 6) AS f FROM fr GROUP BY rec, (i - 1) // 24""")
def segment_stats(spark, sf):
    half = F.lit(0.5)
    return frames(spark, sf).groupBy("rec", F.expr("(i - 1) div 24").alias("seg")).agg(
        r6(F.avg(F.col("f").isNotNull().cast("int"))).alias("valid"), r6(F.percentile("rms", half)).alias("rms"),
        r6(F.percentile(F.col("rms") - F.col("rms2"), half)).alias("db"), r6(F.percentile("f", half)).alias("f"),
    )


@query("A8_tumbling", """WITH {FR} SELECT us // 600000000 AS win, count(*) AS n, round(median(value), 6) AS p50, round(exp(quantile_cont(ln(nullif(value, 0)), 0.05)), 6) AS p5, round(exp(quantile_cont(ln(nullif(value, 0)), 0.95)), 6) AS p95 FROM fr GROUP BY 1""")
def tumbling(spark, sf):
    fr = frames(spark, sf).select(F.expr("us div 600000000").alias("win"), "value")
    counted = C.measures(fr, [F.col("win")], F.col("value"), None, {"p50": 0.5}, [F.count("*").alias("n")])
    ends = exact_by(fr, "win", F.log("value"), {"p5": 0.05, "p95": 0.95})
    return counted.join(ends, "win", "left").select("win", "n", r6("p50").alias("p50"), r6(F.exp("p5")).alias("p5"), r6(F.exp("p95")).alias("p95"))


@query("A9_cohorts", f"""WITH {COH} SELECT grp, count(*) AS total, count(d_st) AS measured, round(count(d_st) / count(*), 6) AS measured_fraction, count(DISTINCT CASE WHEN d_st IS NOT NULL THEN source END) AS clusters,
  round(median(d_st), 6) AS median, round(avg(d_st), 6) AS mean, round(quantile_cont(d_st, 0.9), 6) AS p90, """ + ", ".join(f"count(*) FILTER (WHERE d_st >= {k}) AS n_ge_{k}, round(count(*) FILTER (WHERE d_st >= {k}) / nullif(count(d_st), 0), 6) AS fraction_ge_{k}" for k in (1, 2, 3)) + " FROM coh GROUP BY grp")
def cohort_table(spark, sf):
    return rounded(C.summary(cohorts(spark, sf), ["grp"], "d_st", "source"), "measured_fraction", "median", "mean", "p90", "fraction_ge_1", "fraction_ge_2", "fraction_ge_3")


@query("A9_top_values", f"""WITH {COH}, c AS (SELECT grp, lang, count(*) AS n, min(doc_id) AS seen FROM coh GROUP BY grp, lang), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, seen) AS r FROM c)
SELECT grp, string_agg(lang, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY grp""")
def top_values(spark, sf):
    return C.top_values(cohorts(spark, sf), ["grp"], "lang", ["doc_id"], 3).select("grp", F.array_join("top", ",").alias("top"))


@query("A10_breakdowns", f"""WITH {COH}, s AS (SELECT grp, d_st, source, 'lang' AS field, lang AS level FROM coh UNION ALL SELECT grp, d_st, source, 'third', (doc_id % 3)::VARCHAR FROM coh)
SELECT grp, field, level, count(d_st) AS n, count(DISTINCT CASE WHEN d_st IS NOT NULL THEN source END) AS clusters, round(median(d_st), 6) AS median, round(avg(d_st), 6) AS mean, count(*) FILTER (WHERE d_st >= 2) AS n_ge_2 FROM s GROUP BY ALL""")
def breakdowns(spark, sf):
    rows = cohorts(spark, sf).withColumn("third", F.col("doc_id") % 3)
    return rounded(C.breakdowns(rows, "grp", ["lang", "third"], "d_st", "source"), "median", "mean")


@query("A12_trace_median", """WITH v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, (pos - 1)::INT AS pos, round(median(x::DOUBLE), 6) AS median FROM v GROUP BY label, pos""")
def trace_median(spark, sf):
    long = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    cells = long.select(F.struct("label", "pos").alias("cell"), "x")
    return exact_by(cells, "cell", F.col("x"), {"median": 0.5}).select("cell.*", r6("median").alias("median"))


@query("A13_loghist", """WITH {FR} SELECT floor(ln(value / 0.5::DOUBLE) / ln(650 / 0.5::DOUBLE) * 109)::BIGINT AS bin, count(*) AS n FROM fr WHERE value >= 0.5 AND value < 650 GROUP BY 1""")
def loghist(spark, sf):
    bin_ = F.floor(F.log(F.col("value") / 0.5) / F.log(F.lit(650 / 0.5)) * 109)
    return frames(spark, sf).where("value >= 0.5 AND value < 650").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("A14_tokens", """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT lang, w, count(*) AS n FROM w GROUP BY lang, w""")
def token_counts(spark, sf):
    words = table(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w"))
    return words.groupBy("lang", "w").agg(F.count("*").alias("n"))


@query("A15_status_counts", """SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars < 100) AS rare FROM documents GROUP BY source""")
def status_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 100).alias("rare"))


@query("A16_conflict", """SELECT sha256(text) AS h, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def conflict(spark, sf):
    h = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), "source")
    return h.groupBy("h").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).where("sources > 1")


@query("A17_hash_split", """SELECT count(*) AS groups, count(*) FILTER (WHERE k > 1) AS spanning FROM (SELECT sha256(text), count(DISTINCT doc_id % 3) AS k FROM documents GROUP BY 1)""")
def hash_split(spark, sf):
    h = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count_distinct(F.col("doc_id") % 3).alias("k"))
    return h.agg(F.count("*").alias("groups"), F.count_if(F.col("k") > 1).alias("spanning"))


@query("A18_micro_macro", """WITH g AS (SELECT source, sum(length(text) % 17) AS e, sum(length(text)) AS n FROM documents GROUP BY source) SELECT round(sum(e) / sum(n), 6) AS micro, round(avg(e / n), 6) AS macro, count(*) AS groups FROM g""")
def micro_macro(spark, sf):
    rows = table(spark, sf, "documents").select("source", (F.length("text") % 17).alias("e"), F.length("text").alias("n"))
    return rounded(C.error_rates(rows, "source", "e", "n"), "micro", "macro")


CLUSTERS = f"""{COH}, g AS (SELECT DISTINCT source FROM documents), k AS (SELECT DISTINCT grp FROM coh),
cs AS (SELECT k.grp, g.source, count(coh.d_st) AS n, coalesce(sum(coh.d_st), 0) AS total, count(*) FILTER (WHERE coh.d_st >= 2) AS hits FROM g CROSS JOIN k LEFT JOIN coh ON coh.grp = k.grp AND coh.source = g.source GROUP BY k.grp, g.source)"""


def statistics(spark, sf):
    return C.cluster_statistics(cohorts(spark, sf), table(spark, sf, "documents"), "grp", "source", "d_st")


@query("A19_cluster_stats", f"""WITH {CLUSTERS} SELECT grp, source, n, round(total, 6) AS total, hits FROM cs""")
def cluster_stats(spark, sf):
    return rounded(statistics(spark, sf), "total")


@query("A20_point", f"""WITH {CLUSTERS}, e AS (SELECT grp, sum(total) / sum(n) AS m FROM cs GROUP BY grp) SELECT round(max(m) FILTER (WHERE grp = 'good_toxic') - max(m) FILTER (WHERE grp = 'good_clean'), 6) AS good,
  round(max(m) FILTER (WHERE grp = 'poor_toxic') - max(m) FILTER (WHERE grp = 'poor_clean'), 6) AS poor,
  round((max(m) FILTER (WHERE grp = 'good_toxic') - max(m) FILTER (WHERE grp = 'good_clean')) - (max(m) FILTER (WHERE grp = 'poor_toxic') - max(m) FILTER (WHERE grp = 'poor_clean')), 6) AS interaction FROM e""")
def point(spark, sf):
    m = statistics(spark, sf).groupBy("grp").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("m"))
    of = {g: F.max(F.when(F.col("grp") == g, F.col("m"))) for g in ("good_toxic", "good_clean", "poor_toxic", "poor_clean")}
    good, poor = of["good_toxic"] - of["good_clean"], of["poor_toxic"] - of["poor_clean"]
    return m.agg(r6(good).alias("good"), r6(poor).alias("poor"), r6(good - poor).alias("interaction"))


@query("A20_bootstrap_ci")
def bootstrap_ci(spark, sf):
    """Intervals of the cohorts, their contrasts and the interaction. strict: without the rows that P6_status excludes explicitly."""
    cells = {g: {g: 1} for g in ("good_clean", "good_toxic", "poor_clean", "poor_toxic")}
    terms = cells | {
        "good_effect_clean": {"good_clean": 1, "poor_clean": -1},
        "good_effect_toxic": {"good_toxic": 1, "poor_toxic": -1},
        "toxic_effect_poor": {"poor_toxic": 1, "poor_clean": -1},
        "toxic_effect_good": {"good_toxic": 1, "good_clean": -1},
        "interaction": {"good_toxic": 1, "poor_toxic": -1, "good_clean": -1, "poor_clean": 1},
    }
    rows, sources = cohorts(spark, sf), table(spark, sf, "documents")
    strict = rows.withColumn("d_st", F.when(F.col("doc_id") % 7 != 0, F.col("d_st")))
    both = [C.cluster_statistics(r, sources, "grp", "source", "d_st").withColumn("variant", F.lit(v)) for v, r in (("agreement", rows), ("strict", strict))]
    return C.contrasts(both[0].unionByName(both[1]), "grp", "source", terms, within=("variant",))


@query("A22_extremes", """WITH {FR} SELECT kind, arg_max(eid, (value, eid)) AS at_max, arg_min(eid, (value, eid)) AS at_min FROM fr GROUP BY kind""")
def extremes(spark, sf):
    key = F.struct("value", "eid")
    return frames(spark, sf).groupBy("kind").agg(F.max_by("eid", key).alias("at_max"), F.min_by("eid", key).alias("at_min"))


@query("A23_weighted_time", """WITH {FR} SELECT rec, round(sum((strength + 1e-8) * t) / sum(strength + 1e-8), 6) AS at, round(avg(strength), 6) AS mean, round(max(strength), 6) AS peak FROM fr GROUP BY rec""")
def weighted_time(spark, sf):
    w = F.col("strength") + 1e-8
    return frames(spark, sf).groupBy("rec").agg(r6(F.sum(w * F.col("t")) / F.sum(w)).alias("at"), r6(F.avg("strength")).alias("mean"), r6(F.max("strength")).alias("peak"))


@query("A25_display", """SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS shown FROM conversations GROUP BY conv_id""")
def display(spark, sf):
    row = F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("s"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return c.select("conv_id", F.array_join(F.transform("r", lambda x: x["s"]), " ").alias("shown"))


@query("L1_topk_dedupe", """WITH c AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderkey AS ok, floor(o_totalprice)::BIGINT AS price FROM orders),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k, p ORDER BY price, ok) = 1) SELECT k, p, ok, price, row_number() OVER (PARTITION BY k ORDER BY price, ok)::INT AS r FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY price, ok) <= 3""")
def topk(spark, sf):
    from orderly.operators.lexicon import ranked

    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("ok"), F.floor("o_totalprice").alias("price"))
    return ranked(c, ["k"], "p", ["price", "ok"], 3)


@query("L2_review", f"""WITH {COH} SELECT doc_id, grp, round(d_st, 6) AS d_st FROM coh WHERE contains(concat_ws(' ', doc_id::VARCHAR, lang, source), 'src1') AND grp LIKE 'good%' ORDER BY d_st DESC NULLS LAST, doc_id LIMIT 500""")
def review(spark, sf):
    rows = cohorts(spark, sf).where(F.concat_ws(" ", F.col("doc_id").cast("string"), "lang", "source").contains("src1") & F.col("grp").startswith("good"))
    return rounded(rows.orderBy(F.desc_nulls_last("d_st"), "doc_id").limit(500).select("doc_id", "grp", "d_st"), "d_st")


@query("L6_shuffle", """SELECT source, row_number() OVER (ORDER BY sha256('20260914' || source))::INT AS place FROM (SELECT DISTINCT source FROM documents)""")
def shuffle(spark, sf):
    keys = table(spark, sf, "documents").select("source").distinct()  # few keys
    return keys.select("source", F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit("20260914"), "source"), 256))).alias("place"))


@query("L7_first_n", """SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25""")
def first_n(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("U1_union", """SELECT 'part' AS origin, p_name AS word FROM part UNION ALL SELECT 'customer', c_name FROM customer""")
def union(spark, sf):
    a = table(spark, sf, "part").select(F.lit("part").alias("origin"), F.col("p_name").alias("word"))
    return a.unionByName(table(spark, sf, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("word")))


@query("U2_intersection", """SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersection(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("U3_difference", """SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("U4_inventory", """SELECT p_type AS phone, row_number() OVER (ORDER BY p_type)::INT AS id FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT '<blank>', 0""")
def inventory(spark, sf):
    found = table(spark, sf, "part").select(F.col("p_type").alias("phone")).distinct()  # an inventory of symbols is small
    ids = found.select("phone", F.row_number().over(Window.orderBy("phone")).alias("id"))
    return ids.unionByName(spark.range(1).select(F.lit("<blank>").alias("phone"), F.lit(0).alias("id")))


@query("U5_union_keys", """SELECT p_partkey AS key, p_name AS name, NULL::BIGINT AS nation FROM part UNION ALL SELECT s_suppkey, s_name, s_nationkey::BIGINT FROM supplier""")
def union_keys(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)
