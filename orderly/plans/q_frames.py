"""Queries over frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderly.functions import scalar as S
from orderly.operators import frames as O
from orderly.operators import measure as M
from orderly.operators.quantiles import exact, exact_by, ranked_share
from orderly.plans.base import frames, query, r6, token_frames, tokens
from orderly.session import materialize

SCREEN = """
vo AS (SELECT * REPLACE (200 + f / 4 AS f, 0.5 + strength / 2 AS strength, rms * 0.9::DOUBLE AS rms) FROM fr),
st AS (SELECT *, coalesce(f > 0 AND lead(f) OVER w > 0 AND abs(12 * log2(greatest(lead(f) OVER w, 1) / greatest(f, 1))) > 7, false) AS jump_pair
  FROM vo WINDOW w AS (PARTITION BY rec ORDER BY i)),
jm AS (SELECT *, bool_or(jump_pair) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS jump FROM st),
pr AS (SELECT *, coalesce(f > 0 AND strength >= 0.6 AND rms >= -45 AND NOT jump, false) AS ok FROM jm),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY rec, ok ORDER BY i) AS island FROM pr),
sc AS (SELECT *, ok AND count(*) OVER (PARTITION BY rec, ok, island) >= 5 AS reliable FROM isl)"""
LEVELS = f"""
WITH {{FR}}, {SCREEN},
b AS (SELECT exp(quantile_cont(ln(f), 0.05)) AS lo, exp(quantile_cont(ln(f), 0.95)) AS hi FROM sc WHERE reliable),
v AS (SELECT f, lo, hi, 1 + (f >= exp(ln(lo) + 1 * (ln(hi) - ln(lo)) / 5))::INT + (f >= exp(ln(lo) + 2 * (ln(hi) - ln(lo)) / 5))::INT
  + (f >= exp(ln(lo) + 3 * (ln(hi) - ln(lo)) / 5))::INT + (f >= exp(ln(lo) + 4 * (ln(hi) - ln(lo)) / 5))::INT AS level FROM sc, b WHERE reliable)"""


def voice(spark, sf):
    """The frames with pitch and quality as steady as those of a voice, so that runs of reliable frames occur."""
    return frames(spark, sf).withColumns({"f": 200 + F.col("f") / 4, "strength": 0.5 + F.col("strength") / 2, "rms": F.col("rms") * 0.9})


@query("F1_five_level", LEVELS + """
SELECT d.level::INT AS level, count(f) AS n, count(f) FILTER (WHERE f < lo OR f > hi) AS saturated, round(median(f), 6) AS median_f
FROM (SELECT unnest(range(1, 6)) AS level) d LEFT JOIN v ON v.level = d.level GROUP BY d.level""")
def five_level(spark, sf):
    ok = O.screen(voice(spark, sf)).where("reliable")
    levels = O.five_level(ok, O.log_bounds(ok))
    grid = spark.range(1, 6).select(F.col("id").cast("int").alias("level"))
    levels = materialize(levels.select("level", "f", "saturated"))
    medians = exact_by(levels, "level", F.col("f"), {"median_f": 0.5})
    counts = levels.groupBy("level").agg(F.count("f").alias("n"), F.count_if("saturated").alias("saturated"))
    return grid.join(counts, "level", "left").join(medians, "level", "left").select(
        "level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("saturated", F.lit(0)).alias("saturated"), r6("median_f").alias("median_f")
    )


@query("F2_t_values", LEVELS + """
SELECT level::INT AS level, round(min(5 * (ln(f) - ln(lo)) / (ln(hi) - ln(lo))), 6) AS t_min, round(max(5 * (ln(f) - ln(lo)) / (ln(hi) - ln(lo))), 6) AS t_max
FROM v GROUP BY level""")
def t_values(spark, sf):
    ok = O.screen(voice(spark, sf)).where("reliable")
    return O.five_level(ok, O.log_bounds(ok)).groupBy("level").agg(r6(F.min("t_value")).alias("t_min"), r6(F.max("t_value")).alias("t_max"))


@query("P1_screen", f"""WITH {{FR}}, {SCREEN}
SELECT rec, count(*) AS total, count(f) AS voiced, count(*) FILTER (WHERE reliable) AS reliable, count(*) FILTER (WHERE jump) AS near_jump,
  round(avg(reliable::INT), 6) AS fraction FROM sc GROUP BY rec""")
def screen(spark, sf):
    return O.screen(voice(spark, sf)).groupBy("rec").agg(
        F.count("*").alias("total"), F.count("f").alias("voiced"), F.count_if("reliable").alias("reliable"), F.count_if("jump").alias("near_jump"),
        r6(F.avg(F.col("reliable").cast("int"))).alias("fraction"),
    )


@query("P18_dominance", """WITH {FR} SELECT kind, count(*) FILTER (WHERE rms - rms2 >= 6) AS dominant, round(median(rms - rms2), 6) AS median_db FROM fr GROUP BY kind""")
def dominance(spark, sf):
    fr = frames(spark, sf).select("kind", (F.col("rms") - F.col("rms2")).alias("d"))
    medians = exact_by(fr, "kind", F.col("d"), {"median_db": 0.5})
    return fr.groupBy("kind").agg(F.count_if(F.col("d") >= 6).alias("dominant")).join(medians, "kind", "left").withColumn("median_db", r6("median_db"))


@query("W1_jump_mask", f"""WITH {{FR}}, {SCREEN} SELECT rec, i, jump_pair, jump FROM sc""")
def jump_mask(spark, sf):
    return O.jump_mask(voice(spark, sf)).select("rec", "i", "jump_pair", "jump")


RUNS = """
m AS (SELECT *, coalesce(f >= 5, false) AS on_ FROM fr),
g AS (SELECT *, i - row_number() OVER (PARTITION BY rec, on_ ORDER BY i) AS grp FROM m),
runs AS (SELECT rec, min(i) AS start, max(i) + 1 AS "end", count(*) AS length FROM g WHERE on_ GROUP BY rec, grp)"""


def loud(fr):
    return fr.withColumn("on_", F.coalesce(F.col("f") >= 5, F.lit(False)))


@query("W3_runs", f"""WITH {{FR}}, {RUNS} SELECT * FROM runs WHERE length >= 5""")
def runs(spark, sf):
    return O.runs(loud(frames(spark, sf)), "on_", 5)


@query("W4_longest_run", f"""WITH {{FR}}, {RUNS} SELECT rec, start, length FROM runs QUALIFY row_number() OVER (PARTITION BY rec ORDER BY length DESC, start) = 1""")
def longest_run(spark, sf):
    best = F.max_by(F.struct("start", "length"), F.struct("length", (-F.col("start")).alias("s")))
    return O.runs(loud(frames(spark, sf)), "on_").groupBy("rec").agg(best.alias("b")).select("rec", "b.start", "b.length")


@query("W5_gap_fill", """WITH {FR},
s AS (SELECT rec, i, t, 12 * log2(f / 100) AS st FROM fr),
k AS (SELECT *, last_value(CASE WHEN st IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, first_value(CASE WHEN st IS NOT NULL THEN i END IGNORE NULLS) OVER n AS i1,
  last_value(st IGNORE NULLS) OVER p AS v0, first_value(st IGNORE NULLS) OVER n AS v1,
  last_value(CASE WHEN st IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, first_value(CASE WHEN st IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1
  FROM s WINDOW p AS (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT rec, i, round(st, 6) AS st, round(coalesce(st, CASE WHEN i1 - i0 - 1 <= 3 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END), 6) AS filled FROM k""")
def gap_fill(spark, sf):
    fr = frames(spark, sf).withColumn("st", S.semitones(F.col("f")))
    return O.fill_gaps(fr, "st").select("rec", "i", r6("st").alias("st"), r6("st_filled").alias("filled"))


WHOLE = """
kn AS (SELECT rec, i, f, i - row_number() OVER (PARTITION BY rec, f IS NOT NULL ORDER BY i) AS island FROM fr),
wr AS (SELECT rec, i, f, min(i) OVER u AS run, count(*) OVER u AS n, i - min(i) OVER u AS k FROM kn WHERE f IS NOT NULL WINDOW u AS (PARTITION BY rec, island) QUALIFY n >= 5),
md AS (SELECT a.rec, a.i, a.run, a.n, a.k, median(b.f) AS f FROM wr a, (SELECT unnest(range(-2, 3)) AS o) o JOIN wr b ON b.rec = a.rec AND b.run = a.run AND b.k = least(greatest(a.k + o.o, 0), a.n - 1) GROUP BY ALL)"""


@query("W6_median5", f"""WITH {{FR}}, {WHOLE} SELECT rec, i, run, round(f, 6) AS f_median FROM md""")
def median5(spark, sf):
    return O.median5(O.whole_runs(frames(spark, sf), "f"), "f").select("rec", "i", "run", r6("f_median").alias("f_median"))


def savgol_sql() -> str:
    """The parabola's weights by window, place of the value and place of the point, as rows."""
    rows = [f"({n}, {at}, {k}, {w!r}::DOUBLE)" for n in (5, 7, 9) for at, ws in enumerate(O.smoothing_weights(n)) for k, w in enumerate(ws)]
    return f"""WITH {{FR}}, {WHOLE}, wt(points, place, k, w) AS (VALUES {", ".join(rows)}),
c AS (SELECT *, (least(9, n) - 1) // 2 AS h, greatest((least(9, n) - 1) // 2, least(k, n - 1 - (least(9, n) - 1) // 2)) AS mid FROM md)
SELECT c.rec, c.i, c.run, round(sum(b.f * wt.w), 6) AS smooth FROM c JOIN md b ON b.rec = c.rec AND b.run = c.run AND b.k BETWEEN c.mid - c.h AND c.mid + c.h
  JOIN wt ON wt.points = 2 * c.h + 1 AND wt.place = c.k - c.mid + c.h AND wt.k = b.k - c.mid + c.h GROUP BY ALL"""


@query("W7_savgol9", savgol_sql())
def savgol9(spark, sf):
    flat = O.median5(O.whole_runs(frames(spark, sf), "f"), "f")
    return O.savgol9(flat, "f_median").select("rec", "i", "run", r6("f_median_smooth").alias("smooth"))


@query("W8_moving_rms", """WITH {FR}, n AS (SELECT *, max(i) OVER (PARTITION BY rec) AS m FROM fr),
p AS (SELECT a.rec, a.i, o.k, b.value FROM n a, (SELECT unnest(range(-2, 3)) AS k) o JOIN fr b ON b.rec = a.rec AND b.i = least(greatest(a.i + o.k, 1), a.m))
SELECT p.rec, p.i, round(sqrt(avg(p.value * p.value)), 6) AS near, round(sqrt(sum(CASE WHEN p.i + p.k BETWEEN 1 AND n.m THEN p.value * p.value ELSE 0 END) / 5), 6) AS padded
FROM p JOIN n ON n.rec = p.rec AND n.i = p.i GROUP BY p.rec, p.i""")
def moving_rms(spark, sf):
    fr = O.moving_rms(frames(spark, sf), "value", 2).withColumnRenamed("value_rms", "near")
    return O.moving_rms(fr, "value", 2, True).select("rec", "i", r6("near").alias("near"), r6("value_rms").alias("padded"))


@query("W9_ecdf", """WITH {FR} SELECT kind, eid, round(row_number() OVER (PARTITION BY kind ORDER BY value, eid) / count(*) OVER (PARTITION BY kind), 6) AS share FROM fr""")
def ecdf(spark, sf):
    return ranked_share(frames(spark, sf).select("kind", "value", "eid"), "kind", "value", "eid").select("kind", "eid", r6("share").alias("share"))


@query("W10_steps", """WITH {FR}, v AS (SELECT rec, (i - 1) // 12 AS tok, t, i, 12 * log2(f / 100) AS st FROM fr WHERE f IS NOT NULL),
d AS (SELECT *, st - lag(st) OVER w AS move, t - lag(t) OVER w AS gap FROM v WINDOW w AS (PARTITION BY rec, tok ORDER BY t, i))
SELECT rec, tok, round(max(CASE WHEN gap <= 0.010001 THEN -move END), 6) AS max_drop, coalesce(bool_or(CASE WHEN gap <= 0.010001 THEN abs(move) >= 7 END), false) AS any_jump,
  round(max(gap), 6) AS max_gap FROM d GROUP BY rec, tok""")
def steps(spark, sf):
    fr = frames(spark, sf).withColumn("tok", F.expr("(i - 1) div 12"))
    return M.steps(fr, ["rec", "tok"], 0.010001).select("rec", "tok", r6("max_drop").alias("max_drop"), "any_jump", r6("max_gap").alias("max_gap"))


def onset_sql(mode: str) -> str:
    if mode == "fixed":
        edges = "a AS h0, a + 0.03::DOUBLE AS h1, a + 0.06::DOUBLE AS b0, a + 0.12::DOUBLE AS b1, (b - a) < 0.12::DOUBLE - 1e-8 AS short"
        reason, need = "rime_shorter_than_120ms", (2, 3)
    else:
        edges = "a AS h0, a + 0.3::DOUBLE * least(b - a, 0.12::DOUBLE) AS h1, a + 0.6::DOUBLE * least(b - a, 0.12::DOUBLE) AS b0, a + 0.9::DOUBLE * least(b - a, 0.12::DOUBLE) AS b1, (b - a) <= 0 AS short"
        reason, need = "empty_rime", (2, 2)
    return f"""WITH {{FR}}, {{TOK}}, w AS (SELECT *, {edges} FROM tok),
x AS (SELECT w.rec, w.tok, w.short, t, f, t >= h0 - 1e-9 AND t < h1 AND f IS NOT NULL AS head, t >= b0 - 1e-9 AND t < b1 AND f IS NOT NULL AS body
  FROM w JOIN fr ON fr.rec = w.rec AND fr.t >= w.a - 0.03::DOUBLE AND fr.t < w.b + 0.03::DOUBLE),
g AS (SELECT rec, tok, bool_or(short) AS short, count(*) FILTER (WHERE head) AS head_n, count(*) FILTER (WHERE body) AS body_n,
  median(12 * log2(f / 100)) FILTER (WHERE head) - median(12 * log2(f / 100)) FILTER (WHERE body) AS d,
  (median(t) FILTER (WHERE body) - median(t) FILTER (WHERE head)) * 1000 AS e FROM x GROUP BY rec, tok)
SELECT rec, tok, '{mode}' AS variant, head_n, body_n, CASE WHEN short THEN '{reason}' WHEN head_n < {need[0]} OR body_n < {need[1]} THEN 'insufficient_voicing' ELSE '' END AS reason,
  round(CASE WHEN NOT short AND head_n >= {need[0]} AND body_n >= {need[1]} THEN d END, 6) AS d_st,
  round(CASE WHEN NOT short AND head_n >= {need[0]} AND body_n >= {need[1]} THEN e END, 6) AS elapsed_ms FROM g"""


def onset(mode):
    def run(spark, sf):
        found = M.onset(token_frames(frames(spark, sf)), ["rec", "tok"], mode)
        return found.select("rec", "tok", "variant", "head_n", "body_n", "reason", r6("d_st").alias("d_st"), r6("elapsed_ms").alias("elapsed_ms"))

    return run


query("W12_onset_fixed", onset_sql("fixed"))(onset("fixed"))
query("W12_onset_adaptive", onset_sql("adaptive"))(onset("adaptive"))


@query("W13_trace", """WITH {FR}, {TOK}, p AS (SELECT rec, tok, k AS pos, a + (0.005::DOUBLE + 0.01::DOUBLE * k) AS at FROM tok, (SELECT unnest(range(0, 12)) AS k))
SELECT p.rec, p.tok, p.pos::INT AS pos, round(f.f, 6) AS f FROM p LEFT JOIN fr f ON f.rec = p.rec AND f.i = round_even(p.at / 0.01::DOUBLE, 0)::BIGINT AND abs(f.t - p.at) <= 0.0051::DOUBLE""")
def trace(spark, sf):
    fr = frames(spark, sf)
    offsets = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.lit(0.005) + F.lit(0.01) * k)).alias("pos", "o")
    points = tokens(fr).select("rec", "tok", "a", offsets).withColumn("at", F.col("a") + F.col("o"))
    near = points.withColumn("i", S.rint(F.col("at") / F.lit(0.01))).join(fr.select("rec", "i", "t", "f"), ["rec", "i"], "left")
    ok = F.abs(F.col("t") - F.col("at")) <= 0.0051
    return near.select("rec", "tok", "pos", r6(F.when(ok, F.col("f"))).alias("f"))


@query("W14_three_point", f"""WITH {{FR}}, {RUNS}, lr AS (SELECT * FROM runs WHERE length >= 5),
rf AS (SELECT lr.rec, lr.start, fr.t, fr.f, min(fr.t) OVER w AS s, max(fr.t) OVER w AS e FROM lr JOIN fr ON fr.rec = lr.rec AND fr.i >= lr.start AND fr.i < lr."end" WINDOW w AS (PARTITION BY lr.rec, lr.start)),
p AS (SELECT rf.*, pos, share, abs(t - (s + share * (e - s))) <= greatest(0.015::DOUBLE, 0.1::DOUBLE * (e - s)) + 1e-9 AS near FROM rf, (VALUES (0, 0.2::DOUBLE), (1, 0.5::DOUBLE), (2, 0.8::DOUBLE)) v(pos, share))
SELECT rec, start, pos::INT AS pos, count(*) FILTER (WHERE near) AS n, round(CASE WHEN count(*) FILTER (WHERE near) >= 2 THEN median(f) FILTER (WHERE near) END, 6) AS median FROM p GROUP BY rec, start, pos""")
def three_point(spark, sf):
    labelled = O.label_runs(loud(frames(spark, sf)), "on_").where("run_length >= 5").withColumnRenamed("run", "start")
    w = Window.partitionBy("rec", "start")
    spans = labelled.withColumns({"start_t": F.min("t").over(w), "end_t": F.max("t").over(w)})
    return M.three_points(spans, ["rec", "start"]).select("rec", "start", "pos", "n", r6("median").alias("median"))


@query("W14_character", """WITH {FR}, {TOK}, x AS (SELECT tok.rec, tok.tok, fr.i, fr.t, fr.f FROM tok JOIN fr ON fr.rec = tok.rec AND fr.t >= tok.a AND fr.t < tok.b WHERE fr.f >= 5),
g AS (SELECT *, i - row_number() OVER (PARTITION BY rec, tok ORDER BY i) AS grp FROM x),
r AS (SELECT rec, tok, min(t) AS s, max(t) AS e, count(*) AS n FROM g GROUP BY rec, tok, grp HAVING count(*) >= 5 QUALIFY row_number() OVER (PARTITION BY rec, tok ORDER BY n DESC, s) = 1)
SELECT r.rec, r.tok, p.pos::INT AS pos, round(median(x.f), 6) AS median FROM r, (VALUES (0, 0.2::DOUBLE), (1, 0.5::DOUBLE), (2, 0.8::DOUBLE)) p(pos, share)
  JOIN x ON x.rec = r.rec AND x.tok = r.tok AND abs(x.t - (s + share * (e - s))) <= 0.02::DOUBLE + 1e-9 GROUP BY r.rec, r.tok, p.pos""")
def character_points(spark, sf):
    """The read-out inside a token: medians within 20 ms around three points of its longest run of five frames or more."""
    inside = token_frames(frames(spark, sf), 0.0).where("f >= 5").select("rec", "tok", "i", "t", "f")
    return M.character_points(inside, ["rec", "tok"]).select("rec", "tok", "pos", r6("median").alias("median"))


@query("W16_edge_target", f"""WITH {{FR}}, {RUNS}, x AS (SELECT lr.rec, lr.start, lr.length, fr.i - lr.start AS k, 12 * log2(fr.f / 100) AS st FROM runs lr JOIN fr ON fr.rec = lr.rec AND fr.i >= lr.start AND fr.i < lr."end" WHERE length >= 10)
SELECT rec, start, round(median(st) FILTER (WHERE k < 5) - median(st) FILTER (WHERE abs(k - least(25, length // 2)) <= 2), 6) AS rise,
  abs(median(st) FILTER (WHERE k < 5) - median(st) FILTER (WHERE abs(k - least(25, length // 2)) <= 2)) >= 1.2 AS target FROM x GROUP BY rec, start""")
def edge_target(spark, sf):
    rows = O.label_runs(loud(frames(spark, sf)), "on_").where("run_length >= 10").withColumns({"k": F.expr("i - run"), "st": S.semitones(F.col("f"))})
    half = F.abs(F.col("k") - F.least(F.lit(25), F.expr("run_length div 2"))) <= 2
    rise = F.percentile(F.when(F.col("k") < 5, F.col("st")), F.lit(0.5)) - F.percentile(F.when(half, F.col("st")), F.lit(0.5))
    return rows.groupBy("rec", F.col("run").alias("start")).agg(r6(rise).alias("rise"), (F.abs(rise) >= 1.2).alias("target"))


@query("W20_segments", """WITH {FR}, c AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM fr WINDOW w AS (PARTITION BY rec ORDER BY i)),
s AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY i) AS seq FROM c)
SELECT rec, seq::BIGINT AS seq, kind AS label, round(min(t), 6) AS start_t, round(max(t), 6) AS end_t, round(max(f), 6) AS peak, count(*) AS n FROM s GROUP BY rec, seq, kind""")
def segments(spark, sf):
    found = O.segments_of_labels(frames(spark, sf), "kind")
    return found.select("rec", "seq", "label", r6("start_t").alias("start_t"), r6("end_t").alias("end_t"), r6("peak").alias("peak"), "n")


@query("W21_quiet_spans", """WITH {FR}, q AS (SELECT greatest(1e-5, 0.2 * quantile_cont(value, 0.95)) AS q FROM fr), m AS (SELECT fr.*, value < q AS quiet FROM fr, q),
g AS (SELECT *, i - row_number() OVER (PARTITION BY rec, quiet ORDER BY i) AS grp FROM m)
SELECT rec, min(i) AS start, max(i) + 1 AS "end", count(*) AS length FROM g WHERE quiet GROUP BY rec, grp HAVING count(*) >= 3""")
def quiet_spans(spark, sf):
    fr = frames(spark, sf)
    (high,) = exact(fr, F.col("value"), (0.95,))
    return O.runs(fr.withColumn("quiet", F.col("value") < max(1e-5, 0.2 * (high or 0.0))), "quiet", 3)


@query("W22_boundaries", """WITH {FR}, sg AS (SELECT rec, (i - 1) // 12 AS tok, min(t) FILTER (WHERE (i - 1) % 12 BETWEEN 1 AND 3 + (i - 1) // 12 % 7) AS a, max(t) FILTER (WHERE (i - 1) % 12 BETWEEN 1 AND 3 + (i - 1) // 12 % 7) AS b FROM fr GROUP BY 1, 2),
n AS (SELECT * FROM (SELECT rec, tok, b AS lo, lead(a) OVER (PARTITION BY rec ORDER BY tok) AS hi FROM sg WHERE a IS NOT NULL) WHERE hi IS NOT NULL),
q AS (SELECT rec, min(t) AS qs, max(t) AS qe FROM (SELECT rec, t, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS grp FROM fr WHERE rms < -30) GROUP BY rec, grp HAVING max(t) - min(t) >= 0.02::DOUBLE - 1e-9),
p AS (SELECT n.rec, n.tok, greatest(lo, qs) AS left_t, least(hi, qe) AS right_t FROM n JOIN q ON q.rec = n.rec AND least(hi, qe) - greatest(lo, qs) >= 0.02::DOUBLE - 1e-9
  QUALIFY row_number() OVER (PARTITION BY n.rec, n.tok ORDER BY round(least(hi, qe) - greatest(lo, qs), 6) DESC, greatest(lo, qs)) = 1),
m AS (SELECT n.rec, n.tok, arg_min(fr.t, (fr.rms, fr.i)) AS quietest FROM n JOIN fr ON fr.rec = n.rec AND fr.t >= lo AND fr.t < hi GROUP BY 1, 2)
SELECT n.rec, n.tok, CASE WHEN p.rec IS NOT NULL THEN 'quiet_gap' WHEN hi - lo >= 0.05::DOUBLE - 1e-9 THEN 'quietest' ELSE 'midpoint' END AS rule,
  round(CASE WHEN p.rec IS NOT NULL THEN left_t WHEN hi - lo >= 0.05::DOUBLE - 1e-9 THEN quietest ELSE (lo + hi) / 2 END, 6) AS end_t,
  round(CASE WHEN p.rec IS NOT NULL THEN right_t WHEN hi - lo >= 0.05::DOUBLE - 1e-9 THEN quietest ELSE (lo + hi) / 2 END, 6) AS start_t
FROM n LEFT JOIN p ON p.rec = n.rec AND p.tok = n.tok LEFT JOIN m ON m.rec = n.rec AND m.tok = n.tok""")
def boundaries(spark, sf):
    """Where one token ends and the next begins: some frames of each block of 12 are the support of its token."""
    fr = frames(spark, sf)
    tok, place = F.expr("(i - 1) div 12"), (F.col("i") - 1) % 12
    held = fr.withColumn("tok", tok).where((place >= 1) & (place <= 3 + F.col("tok") % 7))
    supports = held.groupBy("rec", "tok").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spans = M.quiet_spans(fr, F.col("rms") < -30, 0.02)
    found = M.boundaries(supports, spans, fr.select("rec", "i", "t", "rms"), 0.02, 0.05)
    return found.select("rec", "tok", "rule", r6("end_t").alias("end_t"), r6("start_t").alias("start_t"))


@query("P13_strict_gate", """WITH {FR}, {TOK}, x AS (SELECT tok.rec, tok.tok, count(f) AS n, median(rms - rms2) AS dom, max(f) - min(f) AS d FROM tok JOIN fr ON fr.rec = tok.rec AND fr.t >= tok.a AND fr.t < tok.b GROUP BY 1, 2)
SELECT rec, tok, coalesce(d IS NOT NULL AND n >= 6 AND dom >= 6, false) AS strict FROM x""")
def strict_gate(spark, sf):
    rows = token_frames(frames(spark, sf), 0.0).groupBy("rec", "tok").agg(
        F.count("f").alias("n"), F.percentile(F.col("rms") - F.col("rms2"), F.lit(0.5)).alias("dom"), (F.max("f") - F.min("f")).alias("d")
    )
    return rows.select("rec", "tok", M.clean_gate(F.col("d"), F.col("n") >= 6, F.lit(0.0), F.lit(False), F.col("dom")).alias("strict"))


@query("W23_overlaps", """WITH {FR}, {TOK}, o AS (SELECT *, lag(b) OVER (PARTITION BY rec ORDER BY a, b) AS pb FROM tok) SELECT rec, tok, round(pb, 6) AS previous_end FROM o WHERE pb > a + 0.005::DOUBLE""")
def overlaps(spark, sf):
    from orderly.operators.checks import overlaps as found

    return found(tokens(frames(spark, sf)), "rec", "a", "b", 0.005).select("rec", "tok", r6("previous_end").alias("previous_end"))
