"""Measures of tokens on their frames: onset change, steps, gaps, sampled traces and three-point read-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderly.functions import scalar as S

SLACK = 1e-9


def onset(token_frames: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """For tokens with columns a, b (start and end in seconds) joined to their frames (t, f): d_st, the median pitch of
    the head less that of the body in semitones, with counts and a reason where it is NULL.

    fixed: head [a, a + 30 ms), body [a + 60, a + 120 ms), at least 120 ms long, 2 and 3 frames at least. adaptive: the
    windows are shares of the token's length up to 120 ms: [0, .3) and [.6, .9), 2 frames each."""
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    if mode == "fixed":
        h0, h1, b0, b1, need = a, a + 0.03, a + 0.06, a + 0.12, (2, 3)
        short = (b - a) < 0.12 - 1e-8
        reason_short = "rime_shorter_than_120ms"
    else:
        span = F.least(b - a, F.lit(0.12))
        h0, h1, b0, b1, need = a, a + 0.3 * span, a + 0.6 * span, a + 0.9 * span, (2, 2)
        short = (b - a) <= 0
        reason_short = "empty_rime"
    head = (t >= h0 - SLACK) & (t < h1) & F.col("f").isNotNull()
    body = (t >= b0 - SLACK) & (t < b1) & F.col("f").isNotNull()
    st = S.semitones(F.col("f"))
    table = token_frames.groupBy(*keys, "a", "b").agg(
        F.count_if(head).alias("head_n"),
        F.count_if(body).alias("body_n"),
        F.percentile(F.when(head, st), F.lit(0.5)).alias("head_st"),
        F.percentile(F.when(body, st), F.lit(0.5)).alias("body_st"),
        F.percentile(F.when(head, t), F.lit(0.5)).alias("head_t"),
        F.percentile(F.when(body, t), F.lit(0.5)).alias("body_t"),
    )
    sparse = (F.col("head_n") < need[0]) | (F.col("body_n") < need[1])
    d = F.when(~short & ~sparse, F.col("head_st") - F.col("body_st"))
    elapsed = F.when(d.isNotNull(), (F.col("body_t") - F.col("head_t")) * 1000)
    reason = F.when(short, reason_short).when(sparse, "insufficient_voicing").otherwise("")
    return table.select(
        *keys, F.lit(mode).alias("variant"), d.alias("d_st"), reason.alias("reason"), "head_n", "body_n", elapsed.alias("elapsed_ms"),
        F.when(elapsed > 0, d / elapsed * 1000).alias("descent_st_s"),
    )


def steps(frames: DataFrame, keys: list[str], within: float) -> DataFrame:
    """Per key: the greatest fall between voiced neighbours no further apart than ``within``, whether one moves by 7
    semitones or more, and the longest gap between voiced neighbours."""
    order = Window.partitionBy(*keys).orderBy("t", "i")
    voiced = frames.where("f IS NOT NULL")
    st = S.semitones(F.col("f"))
    both = voiced.withColumn("st", st).withColumn("move", F.col("st") - F.lag("st").over(order)).withColumn("gap", F.col("t") - F.lag("t").over(order))
    near = F.col("gap") <= within
    return both.groupBy(*keys).agg(
        F.max(F.when(near, -F.col("move"))).alias("max_drop"),
        F.coalesce(F.max(F.when(near, F.abs(F.col("move")) >= 7)), F.lit(False)).alias("any_jump"),
        F.max("gap").alias("max_gap"),
    )


def sample_points(tokens: DataFrame, offsets: list[float]) -> DataFrame:
    """A row for each token and offset from its start: pos and the time at."""
    points = F.posexplode(F.array(*[F.lit(float(o)) for o in offsets])).alias("pos", "offset")
    return tokens.select("*", points).withColumn("at", F.col("a") + F.col("offset"))


def three_points(run_frames: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.2, 0.5, 0.8), half_min: float = 0.015, half_share: float = 0.1, at_least: int = 2) -> DataFrame:
    """Medians of f around the shares of each run's span (columns start_t, end_t), over half windows of at least
    ``half_min``: pos, n and median (NULL under ``at_least`` frames)."""
    span = F.col("end_t") - F.col("start_t")
    half = F.greatest(F.lit(half_min), half_share * span)
    points = run_frames.select("*", F.posexplode(F.array(*[F.lit(s) for s in shares])).alias("pos", "share"))
    near = F.abs(F.col("t") - (F.col("start_t") + F.col("share") * span)) <= half + SLACK
    return points.groupBy(*keys, "pos").agg(
        F.count_if(near & F.col("f").isNotNull()).alias("n"),
        F.when(F.count_if(near & F.col("f").isNotNull()) >= at_least, F.percentile(F.when(near, F.col("f")), F.lit(0.5))).alias("median"),
    )


def character_points(valid: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.2, 0.5, 0.8), half: float = 0.02, at_least: int = 5) -> DataFrame:
    """keys, pos and median: the medians of f within ``half`` seconds of the shares of the longest run (the earliest of
    equal ones) of at least so many successive frames. valid: the reliable frames of each token (keys, i, t, f)."""
    order = Window.partitionBy(*keys).orderBy("i")
    numbered = valid.withColumn("__run", F.col("i") - F.row_number().over(order))
    runs = numbered.groupBy(*keys, "__run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")).where(F.col("n") >= at_least)
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("start", "end"), F.struct("n", (-F.col("start")).alias("s"))).alias("r")).select(*keys, "r.*")
    points = best.select(*keys, "start", "end", F.posexplode(F.array(*[F.lit(s) for s in shares])).alias("pos", "share"))
    near = F.abs(F.col("t") - (F.col("start") + F.col("share") * (F.col("end") - F.col("start")))) <= half + SLACK
    return points.join(valid, keys).where(near).groupBy(*keys, "pos").agg(F.percentile("f", F.lit(0.5)).alias("median"))


def quiet_spans(frames: DataFrame, quiet: Column, at_least: float) -> DataFrame:
    """rec, qs, qe: first and last time of the runs of quiet frames that span at least so many seconds."""
    order = Window.partitionBy("rec").orderBy("i")
    runs = frames.where(quiet).withColumn("__run", F.col("i") - F.row_number().over(order))
    spans = runs.groupBy("rec", "__run").agg(F.min("t").alias("qs"), F.max("t").alias("qe"))
    return spans.where(F.col("qe") - F.col("qs") >= at_least - SLACK).select("rec", "qs", "qe")


def boundaries(supports: DataFrame, spans: DataFrame, frames: DataFrame, least_gap: float, wide: float, bucket: float = 1.0) -> DataFrame:
    """rec, tok, rule, end_t and start_t (of the next token) between neighbouring tokens with supports a to b. The longest (then the
    earliest) quiet span that covers ``least_gap`` seconds of the gap between the supports stays a pause; else a gap
    of ``wide`` seconds is cut at its quietest frame; else in the middle. Gaps meet spans and frames by time bucket."""
    order = Window.partitionBy("rec").orderBy("tok")
    gaps = supports.select("rec", "tok", F.col("b").alias("lo"), F.lead("a").over(order).alias("hi")).where("hi IS NOT NULL")

    def cells(rows: DataFrame, start: str, end: str) -> DataFrame:
        return rows.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))

    cut = cells(gaps, "lo", "hi")
    left, right = F.greatest("lo", "qs"), F.least("hi", "qe")
    met = cut.join(cells(spans, "qs", "qe"), ["rec", "__cell"]).where(right - left >= least_gap - SLACK)
    longest = F.max_by(F.struct(left.alias("l"), right.alias("r")), F.struct(F.round(right - left, 6).alias("n"), (-left).alias("s")))
    pauses = met.groupBy("rec", "tok").agg(longest.alias("p"))
    inside = cut.join(frames.withColumn("__cell", F.floor(F.col("t") / bucket)), ["rec", "__cell"]).where("t >= lo AND t < hi")
    lowest = inside.groupBy("rec", "tok").agg(F.min_by("t", F.struct("rms", "i")).alias("quietest"))
    pause, broad = F.col("p").isNotNull(), F.col("hi") - F.col("lo") >= wide - SLACK
    point = F.when(broad, F.col("quietest")).otherwise((F.col("lo") + F.col("hi")) / 2)
    return gaps.join(pauses, ["rec", "tok"], "left").join(lowest, ["rec", "tok"], "left").select(
        "rec", "tok", F.when(pause, "quiet_gap").when(broad, "quietest").otherwise("midpoint").alias("rule"),
        F.when(pause, F.col("p.l")).otherwise(point).alias("end_t"), F.when(pause, F.col("p.r")).otherwise(point).alias("start_t"),
    )


def clean_gate(d: Column, clean: Column, gap: Column, jump: Column, dominance: Column, most_gap: float = 20.001) -> Column:
    """The strict quality gate; NULL in any part fails it."""
    return F.coalesce(S.finite(d) & clean & (gap <= most_gap) & ~jump & (dominance >= 6), F.lit(False))
