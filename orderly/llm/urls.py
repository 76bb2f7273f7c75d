"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

A rule is a host suffix and a path prefix; of the rules that fit, the longest decides. Urls that no rule fits are
judged by a logistic regression on the distinct n-grams of host and path, hashed to ``slots`` weights. It is trained by
quasi-Newton steps as DataFrame jobs on a small labelled table of urls; weights are an array of bounded length and enter
the scoring plan as a constant. Main path and training use DataFrame functions only.

Null urls, empty ones and those without ``://`` have an empty host and path: no rule fits, and the model judges the
empty string. Urls are judged row by row without a shuffle, so hot hosts cost no more than their rows. Existing columns
with the names of the outputs are replaced.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderly.session import materialize

SLOTS = 4096
SIZES = (3, 4, 5)
STEPS = 15
RIDGE = 0.0002

# The rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# The labelled table: first labels of hosts that are to be blocked and that are to be allowed. Each stands on three
# hosts with an invented path.
BLOCKED = """
spam-mail spam-links spammy farm-spam cheap-meds cheap-watches pills-shop buy-pills pill-store diet-pills viagra-now
casino-royal online-casino casino-games slots-win win-big win-cash bet-now bets-online sports-bets free-cash free-prizes
free-spins free-gifts adult-video adult-chat adult-dates xxx-clips hot-xxx porn-tube ads-server ads-network track-ads
tracker-pixel click-track pop-ads loans-fast payday-loans quick-loans crypto-double lottery-win jackpot-now poker-stars
fake-bags replica-shop malware-drop phish-login seo-farm link-farm
""".split()
ALLOWED = """
news library museum garden school weather recipes history science music theatre archive forum maps travel health
parliament university letters gazette observatory botany chess cycling hiking painting photo poems bakery harbour
open-data town-hall city-museum book-club art-school sea-birds tree-guide old-maps night-train river-walk home-cooking
""".split()
# Ordinary names are also made by rule from the commonest pairs of letters in English.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
ORDINARY = [PAIRS[i % 30] + PAIRS[(7 * i + i // 30) % 30] + (PAIRS[(11 * i + 5) % 30] if i % 2 else "") for i in range(150)]
HOSTS = (("", "example.org", "/en/{}"), ("www.", "example.net", "/de/{}.html"), ("blog.", "sample.info", "/page/{}/"))


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: url, label (1: block)."""
    rows = [
        f"{label} https://{sub}{name}.{base}{path.format(17 * i + 3)}"
        for label, names in ((1, BLOCKED), (0, ALLOWED + ORDINARY))
        for i, name in enumerate(names)
        for sub, base, path in HOSTS
    ]
    row = F.explode(F.split(F.lit("\n".join(rows)), "\n"))
    return spark.range(1).select(row.alias("row")).select(F.split_part("row", F.lit(" "), F.lit(2)).alias("url"), F.split_part("row", F.lit(" "), F.lit(1)).cast("double").alias("label"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between ``://`` and the next of ``/?#``, in lower case (A-Z), and from there to the next of ``?#``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict (null: none)."""
    rule = verdict = None
    for says, suffix, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule = F.when(fits, suffix + prefix) if rule is None else rule.when(fits, suffix + prefix)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def features(host: Column, path: Column, slots: int = SLOTS) -> Column:
    """The distinct slots of the n-grams of host and path."""

    def slot_from(name: str, text: Column, size: int):
        return lambda i: F.pmod(F.xxhash64(F.lit(name), F.substring(text, i, F.lit(size))), F.lit(slots)).cast("int")

    grams = []
    for name, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.regexp_replace(path, "[0-9]+", "0"), F.lit("$")))):
        for size in SIZES:
            starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            grams.append(F.transform(starts, slot_from(name, text, size)))
    return F.array_distinct(F.concat(*grams))


def constant(weights: list[float]) -> Column:
    """An array of doubles that is folded into the plan as one literal."""
    return F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")


def margin(slots: Column, weights: list[float], bias: float) -> Column:
    """The logit: the weights' sum over the slots, divided by the root of their number, plus the bias."""
    table = constant(weights)
    total = F.aggregate(slots, F.lit(0.0), lambda acc, i: acc + F.element_at(table, i + 1))
    return total / F.sqrt(F.greatest(F.size(slots), F.lit(1))) + F.lit(bias)


def dot(a: list[float], b: list[float]) -> float:
    return math.fsum(x * y for x, y in zip(a, b, strict=True))


def train(table: DataFrame, slots: int = SLOTS, steps: int = STEPS, ridge: float = RIDGE) -> tuple[list[float], float]:
    """Weights and bias from a small labelled table (url, label), by limited-memory quasi-Newton steps on the mean
    logistic loss with a ridge. A trial is one aggregation over the table, for the loss and its slope together; it brings
    at most ``slots`` + 2 numbers to the driver, where a step is a few sums over them."""
    host, path = host_and_path(F.col("url"))
    rows = materialize(table.where("label IS NOT NULL").select(features(host, path, slots).alias("f"), "label"))
    n = max(1, rows.count())

    def loss_and_slope(w: list[float]) -> tuple[float, list[float]]:
        m = F.col("m")
        loss = F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - F.col("label") * m
        slope_at = F.lit(1.0) / (F.lit(1.0) + F.exp(-m)) - F.col("label")
        judged = rows.select("f", "label", margin(F.col("f"), w[:slots], w[slots]).alias("m")).select("f", loss.alias("loss"), slope_at.alias("e"))
        each = judged.select("loss", "e", F.size("f").alias("k"), F.explode(F.concat("f", F.array(F.lit(slots), F.lit(slots + 1)))).alias("slot"))
        part = F.when(F.col("slot") == slots, F.col("e")).when(F.col("slot") == slots + 1, F.col("loss")).otherwise(F.col("e") / F.sqrt("k"))
        sums = {r["slot"]: r["g"] / n for r in each.groupBy("slot").agg(F.sum(part).alias("g")).collect()}
        slope = [sums.get(i, 0.0) + ridge * w[i] for i in range(slots)] + [sums.get(slots, 0.0)]
        return sums.get(slots + 1, 0.0) + ridge / 2 * dot(w[:slots], w[:slots]), slope

    w = [0.0] * (slots + 1)
    value, slope = loss_and_slope(w)
    past: list[tuple[list[float], list[float]]] = []  # moves and the changes of the slope that they brought
    for _ in range(steps):
        move, weights = [-g for g in slope], []
        for s, y in reversed(past):
            share = dot(s, move) / dot(s, y)
            weights.append(share)
            move = [d - share * c for d, c in zip(move, y, strict=True)]
        if past:
            s, y = past[-1]
            scale = dot(s, y) / dot(y, y)
            move = [scale * d for d in move]
        for (s, y), share in zip(past, reversed(weights), strict=True):
            back = share - dot(y, move) / dot(s, y)
            move = [d + back * c for d, c in zip(move, s, strict=True)]
        fall, length = dot(move, slope), 1.0 if past else 1.0 / max(1e-12, math.sqrt(dot(slope, slope)))
        for _ in range(8):
            there = [x + length * d for x, d in zip(w, move, strict=True)]
            new_value, new_slope = loss_and_slope(there)
            if new_value <= value + 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        s, y = [length * d for d in move], [b - a for a, b in zip(slope, new_slope, strict=True)]
        if dot(s, y) > 1e-12:
            past = [*past[-5:], (s, y)]
        done = value - new_value < 1e-4 * value
        w, value, slope = there, new_value, new_slope
        if done:
            break
    return [round(x, 6) for x in w[:slots]], round(w[slots], 6)


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, labels: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """pages with host, path, rule, score (the model's chance of block; null where a rule decides) and verdict."""
    weights, bias = train(labelled(pages.sparkSession) if labels is None else labels, slots)
    host, path = host_and_path(F.col(url_col))
    parts = pages.withColumns({"host": host, "path": path})
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "verdict": verdict})
    logit = margin(features(F.col("host"), F.col("path"), slots), weights, bias)
    scored = ruled.withColumn("score", F.when(F.col("rule").isNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
