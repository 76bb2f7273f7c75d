"""Cohort tables, breakdowns, error rates and cluster bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.operators.quantiles import exact_by
from orderly.session import materialize

MOST_COHORTS = 1000

def measures(rows: DataFrame, by: list[Column], value: Column, cluster: Column | None, shares: dict[str, float], sums: list[Column]) -> DataFrame:
    """by, sums (aggregates of ``v``), the named quantiles of the value and, if a cluster is given, the number of clusters with a value. No group meets in one task: quantiles
    go over ranges of values where groups are large, clusters are made distinct before they are counted."""
    fields = [F.struct(*by).alias("g"), value.alias("v"), *([cluster.alias("c")] if cluster is not None else [])]
    narrow = materialize(rows.select(*fields))
    out = narrow.groupBy("g").agg(*sums).join(exact_by(narrow, "g", F.col("v"), shares, written=True), "g", "left")
    if cluster is not None:
        met = narrow.where("v IS NOT NULL AND c IS NOT NULL").select("g", "c").distinct().groupBy("g").agg(F.count("*").alias("clusters"))
        out = out.join(met, "g", "left").withColumn("clusters", F.coalesce("clusters", F.lit(0).cast("long")))
    return out.select("g.*", *[c for c in out.columns if c != "g"])


def summary(rows: DataFrame, by: list[str], value: str, cluster: str, thresholds: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Per cohort: population, measured (value not NULL) and its share, clusters, median, mean, 90th percentile, and
    counts and shares of values at or above each threshold (shares of the measured; NULL where there are none)."""
    v = F.col("v")
    hits = [F.count_if(v >= k) for k in thresholds]
    n = F.count(v)
    sums = [F.count("*").alias("total"), n.alias("measured"), (n / F.count("*")).alias("measured_fraction"), F.avg(v).alias("mean")]
    counts = [h.alias(f"n_ge_{k:g}") for h, k in zip(hits, thresholds, strict=True)]
    parts = [F.try_divide(h, n).alias(f"fraction_ge_{k:g}") for h, k in zip(hits, thresholds, strict=True)]
    found = measures(rows, [F.col(c) for c in by], F.col(value), F.col(cluster), {"median": 0.5, "p90": 0.9}, [*sums, *counts, *parts])
    order = [*by, "total", "measured", "measured_fraction", "clusters", "median", "mean", "p90"]
    return found.select(*order, *[c for c in found.columns if c not in order])


def top_values(rows: DataFrame, by: list[str], value: str, order: list[str], k: int = 5) -> DataFrame:
    """The k commonest values per cohort as an array, ties by first appearance in ``order``."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen"))).where(F.col("r") <= k)
    pairs = F.sort_array(F.collect_list(F.struct("r", F.col(value).cast("string").alias("v"))))
    return ranked.groupBy(*by).agg(F.transform(pairs, lambda p: p["v"]).alias("top"))


def breakdowns(rows: DataFrame, by: str, fields: list[str], value: str, cluster: str) -> DataFrame:
    """One-dimensional breakdowns of every field within ``by``."""
    stacked = rows.select(by, value, cluster, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("level")) for f in fields])).alias("x"))
    v, keys = F.col("v"), [F.col(by), F.col("x.field").alias("field"), F.col("x.level").alias("level")]
    sums = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.count_if(v >= 2).alias("n_ge_2")]
    return measures(stacked, keys, F.col(value), F.col(cluster), {"median": 0.5}, sums).select(by, "field", "level", "n", "clusters", "median", "mean", "n_ge_2")


def error_rates(rows: DataFrame, group: str, errors: str, length: str) -> DataFrame:
    """One row: the micro rate over all rows and the mean of the groups' rates."""
    each = rows.groupBy(group).agg(F.sum(errors).alias("e"), F.sum(length).alias("n"))
    return each.agg(
        F.try_divide(F.sum("e"), F.sum("n")).alias("micro"),
        F.avg(F.try_divide(F.col("e"), F.col("n"))).alias("macro"),
        F.count("*").alias("groups"),
    )


def cluster_statistics(rows: DataFrame, clusters: DataFrame, by: str, cluster: str, value: str) -> DataFrame:
    """Sufficient statistics of every cluster in every cohort; clusters without rows stay, with zeros."""
    v = F.col(value)
    found = rows.groupBy(by, cluster).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.count_if(v >= 2).alias("hits"))
    names = [r[0] for r in rows.where(F.col(by).isNotNull()).select(by).distinct().limit(MOST_COHORTS + 1).collect()]
    if len(names) > MOST_COHORTS:
        raise ValueError(f"more than {MOST_COHORTS} cohorts: every cluster has a row for each")
    cohorts = F.array(*map(F.lit, names)) if names else F.array().cast(T.ArrayType(rows.schema[by].dataType))
    grid = clusters.select(cluster).distinct().withColumn(by, F.explode(cohorts))
    return grid.join(found, [by, cluster], "left").select(
        by, cluster, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("hits", F.lit(0)).alias("hits")
    )


def drawn_totals(seed: int, replicates: int, bucket: int, sizes: list[int]) -> np.ndarray:
    """How many draws of each replicate fall to a bucket's clusters. sizes are the numbers of clusters under the bucket's
    prefixes, from none of its bits (all clusters) to all of them. Every prefix splits its draws between its two halves by one binomial
    draw from a stream seeded by the prefix, which both halves repeat."""
    drawn, bits = np.full(replicates, sizes[0]), len(sizes) - 1
    for level in range(1, bits + 1):
        prefix, right = bucket >> (bits - level + 1), bucket >> (bits - level) & 1
        left = sizes[level - 1] - sizes[level] if right else sizes[level]
        first = np.random.default_rng([seed, 1, level, prefix]).binomial(drawn, left / sizes[level - 1])
        drawn = drawn - first if right else first
    return drawn


def drawn_weights(seed: int, bucket: int, start: int, drawn: np.ndarray, clusters: int) -> np.ndarray:
    """Weights of a bucket's clusters in the replicates from start on, a row for each number of draws."""
    return np.random.default_rng([seed, 2, bucket, start]).multinomial(drawn, np.full(clusters, 1 / clusters))


def replicate_sums(
    statistics: DataFrame, by: str, cluster: str, replicates: int = 2000, seed: int = 20260914, block: int = 50, within: tuple[str, ...] = (), per_bucket: int = 4096
) -> DataFrame:
    """within, by, rep, n, total, hits: weighted sums of every cohort in every replicate of a cluster bootstrap, which draws as many
    clusters as there are, with replacement. Draws are split down a binary tree over hashed clusters, so the weights of a replicate add up to the
    number of clusters though no task holds them all: a task has a bucket of about ``per_bucket`` and draws their
    weights once for all cohorts, ``block`` replicates at a time."""
    keys = [*within, by]
    hashed = statistics.withColumn("__h", F.xxhash64(cluster))
    clusters = materialize(hashed.select("__h", F.col(cluster).alias("__c")).distinct())
    bits = max(0, int(np.ceil(np.log2(max(clusters.count(), 1) / per_bucket))))

    def prefix(level: Column | int) -> Column:
        """The first bits of a hash."""
        return F.shiftrightunsigned("__h", 64 - level) if level else F.lit(0).cast("long")

    counts = clusters.groupBy(prefix(bits).alias("__b")).count()
    above = counts.select("count", F.posexplode(F.sequence(F.lit(0), F.lit(bits))).alias("__p", "level"), "__b")
    node = F.expr(f"shiftright(__b, {bits} - level)")
    sized = above.withColumn("node", node).groupBy("level", "node").agg(F.sum("count").alias("size"))
    paths = above.select("__b", "level", node.alias("node")).join(sized, ["level", "node"]).groupBy("__b").agg(F.sort_array(F.collect_list(F.struct("level", "size"))).alias("path"))

    def summed(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        bucket, sizes = int(path["__b"].iloc[0]), [int(x["size"]) for x in path["path"].iloc[0]]
        drawn = drawn_totals(seed, replicates, bucket, sizes)
        rows = rows.assign(place=rows.groupby(["__h", cluster], dropna=False).ngroup())
        out = []
        parts = [(key, part["place"].to_numpy(), part[["n", "total", "hits"]].to_numpy(float)) for key, part in rows.groupby(keys, dropna=False)]
        for start in range(0, replicates, block):
            weights = drawn_weights(seed, bucket, start, drawn[start : start + block], sizes[-1])
            for key, place, values in parts:
                sums = weights[:, place] @ values
                names = dict(zip(keys, key, strict=True))
                out.append(pd.DataFrame({**names, "rep": np.arange(start, start + len(sums), dtype=np.int32), "n": sums[:, 0], "total": sums[:, 1], "hits": sums[:, 2]}))
        return pd.concat(out)

    types = [f"{k} {statistics.schema[k].dataType.simpleString()}" for k in keys]
    rows = hashed.select(*keys, "n", "total", "hits", cluster, "__h", prefix(bits).alias("__b"))
    sums = rows.groupBy("__b").cogroup(paths.groupBy("__b")).applyInPandas(summed, ", ".join([*types, "rep int, n double, total double, hits double"]))
    return sums.groupBy(*keys, "rep").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("hits").alias("hits"))


def bootstrap(statistics: DataFrame, by: str, cluster: str, replicates: int = 2000, seed: int = 20260914, block: int = 50) -> DataFrame:
    """Percentile intervals of the mean and the hit share of every cohort by a cluster bootstrap."""
    reps = replicate_sums(statistics, by, cluster, replicates, seed, block)
    rates = reps.select(by, F.try_divide("total", "n").alias("mean"), F.try_divide("hits", "n").alias("share"))
    return rates.groupBy(by).agg(
        *[F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("mean", "share") for q, name in ((0.025, "low"), (0.975, "high"))]
    )


def contrasts(
    statistics: DataFrame, by: str, cluster: str, terms: dict[str, dict[str, int]], replicates: int = 2000, seed: int = 20260914, block: int = 50, within: tuple[str, ...] = ()
) -> DataFrame:
    """within, by, and for mean and share the estimate and its percentile interval, of every term: a sum of cohorts with signs, formed
    within each replicate. defined counts the replicates in which all its cohorts have rows; the others have no value. All cohorts and
    all groups of within see the same weights."""
    reps = replicate_sums(statistics, by, cluster, replicates, seed, block, within)
    sums = [F.sum(c).cast("double").alias(c) for c in ("n", "total", "hits")]
    whole = statistics.groupBy(*within, by).agg(F.lit(-1).alias("rep"), *sums)
    cohorts = sorted({c for signs in terms.values() for c in signs})
    rates = {"mean": F.try_divide("total", "n"), "share": F.try_divide("hits", "n")}
    of = {(m, c): f"{m}_{k}" for m in rates for k, c in enumerate(cohorts)}
    wide = reps.unionByName(whole).groupBy(*within, "rep").agg(*[F.max(F.when(F.col(by) == c, rates[m])).alias(name) for (m, c), name in of.items()])

    def value(metric: str, signs: dict[str, int]) -> Column:
        first, *rest = [F.col(of[metric, c]) * sign for c, sign in signs.items()]
        return sum(rest, first).alias(metric)

    rows = F.array(*[F.struct(F.lit(t).alias(by), *[value(m, signs) for m in rates]) for t, signs in terms.items()])
    long = wide.select(*within, "rep", F.inline(rows))
    drawn = {m: F.when(F.col("rep") >= 0, F.col(m)) for m in rates}
    return long.groupBy(*within, by).agg(
        *[
            c
            for m in rates
            for c in (
                F.max(F.when(F.col("rep") < 0, F.col(m))).alias(m),
                *[F.percentile(drawn[m], F.lit(q)).alias(f"{m}_{name}") for q, name in ((0.025, "low"), (0.975, "high"))],
            )
        ],
        F.count(drawn["mean"]).alias("defined"),
    )
