"""The cluster bootstrap: weights of a replicate, their moments, and intervals against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderly.operators import cohort

SEED, REPS = 20260914, 300


def single(spark, n):
    """n clusters, each a cohort of its own with one row, so that sums are weights."""
    return spark.createDataFrame([(f"c{k}", f"c{k}", 1, float(k), k % 2) for k in range(n)], "grp string, cl string, n long, total double, hits long")


def weights_plainly(hashes, replicates, bits):
    """{cluster: weights} by walking the tree from the root with all clusters at hand."""
    out = {}

    def split(names, level, prefix, drawn):
        if level == bits:
            order = sorted(names, key=lambda c: (hashes[c], c))
            for start in range(0, replicates, 50):
                w = np.random.default_rng([SEED, 2, prefix, start]).multinomial(drawn[start : start + 50], np.full(len(order), 1 / len(order)))
                for i, c in enumerate(order):
                    out.setdefault(c, []).extend(w[:, i].tolist())
            return
        halves = [[c for c in names if (hashes[c] % 2**64) >> (63 - level) & 1 == half] for half in (0, 1)]
        left = np.random.default_rng([SEED, 1, level + 1, prefix]).binomial(drawn, len(halves[0]) / len(names))
        for half, part in enumerate(halves):
            if part:
                split(part, level + 1, 2 * prefix + half, drawn - left if half else left)

    split(list(hashes), 0, 0, np.full(replicates, len(hashes)))
    return out


@pytest.mark.parametrize(("n", "per_bucket"), [(1, 10), (37, 4096), (150, 10)])
def test_weights_are_those_of_the_tree(spark, n, per_bucket):
    df = single(spark, n)
    hashes = {r.cl: r.h for r in df.select("cl", F.xxhash64("cl").alias("h")).collect()}
    reps = cohort.replicate_sums(df, "grp", "cl", REPS, per_bucket=per_bucket).toPandas()
    got = {c: p.sort_values("rep")["n"].astype(int).tolist() for c, p in reps.groupby("grp")}
    bits = max(0, int(np.ceil(np.log2(n / per_bucket))))
    assert got == weights_plainly(hashes, REPS, bits)
    assert (reps.groupby("rep")["n"].sum() == n).all() and len(reps) == n * REPS


def test_moments_of_the_weights(spark):
    n, reps = 24, 6000
    table = cohort.replicate_sums(single(spark, n), "grp", "cl", reps, per_bucket=3).toPandas().pivot(index="rep", columns="grp", values="n").to_numpy()
    assert np.allclose(table.mean(axis=0), 1, atol=0.08)
    spread = np.cov(table.T)
    assert np.allclose(np.diag(spread), 1 - 1 / n, atol=0.12)
    assert np.allclose(spread[~np.eye(n, dtype=bool)], -1 / n, atol=0.07)


def test_intervals_by_group_against_numpy(spark):
    cells = ("pa", "pb")
    rows = [(v, g, f"c{k}", 1 + (k * 7 + i) % 5, float((k * 3 + i * i) % 11) * (1 + j), (k + i) % 3) for j, v in enumerate(("x", "y")) for i, g in enumerate(cells) for k in range(40)]
    df = spark.createDataFrame(rows, "variant string, grp string, cl string, n long, total double, hits long")
    hashes = {r.cl: r.h for r in df.select("cl", F.xxhash64("cl").alias("h")).distinct().collect()}
    weights = weights_plainly(hashes, 200, 0)
    got = {(r.variant, r.grp): r for r in cohort.contrasts(df, "grp", "cl", {"p": {"pa": 1, "pb": -1}, "pa": {"pa": 1}}, 200, within=("variant",)).collect()}
    assert set(got) == {(v, t) for v in "xy" for t in ("p", "pa")}
    for v in "xy":
        mean = {}
        for g in cells:
            own = [r for r in rows if r[:2] == (v, g)]
            n, total = (sum(np.array(weights[r[2]]) * r[at] for r in own) for at in (3, 4))
            mean[g] = total / n
        low, high = np.quantile(mean["pa"] - mean["pb"], [0.025, 0.975])
        assert (got[v, "p"].mean_low, got[v, "p"].mean_high) == pytest.approx((low, high))
        assert got[v, "p"].defined == 200
    assert got["y", "pa"].mean == pytest.approx(2 * got["x", "pa"].mean)


def test_no_rows(spark):
    assert cohort.replicate_sums(single(spark, 0), "grp", "cl", 10).collect() == []
