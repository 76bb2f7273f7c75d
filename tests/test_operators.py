"""Known answers of the ordered-data operators on small tables made by hand."""

import hashlib
import itertools
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderly.functions import scalar as S
from orderly.operators import checks, cohort, frames, intervals, lexicon, measure, quantiles, seqdp, split
from orderly.plans import catalog
from orderly.sources import readers, writers
from orderly.streaming import logs


def track(spark, values, rec=1):
    rows = [(rec, k, float(k) * 0.01, None if v is None else float(v)) for k, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "rec long, i long, t double, f double")


def test_levels_at_edges(spark):
    edges = [100.0 * 2**k for k in range(6)]
    values = [99.0, 199.99, edges[1], 800 - 1e-9, edges[4] * 1.0, 4000.0]
    df = spark.createDataFrame([(v,) for v in values], "f double").withColumn("e", F.array(*[F.lit(x) for x in edges]))
    assert [r[0] for r in df.select(S.band(F.col("f"), F.col("e"))).collect()] == [1, 1, 2, 3, 5, 5]


def test_level_of_bin_centres(spark):
    bounds = spark.createDataFrame([(100.0, 3200.0)], "lo double, hi double")
    centres = track(spark, [math.sqrt(100 * 2**k * 100 * 2 ** (k + 1)) for k in range(5)])
    assert [r.level for r in frames.five_level(centres, bounds).orderBy("i").collect()] == [1, 2, 3, 4, 5]


def test_jump_masks_around_the_pair(spark):
    out = frames.jump_mask(track(spark, [100, 100, 100, 200, 200, 200, 200])).orderBy("i").collect()
    assert [r.jump for r in out] == [False, True, True, True, True, False, False]


def test_runs_of_five(spark):
    mask = "0111101111100"
    df = track(spark, [1.0] * len(mask)).withColumn("m", F.substring(F.lit(mask), F.col("i").cast("int"), F.lit(1)) == "1")
    assert [(r.start, r.end) for r in frames.runs(df, "m", 5).collect()] == [(7, 12)]
    assert frames.runs(df, "m").count() == 2


def test_gap_filling(spark):
    got = [r.f_filled for r in frames.fill_gaps(track(spark, [0, None, None, 3]), "f").orderBy("i").collect()]
    assert got == pytest.approx([0, 1, 2, 3])
    wide = [r.f_filled for r in frames.fill_gaps(track(spark, [0, None, None, None, None, 5]), "f").orderBy("i").collect()]
    assert wide[1:5] == [None] * 4


def smooth_by_hand(values, runs):
    """Median of five with repeated ends, then the parabola fitted to the nearest window, run by run."""
    out = {}
    for start, end in runs:
        y = np.array(values[start:end], float)
        n = len(y)
        padded = np.pad(y, 2, mode="edge")
        med = np.array([np.median(padded[k : k + 5]) for k in range(n)])
        w = min(9, n if n % 2 else n - 1)
        for k in range(n):
            c = min(max(k, w // 2), n - 1 - w // 2)
            x = np.arange(c - w // 2, c + w // 2 + 1)
            out[start + k + 1] = (med[k], np.polyval(np.polyfit(x - k, med[x], 2), 0))
    return out


def test_smoothing_stays_within_runs(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(100, 10, 23), None, *rng.normal(90, 9, 6), None, *rng.normal(80, 9, 4), None, None, *rng.normal(70, 5, 5), None, *rng.normal(60, 5, 8)]
    expected = smooth_by_hand(values, [(0, 23), (24, 30), (37, 42), (43, 51)])
    runs = frames.median5(frames.whole_runs(track(spark, values), "f"), "f")
    got = {r.i: (r.f_median, r.f_median_smooth) for r in frames.savgol9(runs, "f_median").collect()}
    assert set(got) == set(expected)
    for i, pair in expected.items():
        assert got[i] == pytest.approx(pair)
    interior = frames.smoothing_weights(9)[4]
    assert interior == pytest.approx([w / 231 for w in (-21, 14, 39, 54, 59, 54, 39, 14, -21)])


def test_moving_rms_repeats_the_ends(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    for half in (1, 2):
        rows = frames.moving_rms(frames.moving_rms(track(spark, values), "f", half).withColumnRenamed("f_rms", "near"), "f", half, True).orderBy("i").collect()
        for mode, name in (("edge", "near"), ("constant", "f_rms")):
            padded = np.pad(np.square(values), half, mode=mode)
            assert [r[name] for r in rows] == pytest.approx([np.sqrt(padded[k : k + 2 * half + 1].mean()) for k in range(5)])


def test_screen_needs_runs_of_five(spark):
    df = track(spark, [100.0] * 4 + [0.0] + [100.0] * 5 + [None] + [100.0]).withColumns({"strength": F.lit(1.0), "rms": F.lit(0.0)})
    assert [r.i for r in frames.screen(df).where("reliable").orderBy("i").collect()] == [6, 7, 8, 9, 10]


def test_zero_frequencies_and_flat_ranges_give_null(spark):
    df = spark.createDataFrame([(0.0, 100.0, 50.0), (100.0, 0.0, 50.0), (100.0, 100.0, 50.0)], "f double, g double, lo double")
    row = df.select(S.cents(F.col("f"), F.col("g")).alias("c"), S.semitones(F.col("f")).alias("s"), S.t_value(F.col("f"), F.col("lo"), F.col("lo")).alias("t"), S.log_z(F.col("f"), F.col("lo"), F.lit(0.0)).alias("z")).collect()
    assert [r.c for r in row] == [None, None, 0.0] and [r.s for r in row] == [None, 0.0, 0.0]
    assert [r.t for r in row] == [None] * 3 and [r.z for r in row] == [None] * 3
    flat = frames.five_level(track(spark, [100.0, 100.0]), frames.log_bounds(track(spark, [100.0, 100.0]))).collect()
    assert [r.t_value for r in flat] == [None] * 2


def onset(spark, values, b, mode, skip=()):
    rows = [(1, 0.0, b, k * 0.01, float(v)) for k, v in enumerate(values) if k not in skip]
    return measure.onset(spark.createDataFrame(rows, "tok long, a double, b double, t double, f double"), ["tok"], mode).first()


def test_onset_measures(spark):
    values = [200] * 6 + [100] * 6
    one = onset(spark, values, 0.12, "fixed")
    assert (one.d_st, one.head_n, one.body_n) == (pytest.approx(12), 3, 6) and one.elapsed_ms == pytest.approx(75) and one.descent_st_s == pytest.approx(160)
    assert onset(spark, values, 0.10, "fixed").reason == "rime_shorter_than_120ms"
    assert onset(spark, values, 0.12, "fixed", (0, 1)).reason == "insufficient_voicing"
    two = onset(spark, values, 0.095, "adaptive")
    assert (two.d_st, two.head_n, two.body_n) == (pytest.approx(12), 3, 3)


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 7, "c")], "k long, t long, name string")
    right = spark.createDataFrame([(1, 6, 1), (1, 10, 2), (1, 10, 3), (3, 1, 4)], "k long, rt long, id long")
    got = {r["name"]: r.id for r in intervals.asof(left, right, "k", "t", "rt", "id").collect()}
    assert got == {"a": 3, "b": None, "c": None}
    grid = spark.createDataFrame([(1, 1, 0.014), (1, 2, 0.026)], "k0 long, k long, t2 double").withColumnRenamed("k0", "key")
    points = spark.createDataFrame([(1, 0.01), (1, 0.02)], "key long, t double")
    got = {r.t: r.matched for r in intervals.nearest_on_grid(points, grid, "key", 0.01, 0.0051).collect()}
    assert got == {0.01: True, 0.02: False}


def test_union_length(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 3, 4), (1, 6, 7)], "k long, s long, e long")
    row = intervals.union_length(df, "k", "s", "e").first()
    assert (row.islands, row.length) == (2, 5)


def test_interval_join_keeps_unmatched_points(spark):
    points = spark.createDataFrame([(1, 0.05), (1, 0.5)], "k long, t double")
    spans = spark.createDataFrame([(1, 0.0, 0.1, "x")], "k long, a double, b double, name string")
    got = {r.t: r.name for r in intervals.in_intervals(points, spans, "k", "t", "a", "b", 0.03, "left").collect()}
    assert got == {0.05: "x", 0.5: None}


def test_collapse_and_feasible(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 2, 2, 0], [1, 1, 2])], "a array<int>, b array<int>")
    row = df.select(S.collapse(F.col("a")), S.feasible_frames(F.col("b"))).first()
    assert row[0] == [1, 1, 2] and row[1] == 4


def test_error_rates(spark):
    df = spark.createDataFrame([("g1", 1, 10), ("g1", 1, 10), ("g2", 2, 4)], "g string, e int, n int")
    row = cohort.error_rates(df, "g", "e", "n").first()
    assert row.micro == pytest.approx(4 / 24) and row.macro == pytest.approx(0.3)


def test_bootstrap_brackets_the_mean(spark):
    rows = [("a", f"c{k}", 10, float(10 * (k % 5)), k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "grp string, cl string, n long, total double, hits long")
    row = cohort.bootstrap(df, "grp", "cl", 400).first()
    assert row.mean_low < 2.0 < row.mean_high and row.share_low < 0.1 < row.share_high


def test_contrasts_against_numpy(spark):
    cells = ("pa", "pb", "qa", "qb")
    rows = [(g, f"c{k}", 1 + (k * 7 + i) % 5, float((k * 3 + i * i) % 11), (k + i) % 3) for i, g in enumerate(cells) for k in range(20)]
    df = spark.createDataFrame(rows, "grp string, cl string, n long, total double, hits long")
    terms = {"p": {"pa": 1, "pb": -1}, "interaction": {"pa": 1, "pb": -1, "qa": -1, "qb": 1}}
    got = {r.grp: r for r in cohort.contrasts(df, "grp", "cl", terms, 200).collect()}
    reps = cohort.replicate_sums(df, "grp", "cl", 200).toPandas().sort_values("rep")
    for k, (metric, top) in enumerate((("mean", "total"), ("share", "hits"))):
        drawn = {g: (p[top] / p["n"]).to_numpy() for g, p in reps.groupby("grp")}
        whole = {g: sum(r[3 + k] for r in rows if r[0] == g) / sum(r[2] for r in rows if r[0] == g) for g in cells}
        for name, signs in terms.items():
            low, high = np.quantile(sum(s * drawn[g] for g, s in signs.items()), [0.025, 0.975])
            assert (got[name][f"{metric}_low"], got[name][f"{metric}_high"]) == pytest.approx((low, high))
            assert got[name][metric] == pytest.approx(sum(s * whole[g] for g, s in signs.items()))
    assert got["p"].defined == 200


def test_bootstrap_query_has_all_contrasts(spark, tmp_path):
    docs = [(k, "en", f"s{k % 9}", 300 + 37 * k % 5000) for k in range(1, 200)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k // 2 % 2, k % 2) for k in range(1, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.variant, r.grp): r for r in catalog.QUERIES["A20_bootstrap_ci"](spark, str(tmp_path)).collect()}
    named = {"good_effect_clean", "good_effect_toxic", "toxic_effect_poor", "toxic_effect_good", "interaction"}
    assert {v for v, _ in got} == {"agreement", "strict"} and named <= {g for _, g in got} and len(got) == 18
    point = catalog.QUERIES["A20_point"](spark, str(tmp_path)).first()
    assert got["agreement", "interaction"].mean == pytest.approx(point.interaction, abs=1e-6)
    assert all(r.mean_low < r.mean_high and r.defined > 0 for r in got.values())
    assert got["strict", "interaction"].mean != got["agreement", "interaction"].mean


def test_lattice_and_paths():
    logp = np.full((5, 3), -12.0)
    for t, label in enumerate([0, 1, 0, 1, 0]):
        logp[t, label] = 0
    path, score = seqdp.align_lattice(logp, [[[2], [1]], [[1]]])
    assert score == 0 and path[1] == (0, 1, 1) and path[2][2] == 0
    with pytest.raises(ValueError, match="no complete path"):
        seqdp.align_ctc(logp[:2], [1, 1])
    states, best = seqdp.align_ctc(logp, [1, 1])
    assert states == [0, 1, 2, 3, 4] and best == 0


def test_ctc_against_all_paths():
    rng = np.random.default_rng(3)
    import itertools

    logp, labels = np.log(rng.dirichlet(np.ones(3), 5)), [1, 1]
    best = max(
        sum(logp[t, s] for t, s in enumerate(p))
        for p in itertools.product(range(3), repeat=5)
        if [s for k, s in enumerate(p) if s and (k == 0 or p[k - 1] != s)] == labels
    )
    assert seqdp.align_ctc(logp, labels)[1] == pytest.approx(best)


def test_edit_operations():
    assert seqdp.edit_operations(list("abc"), list("acd")) == [("match", 0, 0), ("substitution", 1, 1), ("substitution", 2, 2)]


def test_edit_operations_of_whole_texts(spark, tmp_path):
    texts = [" ".join(f"w{k % 7}" for k in range(90)), " ".join(f"w{k % 5}" for k in range(70)) + " end"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalog.QUERIES["J16_edit_alignment"](spark, str(tmp_path)).collect()
    assert sorted(r.i for r in rows if r.i >= 0) == list(range(90)) and sorted(r.j for r in rows if r.j >= 0) == list(range(71))
    a, b = (t.split(" ") for t in texts)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    assert sum(r.op != "match" for r in rows) == row[-1]


def test_lexicon_hits_of_whole_texts(spark, tmp_path):
    texts = ["peru " * 30 + "chad", "", "x" * 60 + "perux"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([("PERU",), ("CHAD",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {(r.item_id, r.i): (r.hits, r.whole) for r in catalog.QUERIES["J9_lexicon"](spark, str(tmp_path)).collect()}
    expected = {}
    for k, text in enumerate(texts):
        for i, ch in enumerate(text):
            at = [(w, i - j) for w in ("peru", "chad") for j, c in enumerate(w) if c == ch]
            if at:
                expected[k, i] = (len(at), sum(p >= 0 and text.startswith(w, p) for w, p in at))
    assert got == expected and max(i for _, i in got) == 153


def test_rare_tokens_are_counted(spark, tmp_path):
    docs = [(1, "en", "a b a once"), (2, "fr", "a"), (3, "en", "b " * 30)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.w): r.n for r in catalog.QUERIES["A14_tokens"](spark, str(tmp_path)).collect()}
    assert got == {("en", "a"): 2, ("en", "b"): 31, ("en", "once"): 1, ("fr", "a"): 1}


def test_targets_find_hills_and_valleys():
    t = np.arange(60) * 0.01
    found = seqdp.find_targets(3 * np.sin(t * 2 * np.pi / 0.3), t)
    assert [(r["label"], r["edge_context"]) for r in found] == [("H", True), ("L", False), ("H", False), ("L", True)]
    assert seqdp.find_targets(np.zeros(5), t[:5]) == []


def slow_targets(y, t):
    """The definition, frame by frame."""
    n, rows = len(y), []
    for label, s in (("H", y), ("L", -y)):
        peaks = []
        for i in range(1, n - 1):
            j = i
            while j + 1 < n and s[j + 1] == s[i]:
                j += 1
            if s[i] > s[i - 1] and j + 1 < n and s[j + 1] < s[i]:
                peaks.append((i + j) // 2)
        kept = []
        for p in sorted(peaks, key=lambda p: (-s[p], p)):
            if all(abs(p - q) >= 12 for q in kept):
                kept.append(p)
        for p in sorted(kept):
            bases = []
            for side in (range(p - 1, -1, -1), range(p + 1, n)):
                low = s[p]
                for q in side:
                    if s[q] > s[p]:
                        break
                    low = min(low, s[q])
                bases.append(low)
            if s[p] - max(bases) >= 0.8 and 3 <= p < n - 3:
                rows.append((label, p, s[p] - max(bases), False))
    w = min(25, n // 2)
    for k, near, far in ((2, y[:5], y[w - 3 : w + 2]), (n - 3, y[-5:], y[n - w - 2 : n - w + 3])):
        d = np.median(near) - np.median(far)
        if abs(d) >= 1.2:
            rows.append(("H" if d > 0 else "L", k, abs(d), True))
    chosen = []
    for r in sorted(rows, key=lambda r: -r[2]):
        if all(r[0] != c[0] or abs(t[r[1]] - t[c[1]]) >= 0.12 for c in chosen):
            chosen.append(r)
    out = []
    for label, k, height, at_edge in sorted(chosen, key=lambda r: r[1]):
        near = [abs(v - y[k]) <= 0.15 for v in y]
        a = next((q + 1 for q in range(k, -1, -1) if not near[q]), 0)
        b = next((q - 1 for q in range(k, n) if not near[q]), n - 1)
        out.append((label, k, pytest.approx(height), t[a], t[b], t[b] - t[a] >= 0.1, at_edge))
    return out


def test_targets_against_the_definition(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for run in range(12):
        y = np.round(np.cumsum(rng.normal(0, 0.6, int(rng.integers(10, 90)))), 1)  # rounded: plateaus occur
        t = np.arange(len(y)) * 0.01
        expected[run % 3, run] = slow_targets(y, t)
        rows += [(run % 3, run, float(a), float(b)) for a, b in zip(t, y)]
    got = {}
    for r in seqdp.targets(spark.createDataFrame(rows, "rec long, run long, t double, y double"), "rec").collect():
        got.setdefault((r.rec, r.run), []).append((r.label, r.k, r.prominence, r.start, r.end, r.plateau, r.edge_context))
    assert {k: sorted(v, key=lambda r: r[1]) for k, v in got.items()} == {k: v for k, v in expected.items() if v}
    assert any(r[-1] for v in got.values() for r in v) and any(not r[-1] for v in got.values() for r in v)


def lattice_readings(chars, first_only):
    return {tuple(x for o in pick for x in o) for pick in itertools.product(*[c[:1] if first_only else c for c in chars])}


@pytest.mark.parametrize("first_only", [False, True])
def test_lattice_against_all_paths(first_only):
    rng = np.random.default_rng(11)
    for _ in range(40):
        logp = np.log(rng.dirichlet(np.ones(3), int(rng.integers(2, 7))))
        chars = [[rng.integers(1, 3, rng.integers(1, 3)).tolist() for _ in range(rng.integers(1, 4))] for _ in range(rng.integers(1, 3))]
        wanted = lattice_readings(chars, first_only)
        scores = [
            sum(logp[t, s] for t, s in enumerate(p))
            for p in itertools.product(range(3), repeat=len(logp))
            if tuple(s for k, s in enumerate(p) if s and (k == 0 or p[k - 1] != s)) in wanted
        ]
        if not scores:
            with pytest.raises(ValueError, match="no complete path"):
                seqdp.lattice_path(logp, chars, first_only=first_only)
            continue
        path = seqdp.lattice_path(logp, chars, first_only=first_only)
        assert path.score == pytest.approx(max(scores)) == sum(logp[t, s] for t, s in enumerate(path.label))
        said = seqdp.evidence(logp, path, np.arange(len(logp)) * 0.02, 0.02, 0.05)
        assert [[x["label"] for x in c["labels"]] for c in said] == [chars[c["char"]][c["option"]] for c in said] and len(said) == len(chars)


def test_evidence_by_hand():
    logp = np.log(np.array([[0.1, 0.8, 0.1], [0.1, 0.6, 0.3], [0.8, 0.1, 0.1], [0.1, 0.2, 0.7]]))
    path = seqdp.lattice_path(logp, [[[1]], [[2]]])
    one, two = seqdp.evidence(logp, path, np.array([0.01, 0.03, 0.05, 0.07]), 0.02, 0.075)
    assert (one["start"], one["end"]) == pytest.approx((0.0, 0.04)) and (two["start"], two["end"]) == pytest.approx((0.06, 0.075))
    assert one["anchor"] == pytest.approx((0.8 * 0.01 + 0.6 * 0.03) / 1.4) and one["posterior"] == pytest.approx(0.7) and two["labels"][0]["peak"] == pytest.approx(0.7)


def test_edit_distance_of_lists():
    assert seqdp.edit_distance(["ab", "c"], ["ab", "d", "c"]) == 1 and seqdp.edit_distance([], [1, 2]) == 2
    assert seqdp.edit_operations(["a", "b"], ["b"]) == [("deletion", 0, -1), ("match", 1, 0)]


def test_quantiles_by_group_over_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [("a", float(v)) for v in np.round(rng.normal(size=3000), 2)] + [("b", float(k % 2)) for k in range(40)] + [("c", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.05, "half": 0.5, "top": 1.0}
    for most in (10, 10**6):
        got = {r.g: (r.low, r.half, r.top) for r in quantiles.exact_by(df, "g", F.col("v"), shares, most).collect()}
        assert set(got) == {"a", "b", None}
        for g in ("a", "b", None):
            assert got[g] == pytest.approx(tuple(np.quantile([v for k, v in rows if k == g], list(shares.values()))))
    share = quantiles.ranked_share(df.where("v IS NOT NULL").withColumn("k", F.monotonically_increasing_id()), "g", "v", "k").collect()
    assert sorted(r.share for r in share if r.g == "b") == pytest.approx([(k + 1) / 40 for k in range(40)])


def test_parse_needs_one_reading(spark):
    initials = spark.createDataFrame([("", ""), ("p", "p"), ("ph", "P")], "initial string, initial_ipa string")
    finals = spark.createDataFrame([("a", "a"), ("ha", "ha")], "final string, final_ipa string")
    aliases = spark.createDataFrame([("q", "pa")], "spelling string, alias string")
    spelled = spark.createDataFrame([("pa",), ("pha",), ("q",), ("zo",)], "spelling string")
    got = {r.spelling: (r.parses, r.ipa) for r in lexicon.parse_syllables(spelled, initials, finals, aliases).collect()}
    assert got == {"pa": (1, "pa"), "pha": (2, None), "q": (1, "pa"), "zo": (0, None)}
    specials, conditioned = spark.createDataFrame([("pha", "a")], "spelling string, final string"), spark.createDataFrame([("pa", "ph", "ha")], "spelling string, initial string, final string")
    got = {r.spelling: (r.initial, r.final, r.method) for r in lexicon.parse_syllables(spelled, initials, finals, aliases, specials, conditioned).collect()}
    assert got == {"pa": ("ph", "ha", "conditioned"), "pha": ("", "a", "special"), "q": ("ph", "ha", "conditioned"), "zo": (None, None, None)}


def test_status_cascade_and_splits(spark):
    df = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True), (False, False, False)], "m boolean, c boolean, x boolean")
    got = [r[0] for r in df.select(split.status(F.col("m"), F.col("c"), F.col("x"))).collect()]
    assert got == ["excluded_missing_audio", "excluded_duplicate_audio_conflict", "excluded_explicit", "ready"]
    rows = spark.createDataFrame([(f"g{k % 30}", ["a", "b" if k % 2 else "c"]) for k in range(300)], "g string, tokens array<string>")
    parts = {r.g: r.split for r in split.greedy(rows, "g", "tokens").collect()}
    counts = {s: 10 * list(parts.values()).count(s) for s in ("train", "dev", "test")}
    assert len(parts) == 30 and counts["dev"] == 30 and counts["test"] == 30


def greedy_by_hand(rows, seed="1", share=0.1):
    sizes, have, counts = Counter(g for g, _ in rows), Counter(t for _, ts in rows for t in ts or []), {}
    for g, ts in rows:
        counts.setdefault(g, Counter()).update(ts or [])
    out, target = dict.fromkeys(sizes, "train"), round(len(rows) * share)
    for name in ("dev", "test"):
        filled = 0
        for g in sorted(sizes, key=lambda g: hashlib.sha256(f"{seed}{g}".encode()).hexdigest()):
            if out[g] == "train" and filled + sizes[g] <= target and all(have[t] > n for t, n in counts[g].items()):
                out[g] = name
                filled += sizes[g]
                have.subtract(counts[g])
    return out


@pytest.mark.parametrize("case", ["large", "rare", "sizes"])
def test_greedy_split_looks_at_all_groups(spark, case):
    groups = sorted((f"g{k}" for k in range(60)), key=lambda g: hashlib.sha256(f"1{g}".encode()).hexdigest())
    rows = [(g, ["a", "b" if k % 3 else "c"]) for k, g in enumerate(groups) for _ in range(1 + k % 4 * (case == "sizes"))]
    if case == "large":  # first in hash order, more than 40 % of all rows
        rows += [(groups[0], ["a"])] * 60
    if case == "rare":  # the first half hold tokens that nobody else has
        rows = [(g, ts + [g] * (k < 30)) for k, (g, ts) in enumerate(rows)]
    if case == "sizes":  # the first groups fit no more once dev is nearly full
        rows += [(groups[2], None)] * 9 + [(groups[5], [])] * 3
    df = spark.createDataFrame(rows, "g string, tokens array<string>")
    got = {r.g: r.split for r in split.greedy(df, "g", "tokens", block=7).collect()}
    assert got == greedy_by_hand(rows) and {"dev", "test"} <= set(got.values())


def test_checks(spark):
    left = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3)], "path string, sha256 string, bytes long")
    right = spark.createDataFrame([("a", "1", 1), ("b", "x", 2), ("d", "4", 4)], "path string, sha256 string, bytes long")
    assert {r.path: r.problem for r in checks.manifest_diff(left, right).collect()} == {"b": "hash", "c": "missing", "d": "unexpected"}
    one, two = (checks.fingerprint(df).first() for df in (left, left.orderBy(F.desc("path"))))
    assert one == two


def test_early_stop(spark):
    df = spark.createDataFrame([([(1, 0.05), (2, 0.0495), (3, 0.048), (4, 0.0479), (5, 0.0478)],)], "p array<struct<step:long,value:double>>")
    s = df.select(logs.early_stop_fold(F.col("p"), 0.001, 2).alias("s")).first().s
    assert (s.best, s.stale, s.stopped_at) == (0.048, 2, 5)


def test_stream_keeps_state(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    for n, lines in enumerate((['{"run":"a","step":1,"value":0.5}', "no json"], ['{"run":"a","step":2,"value":0.5}', '{"run":"a","step":3,"value":0.5}'])):
        (src / f"{n}.json").write_text("\n".join(lines))
        os.utime(src / f"{n}.json", (1_000_000 + n, 1_000_000 + n))  # files are taken by age
    stream = logs.tail(spark, str(src), "run string, step long, value double").where("run IS NOT NULL")
    q = logs.early_stop_stream(stream, "run", 0.01, 2).writeStream.outputMode("update").format("memory").queryName("stops").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert max(r.stopped_at for r in spark.sql("SELECT * FROM stops").collect()) == 3


def test_audio_headers_and_manifest(spark, tmp_path):
    import hashlib
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\0" * 400)
    row = readers.audio_headers(spark, str(tmp_path)).first()
    assert (row.bytes, row.channels, row.rate, row.bits) == (444, 2, 16000, 16)
    assert checks.manifest(spark, str(tmp_path)).first().sha256 == hashlib.sha256((tmp_path / "a.wav").read_bytes()).hexdigest()


def test_strict_readers_and_writers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\ufefffile_name,text\na.wav,hello\n", encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "x.csv"), "file_name string, text string", exact=True).first().text == "hello"
    with pytest.raises(Exception):
        readers.csv(spark, str(tmp_path / "x.csv"), "name string, text string", exact=True).collect()
    with pytest.raises(Exception, match="not finite"):
        writers.json(spark.createDataFrame([(float("nan"),)], "v double"), str(tmp_path / "nan"))


def test_exact_quantiles_close_in(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.lognormal(size=30_000), 3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    shares = (0.0, 0.05, 0.5, 0.9501, 1.0)
    assert quantiles.exact(df, F.col("v"), shares, most=500) == pytest.approx([float(np.quantile(values, s)) for s in shares])
    ties = spark.range(5000).select((F.col("id") % 2).cast("double").alias("v"))
    assert quantiles.exact(ties, F.col("v"), (0.25, 0.75), most=100) == [0.0, 1.0]
    assert quantiles.exact(ties.limit(0), F.col("v"), (0.5,)) == [None]


def test_first_of_overlapping_intervals(spark):
    points = spark.createDataFrame([(1, 0.05), (1, 0.15), (1, 0.95), (2, 0.15)], "k long, t double")
    spans = spark.createDataFrame([(1, 0.0, 0.2, "b"), (1, 0.1, 0.3, "a"), (1, 0.0, 0.0, "c")], "k long, a double, b double, name string")
    got = {(r.k, r.t): r.name for r in intervals.first_in_intervals(points, spans, "k", "t", "a", "b", 0.07, "name").collect()}
    assert got == {(1, 0.05): "b", (1, 0.15): "a", (1, 0.95): None, (2, 0.15): None}


def test_zip_stops_with_the_shorter_and_fails_where_sides_differ(spark):
    left = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "u long, k long, ch string")
    right = spark.createDataFrame([(1, 1, "x", 5), (1, 2, "y", 6)], "u long, k long, ch string, v long")
    assert sorted((r.k, r.ch, r.v) for r in intervals.zip_positions(left, right, ["u", "k"], ["ch"]).collect()) == [(1, "x", 5), (2, "y", 6)]
    with pytest.raises(Exception, match="ch differs at"):
        intervals.zip_positions(left, right.withColumn("ch", F.lit("q")), ["u", "k"], ["ch"]).collect()


def test_private_keys_at_any_depth(spark):
    texts = ['{"a": [1, {"secret": 2}]}', '{"a": {"b": "/root"}}', '{"a": "secret", "b": ["x/y"]}', "[]", "no json", None]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert [r[0] for r in df.select(S.private_json(("secret",))(F.col("j"))).collect()] == [True, True, False, False, None, None]


def test_strict_csv(spark, tmp_path):
    one, two = tmp_path / "a" / "x.csv", tmp_path / "b" / "x.csv"
    for path, text in ((one, "\ufeffid,text\n001,\"a, \"\"b\"\"\"\n002,c\n"), (two, "id,text\n003,d\n003,e\n")):
        path.parent.mkdir()
        path.write_text(text, encoding="utf-8")
    rows = readers.strict_csv(spark, str(one.parent), ["id", "text"], "id", "[0-9]{3}").orderBy("line").collect()
    assert [(r.line, r.id, r.text) for r in rows] == [(2, "001", 'a, "b"'), (3, "002", "c")]
    for path, columns, pattern, message in ((two, ["id", "text"], "[0-9]{3}", "repeated id in .*line 3"), (one, ["id", "text"], "[0-9]{2}", "malformed id in .*line 2"), (one, ["id", "name"], "[0-9]{3}", "wrong header in .*line 1")):
        with pytest.raises(Exception, match=message):
            readers.strict_csv(spark, str(path.parent), columns, "id", pattern).collect()


def test_publish_replaces_a_folder_at_once(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.publish(spark.range(3).select(F.col("id").cast("double").alias("v")), path)
    writers.publish(spark.range(2).select(F.col("id").cast("double").alias("v")), path)
    assert spark.read.json(path).count() == 2 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="not finite"):
        writers.publish(spark.createDataFrame([(float("inf"),)], "v double"), path)
    assert spark.read.json(path).count() == 2


def log_files(folder, batches):
    folder.mkdir(exist_ok=True)
    for n, lines in batches.items():
        (folder / f"{n}.json").write_text("\n".join(lines))
        os.utime(folder / f"{n}.json", (1_000_000 + n, 1_000_000 + n))


def test_changes_end_with_a_final_state(spark, tmp_path):
    def line(step, state):
        return f'{{"run":"a","step":{step},"state":"{state}"}}'

    log_files(tmp_path / "log", {0: [line(1, "training"), line(2, "training")], 1: [line(3, "saving"), line(4, "training")], 2: [line(5, "finished"), line(6, "training")], 3: [line(7, "failed")]})
    stream = logs.changes(logs.tail(spark, str(tmp_path / "log"), "run string, step long, state string"), "run", "step", "state", ("finished", "failed"))
    logs.append_log(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.step, r.state) for r in spark.read.json(str(tmp_path / "out")).orderBy("step").collect()]
    assert got == [(1, "training"), (3, "saving"), (4, "training"), (5, "finished")]


def test_streams_stop_by_budget_and_resume(spark, tmp_path):
    log_files(tmp_path / "log", {0: ['{"v":1}'], 1: ['{"v":2}']})
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def writer():
        return logs.append_log(logs.tail(spark, str(tmp_path / "log"), "v long"), out, state).trigger(processingTime="200 milliseconds")

    def rows():
        return sorted(r.v for r in spark.read.schema("v long").json(out).collect()) if os.path.isdir(out) else []

    assert logs.run_for(writer(), 60, lambda: len(rows()) == 2) == "done"
    log_files(tmp_path / "log", {2: ['{"v":3}']})
    assert logs.run_for(writer(), 4, None, 0.2) == "stopped"
    assert rows() == [1, 2, 3]  # the second run went on where the first one stopped


def test_sliding_windows_overlap(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 01:30:00' AS ts, 2.0D AS v")
    got = {str(r.start): (r.n, r.total) for r in logs.sliding(rows, "ts", "2 hours", "1 hour", "1 day", "v").collect()}
    assert got == {"2024-01-01 00:00:00": (1, 2.0), "2024-01-01 01:00:00": (1, 2.0)}


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    def line(hour):
        return f'{{"ts":"2024-01-01T{hour:02d}:10:00","v":1.0}}'

    log_files(tmp_path / "log", {0: [line(1)], 1: [line(20)], 2: [line(21)], 3: [line(1), line(19)]})
    stream = logs.tumbling(logs.tail(spark, str(tmp_path / "log"), "ts timestamp, v double"), "ts", "1 hour", "3 hours", "v")
    logs.append_log(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.start[11:13]: r.n for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"01": 1}  # closed after the row at 20 h; the second row at 1 h came too late, and the others are open yet


def test_boundary_rules(spark):
    supports = spark.createDataFrame([(1, 0, 0.0, 0.1), (1, 1, 0.3, 0.4), (1, 2, 0.42, 0.5), (1, 3, 0.6, 0.7)], "rec long, tok long, a double, b double")
    quiet = [*range(12, 15), *range(17, 25)]
    fr = spark.createDataFrame([(1, i, i * 0.01, -50.0 if i in quiet else -25.0 if i == 55 else -10.0) for i in range(80)], "rec long, i long, t double, rms double")
    out = measure.boundaries(supports, measure.quiet_spans(fr, F.col("rms") < -30, 0.02), fr, 0.02, 0.05).orderBy("tok").collect()
    assert [(r.rule, pytest.approx(r.end_t), pytest.approx(r.start_t)) for r in out] == [("quiet_gap", 0.17, 0.24), ("midpoint", 0.41, 0.41), ("quietest", 0.55, 0.55)]


def test_character_points_use_the_longest_run(spark):
    frames_ = [(1, i, i * 0.01, float(100 + i)) for i in [*range(0, 5), *range(10, 21), *range(30, 34)]]
    got = {r.pos: r.median for r in measure.character_points(spark.createDataFrame(frames_, "tok long, i long, t double, f double"), ["tok"]).collect()}
    assert got == {0: 112.0, 1: 115.0, 2: 118.0}
