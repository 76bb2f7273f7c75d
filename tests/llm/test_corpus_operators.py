"""Joins, shards, mixtures, toxicity and fixity on edge cases and against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderly.llm import components, jaccard, mixing, sharding, toxicity, warc


def docs_of(spark, texts, source="s"):
    rows = [(k, t, source if isinstance(source, str) else source[k]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def brute_components(texts, words, percent):
    def shingle_set(t):
        parts = (t or "").lower().split()
        k = min(words, len(parts))
        return {tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)} if parts else set()

    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(sets))}, [len(s) for s in sets]


def family_texts(rng, n=260):
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for k in range(n):
        if k % 4 == 0:  # near copies of a base
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif k % 4 == 1:  # a common passage with a little text of its own
            words = passage + [rng.choice(vocabulary) for _ in range(rng.randrange(8))]
        elif k % 4 == 2:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        else:  # short texts with many ties
            words = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        texts.append(" ".join(words))
    return texts + [None, "", " \n", "one", "ONE", "two words", "Two  words", texts[0], texts[0]]


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join_against_brute_force(spark, words, percent):
    texts = family_texts(random.Random(words))
    expected, sizes = brute_components(texts, words, percent)
    rows = jaccard.join(docs_of(spark, texts), words=words, percent=percent, light=3, block=5).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert [r.n_shingles for r in sorted(rows, key=lambda r: r.doc_id)] == sizes


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_allocation_uses_both_kinds_of_segments(percent):
    plans = [jaccard.allocation(percent, b) for b in range(int((jaccard.bands(percent) < 5000).sum()))]
    assert any(x > 0 for _, x, _ in plans) and any(m > x for m, x, _ in plans)
    assert all(m >= max(1, x) and x >= 0 and s >= 0 for m, x, s in plans)


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_similar_sets_share_a_key_or_know_that_they_are_weak(percent):
    rng, weak = np.random.default_rng(percent), 0
    for size in [*range(1, 40), 75, 150, 400, 1000] * 3:
        one = rng.integers(0, 2**63, size).astype(np.uint64)
        lost = int(rng.integers(0, jaccard.most_differing(size, size, percent) + 1))
        other = np.unique(np.concatenate([one[lost // 2 :], rng.integers(0, 2**63, lost - lost // 2).astype(np.uint64)]))
        both = len(np.intersect1d(one, other))
        if not both or 100 * both < percent * (len(one) + len(other) - both):
            continue
        bands = [int(np.searchsorted(jaccard.bands(percent), len(x), "right")) - 1 for x in (one, other)]
        (a, spare), (b, spare_b) = (jaccard.keys_of(np.sort(x), max(bands), percent) for x in (one, other))
        weak += spare < 0 and spare_b < 0
        assert len(np.intersect1d(a, b)) or (spare < 0 and spare_b < 0)
        flips = [np.unpackbits(jaccard.sketch(x, max(bands), percent).view(np.uint8)) for x in (one, other)]
        assert (flips[0] != flips[1]).sum() <= len(one) + len(other) - 2 * both
    assert weak < 35


def test_jaccard_join_of_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{k % 30_011}" for k in range(60_000))
    texts = [long, long + " end", long.upper(), None, "", "a b c"]
    docs = docs_of(spark, texts).withColumnRenamed("source", "fp").withColumns({c: F.lit(c) for c in ("h", "id", "key", "root", "n", "component_id")})
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert sorted(r.doc_id for r in jaccard.deduplicate(docs).collect()) == [0, 3, 4, 5]


def test_jaccard_join_of_repeated_and_null_ids(spark):
    text, other = "a b c d e f g h", "p q r s t u v w"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (5, other), (5, text), (9, other)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in jaccard.join(df).collect())
    assert got == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 5, 5), (False, 9, 5), (True, None, 3)]
    assert jaccard.join(df.limit(0)).count() == 0
    kept = jaccard.deduplicate(docs_of(spark, [text, other, text + " i", other])).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1] or sorted(r.doc_id for r in kept) == [0, 1, 2]


def test_deduplicate_tells_rows_apart_by_id_and_text(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (None, c, "x"), (None, d, "x"), (None, a, "x"), (7, c + " more", "x"), (8, d, "z"), (8, d, "y")]
    rows += [(9, None, "x"), (9, "", "x"), (None, None, "x"), (None, " ", "x"), (None, " ", "x"), (4, "", "x"), (4, "", "w")]
    kept = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    expected = [(3, a, "x"), (5, b, "x"), (7, c + " more", "x"), (8, d, "y"), (9, None, "x"), (9, "", "x"), (None, None, "x"), (None, " ", "x"), (None, " ", "x"), (4, "", "w")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, expected))
    nobody = spark.createDataFrame([(None, a), (None, b), (None, b + " more")], "doc_id long, text string")
    assert len({r.text[0] for r in jaccard.deduplicate(nobody).collect()}) == jaccard.deduplicate(nobody).count() == 2


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}


def test_differencing_beats_greedy_bounds():
    assert sorted(np.bincount(sharding.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4]).tolist()) == [14, 16]
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 10_000, 800)
    parts = np.bincount(sharding.difference(sizes, 7), sizes, 7)
    assert parts.max() - parts.min() < 50 and parts.sum() == sizes.sum()


def plain_differencing(sizes, k):
    """The sums of k-way differencing, kept as lists in full."""
    heap = [[0] * (k - 1) + [int(n)] for n in sizes]
    order = list(range(len(heap)))
    while len(order) > 1:
        order.sort(key=lambda i: (heap[i][0] - heap[i][-1], i))
        a, b = order.pop(0), order.pop(0)
        heap.append(sorted(x + y for x, y in zip(heap[a], reversed(heap[b]), strict=True)))
        order.append(len(heap) - 1)
    return heap[order[0]]


def test_differencing_against_the_plain_method():
    rng = random.Random(8)
    for _ in range(60):
        k, sizes = rng.randrange(2, 6), [rng.randrange(1, 200) for _ in range(rng.randrange(1, 40))]
        parts = sharding.difference(np.array(sizes), k)
        assert np.bincount(parts, sizes, k).astype(int).tolist() == plain_differencing(sizes, k)


@pytest.mark.parametrize("per_bucket,per_node", [(60, 500), (7, 3)])
def test_sharding(spark, per_bucket, per_node):
    rng = random.Random(4)
    texts = ["x" * rng.randrange(2000) for _ in range(300)] + [None, "", "same text", "é" * 900] + ["same text"] * 80
    docs = docs_of(spark, texts).withColumns({c: F.lit(c) for c in ("h", "crc", "size", "bucket", "part", "shard", "block")})
    docs = docs.unionByName(docs.where("doc_id IN (3, 301)")).unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.shard(docs, shards=5, per_bucket=per_bucket, per_node=per_node, block_rows=16).collect()
    assert len(rows) == len(texts) + 3
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    by_text = {}
    for r in rows:
        t = texts[7 if r.doc_id is None else r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        by_text.setdefault(t, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    totals = [sum(r.size for r in rows if r.shard == k) for k in range(5)]
    assert max(totals) - min(totals) < (600 if per_bucket == 60 else 2500)
    assert sharding.shard(docs_of(spark, [])).count() == 0


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def temperatures(spark, tokens, **limits):
    rows = mixing.temperature(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), **limits).collect()
    return {r.source: r.weight for r in rows}, {r.source: r.passes for r in rows}


def test_temperature_meets_its_limits(spark):
    tokens = {"big": 100_000, "mid": 20_000, "small": 5_000, None: 1_000, "empty": 0}
    weights, passes = temperatures(spark, tokens, repeat_limit=3.0, entropy_share=1.0)
    assert max(passes.values()) == pytest.approx(3.0, rel=1e-6) and passes["big"] == pytest.approx(1.0)
    assert sum(weights.values()) == pytest.approx(1.0) and weights["empty"] == 0 and passes["empty"] == 1
    used = {n: tokens[n] * passes[n] for n in tokens}
    assert all(used[n] / sum(used.values()) == pytest.approx(weights[n]) for n in tokens)
    even, _ = temperatures(spark, tokens, repeat_limit=1e9, entropy_share=0.9)
    assert entropy(even.values()) == pytest.approx(0.9 * math.log(4), rel=1e-6)
    flat, _ = temperatures(spark, tokens, repeat_limit=1e9, entropy_share=1.0)
    assert [flat[n] for n in tokens] == pytest.approx([0.25] * 4 + [0], abs=1e-6)
    assert temperatures(spark, {"a": 0}) == ({"a": 0.0}, {"a": 1.0})


def test_mixing_realises_weights_as_permutations(spark):
    texts = [" ".join(["w"] * (1 + k % 50)) for k in range(900)] + [None, "", "w " * 4000]
    source = ["big" if k < 700 else "mid" if k < 850 else "small" for k in range(900)] + [None, None, "big"]
    docs = docs_of(spark, texts, source).withColumns({c: F.lit(c) for c in ("number", "row", "block", "at", "pass", "tokens")})
    docs = docs.unionByName(docs.where("doc_id = 899")).unionByName(docs.where("doc_id = 899"))  # rows that repeat
    rows = mixing.assign(docs, repeat_limit=2.5, entropy_share=1.0, block_tokens=300).collect()
    count = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    total, orders = sum(r.tokens for r in rows), {}
    for name in {r.source for r in rows}:
        mine = sorted((r for r in rows if r.source == name), key=lambda r: r["at"])
        used = sum(r.tokens for r in mine)
        assert abs(used / total - mine[0].weight) < 0.01 and all(0 <= r["at"] <= 1 for r in mine)
        assert [r["pass"] for r in mine] == sorted(r["pass"] for r in mine)
        whole = {d: n for d, n in count.items() if source[d] == name}
        last = max(r["pass"] for r in mine)
        for k in range(last + 1):
            one = [r for r in mine if r["pass"] == k]
            took = {d: sum(r.doc_id == d for r in one) for d in whole}
            assert all(took[d] <= whole[d] for d in whole) and (k == last > 0 or took == whole)  # a pass, or the begin of one
            blocks = [r.block for i, r in enumerate(one) if i == 0 or one[i - 1].block != r.block]
            assert len(blocks) == len(set(blocks)) or any(r.tokens == 0 for r in one)  # block after block
            orders[name, k] = blocks
    assert orders["small", 0][:3] != orders["small", 1][:3]  # each pass in its own order
    mixed = mixing.mix(docs, repeat_limit=2.5, entropy_share=1.0, block_tokens=300)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: sum(r.doc_id == d for r in rows) for d in counts}
    assert mixing.assign(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    inputs = rng.normal(size=(9, toxicity.INPUTS))
    places = np.array([[0, 1, 2, 3, -1], [4, 5, 6, 7, 8]])
    labels, weights = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss(values=inputs):
        gates = np.concatenate([net.project(values), np.zeros((2, 1, 3 * toxicity.HIDDEN))], 1)
        p = toxicity.sigmoid(net.forward(gates, places))
        return float((-(labels * np.log(p) + (1 - labels) * np.log(1 - p)) * weights).mean())

    grad, d_inputs = net.gradients(inputs, places, labels, weights)
    for at in [(0, 0), (3, 2), (8, toxicity.INPUTS - 1)]:
        step = np.zeros_like(inputs)
        step[at] = 1e-3
        assert d_inputs[at] == pytest.approx((loss(inputs + step) - loss(inputs - step)) / 2e-3, abs=2e-3)
    for name, values in net.w.items():
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 7)]:
            keep = values[at]
            values[at] = keep + 1e-3
            up = loss()
            values[at] = keep - 1e-3
            down = loss()
            values[at] = keep
            assert grad[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_forward_pass_against_plain_loops():
    rng, net = np.random.default_rng(5), toxicity.Network(11)
    words = [b"some", b"w\xc3\xb6rds", b"", b"here"]
    scalars, slots, h = rng.normal(size=(4, toxicity.SCALARS)).astype(np.float32), toxicity.Slots.of(words), toxicity.HIDDEN
    inputs = net.inputs(scalars, slots)
    ends = [*slots.begin[1:], len(slots.gram)]
    for k in range(4):
        grams = [net.grams[g] for g in slots.gram[slots.begin[k] : ends[k]]]
        assert inputs[k] == pytest.approx([*scalars[k], *net.words[slots.word[k]], *np.mean(grams, axis=0)], rel=1e-5)
    states = []
    for d in (0, 1):
        state, out = [0.0] * h, {}
        for t in (0, 1, 2, 3) if d == 0 else (3, 2, 1, 0):
            gate = [sum(inputs[t][j] * net.w["x"][d][j][k] for j in range(toxicity.INPUTS)) for k in range(3 * h)]
            back = [sum(state[j] * net.w["u"][d][j][k] for j in range(h)) for k in range(3 * h)]
            z = [1 / (1 + math.exp(-gate[k] - back[k])) for k in range(h)]
            r = [1 / (1 + math.exp(-gate[h + k] - back[h + k])) for k in range(h)]
            c = [math.tanh(gate[2 * h + k] + r[k] * back[2 * h + k]) for k in range(h)]
            state = [state[k] + z[k] * (c[k] - state[k]) for k in range(h)]
            out[t] = state
        states.append(out)
    both = [states[0][t] + states[1][t] for t in range(4)]
    share = [math.exp(sum(a * b for a, b in zip(s, net.w["v"], strict=True))) for s in both]
    pooled = [sum(share[t] * both[t][k] for t in range(4)) / sum(share) for k in range(2 * h)]
    expected = sum(a * b for a, b in zip(pooled, net.w["o"], strict=True)) + net.w["b"][0]
    gates = np.concatenate([net.project(inputs), np.zeros((2, 1, 3 * h), np.float32)], 1)
    assert net.logits(gates, np.array([[0, 1, 2, 3]]))[0] == pytest.approx(expected, rel=1e-4)


def test_equal_texts_score_alike_in_any_batch():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    model = toxicity.fit(texts, [k % 2 for k in range(150)], epochs=2)
    whole = model.score(texts)
    mixed = rng.sample(range(150), 150)
    assert (model.score([texts[k] for k in mixed]) == whole[mixed]).all()
    assert all(model.score([texts[k]])[0] == whole[k] for k in range(60))
    memory = toxicity.Memory()
    assert np.concatenate([model.score([texts[k] for k in mixed[i : i + 7]], memory) for i in range(0, 150, 7)]).tolist() == whole[mixed].tolist()


def test_windows_cover_every_word():
    for lengths in ([1], [48], [49], [500, 0, 3]):
        places, owner = toxicity.windows_of(lengths)
        assert set(places[places >= 0]) == set(range(sum(lengths)))
        assert all(lengths[d] for d in owner)


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(1)

    def text(bad):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(5, 150))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vilezo", "vilexu", "vilepa", "zornik"]) + rng.choice(["", "s", ".", "ka"])
        return " ".join(words)

    texts = [text(k % 4 == 0) for k in range(900)]
    docs = docs_of(spark, [*texts, None, "", " ... ", "vilezo " + "abc " * 5000])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(900)] + [(None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs.withColumn("toxicity", F.lit("x")), labels).withColumn("held", toxicity.remainder(F.col("doc_id")) == 2).collect()
    held = [r for r in scored if r.held and r.doc_id < 900]
    right = sum((r.toxicity >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0) for r in held)
    assert right / len(held) > 0.9
    by_id = {r.doc_id: r.toxicity for r in scored}
    assert [by_id[k] for k in (900, 901)] == [0.0, 0.0] and all(0 <= v <= 1 for v in by_id.values()) and by_id[903] > by_id[902]
    assert {r.toxicity for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.reject(docs, labels).columns == docs.columns


def test_fixity_audit(spark):
    rows = [(k, f"http://h/{k % 5}", "x" * (37 * k % 900)) for k in range(600)] + [(None, None, None), (7, "http://h/2", "again"), (7, "http://h/2", "again")]
    rows += [(9, "http://h/9", f"version {k}") for k in range(700)] + [(None, "u", "y" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in ("file", "volume", "record", "id", "offset")})
    index = warc.archive(pages, per_file=128)
    bad, gone = F.col("id").isin(5, 300), F.col("id") == 301
    stored = F.when(bad, F.concat("record", F.lit("!"))).when(gone, F.lit(None).cast("string")).otherwise(F.col("record"))
    replica = warc.archive(pages, per_file=128, stored=stored)
    extra = spark.createDataFrame([(999, 99, 0, 0, 10, "ff")], "id long, file long, volume int, offset long, length long, digest string")
    layout = index.orderBy("file", "volume", "offset").collect()
    for one, two in zip(layout, layout[1:]):
        assert two.offset == (one.offset + one.length if (one.file, one.volume) == (two.file, two.volume) else 0)
    assert max(Counter((r.file, r.volume) for r in layout).values()) < 600
    out = warc.audit(index, replica.unionByName(extra), range_bytes=1000, fanout=3).collect()
    assert len(out) == len(rows) + 1
    found = {(r.id, r.verdict) for r in out if r.verdict != "ok"}
    assert found == {(5, "changed"), (300, "changed"), (301, "missing"), (999, "extra")}
    assert warc.locate(index, index, 1000, 3).count() == 0
    assert warc.audit(index.limit(0), index.limit(0)).count() == 0
