"""Toxicity from few labelled rows, and mixes recomputed plainly."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderly.llm import mixing, toxicity


def test_forty_toxic_rows_are_enough():
    """Clean and toxic texts of invented words; toxic ones hold some words of a short list, in held-out texts with other endings too."""
    rng = random.Random(3)
    syllables = ["ka", "to", "mi", "re", "lu", "sa", "no", "vi", "pe", "du"]
    plain = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    bad = ["grunzol", "wexbart", "pfuikel", "zottrak", "quargen"]

    def text(toxic, endings):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(endings))
        return " ".join(words)

    labels = [int(k % 8 == 0) for k in range(320)]
    model = toxicity.fit([text(y, ["", "s"]) for y in labels], labels)
    held = [int(k % 8 == 0) for k in range(240)]
    scores = model.score([text(y, ["", "s", "er"]) for y in held])
    found = scores >= toxicity.THRESHOLD
    assert sum(found[k] for k, y in enumerate(held) if y) >= 0.9 * sum(held)
    assert sum(found[k] for k, y in enumerate(held) if not y) <= 0.05 * len(held)


def exponent_plainly(tokens, limit, evenness):
    shares = np.array([t for t in tokens if t], float) / sum(tokens)
    entropy = lambda p: -(p * np.log(p)).sum()
    target = entropy(shares) + evenness * (math.log(len(shares)) - entropy(shares))
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        weights = shares**a / (shares**a).sum()
        passes = (weights / shares) / (weights / shares).min()
        low, high = (low, a) if entropy(weights) <= target + 1e-12 and passes.max() <= limit else (a, high)
    return high


@pytest.mark.parametrize(("tokens", "limit"), [([500, 510, 520, 480, 490], 1.5), ([9000, 800, 500, 300], 1.5), ([9000, 800, 500, 300], 50.0), ([7, 7, 7], 2.0)])
def test_exponent_weights_and_passes(spark, tokens, limit):
    rows = mixing.temperature(spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(tokens)], "source string, tokens long"), limit).collect()
    got = {r.source: r for r in rows}
    a = 1.0 if len(set(tokens)) == 1 else exponent_plainly(tokens, limit, mixing.EVENNESS)
    raised = np.array(tokens, float) ** a
    for k, t in enumerate(tokens):
        assert got[f"s{k}"].weight == pytest.approx(raised[k] / raised.sum(), rel=1e-6)
        assert got[f"s{k}"].passes == pytest.approx((raised[k] / t) / (raised / tokens).min(), rel=1e-6)
    if len(set(tokens)) > 1:
        assert a < 1 and max(r.passes for r in rows) > 1  # the mix binds whenever shares differ


def test_blocks_and_budgets_recomputed(spark):
    """Which documents come how often, and in which order, by sorting every source in one list."""
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), "big" if k % 5 else f"s{k % 3}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block_tokens, seed = 400, mixing.SEED
    got = mixing.assign(docs, block_tokens=block_tokens).collect()
    tokens = {k: len(t.split()) for k, t, _ in rows}
    whole = {s: sum(tokens[k] for k, _, x in rows if x == s) for s in {r[2] for r in rows}}
    plan = {r.source: r for r in mixing.temperature(spark.createDataFrame(list(whole.items()), "source string, tokens long")).collect()}
    blocks = {s: max(1, -(-n // block_tokens)) for s, n in whole.items()}
    hashed = docs.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("p", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    hashed = hashed.select("doc_id", "source", "p", F.xxhash64("h", F.lit(seed)).alias("deal"), F.pmod(F.xxhash64("h", "p", F.lit(seed + 1)), F.lit(1 << 40)).alias("inside"))
    facts = {(r.doc_id, r.p): r for r in hashed.collect()}
    turns = spark.createDataFrame([(p, s, b) for s, n in blocks.items() for p in (0, 1) for b in range(n)], "p long, s string, b long")
    turn = {(r.s, r.p, r.b): r.t for r in turns.select("*", F.xxhash64(F.lit(seed), "p", "s", "b").alias("t")).collect()}
    expected = {}
    for s in whole:
        full = math.floor(plan[s].passes + 1e-9)
        rest = round((plan[s].passes - full) * whole[s])
        own = [k for k, _, x in rows if x == s]
        block = {k: facts[k, 0].deal % blocks[s] for k in own}
        size = {b: sum(tokens[k] for k in own if block[k] == b) for b in range(blocks[s])}
        for p in range(full + (rest > 0)):
            begin = 0
            for b in sorted((b for b in size if any(block[k] == b for k in own)), key=lambda b: (turn[s, p, b], b)):
                for k in own:
                    place = begin + size[b] * facts[k, p].inside / (1 << 40)
                    if block[k] == b and (p < full or place < rest):
                        expected[k, p] = (b, (p * whole[s] + place) / (full * whole[s] + rest))
                begin += size[b]
    assert {(r.doc_id, r["pass"]): r.block for r in got} == {key: b for key, (b, _) in expected.items()}
    assert all(r["at"] == pytest.approx(expected[r.doc_id, r["pass"]][1]) for r in got)
    assert any(r["pass"] == 1 for r in got)
