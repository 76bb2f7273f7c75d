"""Keys that are scored beforehand, and keys counted by buckets."""

import math

import numpy as np
import pytest

from orderly.llm import contextmix as cm
from orderly.llm import textmix as tm
from test_context_mixing import corpus


class Counting(tm.Trained):
    asked = 0

    def log10_of(self, keys):
        self.asked += len(keys)
        return super().log10_of(keys)


def keys_of(texts):
    return np.concatenate([k for _, k in tm.read_blocks(iter(texts), {})])


def test_common_keys_are_not_mixed_again():
    key, n = tm.distinct(keys_of([text for _, text in corpus(80)]))
    rng = np.random.default_rng(5)
    seen = rng.integers(0, 9, tm.TextMixer.size).astype(np.float32)
    model = Counting(*tm.Trained.tables(tm.TextMixer(seen, np.floor(seen / 3))))
    key = key[np.argsort(n, kind="stable")]
    expected = model.log10_of(key).astype(np.float32)
    for bits in (3, 20):  # a table that is too small for them all, and one that isn't
        kept = tm.Kept(model, common=(key, expected), common_bits=bits)
        model.asked = 0
        assert np.array_equal(kept.log10(np.tile(key, 3)), np.tile(expected, 3))
        assert model.asked < len(key) if bits == 3 else model.asked <= len(key) // 100


@pytest.mark.parametrize("bits", [0, 3, 17])
def test_keys_are_counted_by_buckets(spark, bits):
    docs = spark.createDataFrame(corpus(40), "doc_id long, text string").repartition(3)
    parts = tm.key_counts(docs, "doc_id", "text", {}, most=200, bucket_bits=bits)
    plain = tm.key_counts(docs, "doc_id", "text", {})
    found = {r.key: r.n for r in parts.collect()}
    assert found == {r.key: r.n for r in plain.collect()} and parts.count() == len(found)


def test_most_common_keys_and_their_scores(spark):
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string")
    counts = tm.key_counts(docs, "doc_id", "text", {}).cache()
    model = cm.train(counts, read=tm.counted_keys, mixer=tm.TextMixer)
    tables = spark.sparkContext.broadcast(tm.Trained.tables(model))
    n = {r.key & (1 << 64) - 1: r.n for r in counts.collect()}
    key, lp = tm.common_keys(counts, tables, most=100)
    found = [n[int(k)] for k in key]
    steps = [math.floor(math.log2(c) * 8) for c in found]
    assert 0 < len(key) <= 100 and steps == sorted(steps) and min(found) > max([c for k, c in n.items() if k not in set(key.tolist())])
    assert np.array_equal(lp, tm.Trained(*tables.value).log10_of(key).astype(np.float32))
    assert len(tm.common_keys(counts, tables)[0]) == len(n) and not len(tm.common_keys(counts.limit(0), tables)[0])
