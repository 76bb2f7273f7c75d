"""Contexts that run through a text, against plain loops over its bytes."""

import math
import zlib

import numpy as np
import pytest

from orderly.llm import contextmix as cm
from orderly.llm import textmix as tm
from test_context_mixing import corpus


def coded_plainly(text, classes):
    """(class, six bytes before, byte) of every byte of a text."""
    words, past, now, out = [*(text or "").encode().lower().split(), cm.END], b"\0\0\0\0\0 ", 0, []
    for word in words:
        for byte in word + b" ":
            out.append((now << 56) | int.from_bytes(past[-6:], "big") << 8 | byte)
            past += bytes([byte])
        now = classes.get(word, now)
    return out


@pytest.mark.parametrize("most", [40, 300, 1 << 20])
def test_contexts_run_across_words_and_blocks(most):
    texts = ["The ka of\tber", None, "", "x" * 500 + " der ka " * 90, "und\n\nund É"]
    classes = {b"the": 1, b"of": 2, b"der": 3}
    found = [[] for _ in texts]
    for block, keys in tm.read_blocks(iter(texts), classes, most):
        for number, part in zip(block.numbers, np.split(keys, np.cumsum(block.bytes_of())[:-1]), strict=True):
            found[number] += part.tolist()
    assert found == [coded_plainly(t, classes) for t in texts]


def test_a_word_depends_on_the_one_before(spark):
    """The score of a text is not that of its words: the same words in another order have other bytes before them."""
    docs = [(k, " ".join(["alpha beta"] * 9 + ["gamma delta"] * 9)) for k in range(60)]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [*docs, (held[0], "alpha beta alpha beta gamma delta"), (held[1], "alpha delta alpha gamma beta beta")]
    got = {r.doc_id: r for r in tm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score) and got[held[0]].score > got[held[1]].score + 2


def test_scores_against_the_mixer_key_by_key(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(120), "doc_id long, text string")
    classes = cm.word_classes(docs, "doc_id", "text")
    keys = tm.key_counts(docs, "doc_id", "text", classes).cache()
    expected = {}
    for doc, text in corpus(120):
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            for key in coded_plainly(text, classes):
                expected[key] = expected.get(key, 0) + 1
    assert {r.key & (1 << 64) - 1: r.n for r in keys.collect()} == expected
    model = cm.train(keys, read=tm.counted_keys, mixer=tm.TextMixer)
    assert model.seen[: tm.OFFSETS[1]].sum() == 8 * sum(expected.values())
    monkeypatch.setattr(tm, "train", lambda *_, **__: model)
    rows = tm.score(docs, common=3).collect()  # most words travel to the table
    for r in rows[::17]:
        key = np.array(coded_plainly(dict(corpus(120))[r.doc_id], classes), np.uint64)
        assert r.n_bytes == len(key) and r.score == pytest.approx(model.log10_of(key).sum(), abs=0.01, rel=1e-4)
    few = tm.Kept(tm.Trained(*tm.Trained.tables(model)), (2, 4))
    assert np.allclose(few.log10(key), model.log10_of(key), atol=1e-3) and np.array_equal(few.log10(key), few.log10(key))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_chances_of_all_bytes_add_up_to_one():
    rng = np.random.default_rng(3)
    seen = rng.integers(0, 9, tm.TextMixer.size).astype(np.float32)
    model = tm.TextMixer(seen, np.floor(seen / 3))
    keys = np.uint64(int.from_bytes(b"ha ber", "big") << 8) + np.arange(256, dtype=np.uint64)
    for mixer in (model, tm.Trained(*tm.Trained.tables(model))):
        assert (10.0 ** mixer.log10_of(keys)).sum() == pytest.approx(1, abs=1e-3)
    assert math.isfinite(mixer.log10_of(keys).min())
