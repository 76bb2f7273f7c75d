"""Language-model scores against plain loops, held-out texts and the unigram formula."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orderly.llm import contextmix as cm
from orderly.llm import registry

M = (1 << 64) - 1
SCHEMA = "doc_id long, text string, word string, score double"


def corpus(n, seed=0):
    """Documents of two invented languages, each with its own syllables and frequent words."""
    rng = random.Random(seed)
    sides = [(["ka", "tomi", "relu", "sa", "nor"], ["the", "of", "and"]), (["chü", "berg", "lein", "zwo", "ant"], ["der", "und", "die"])]
    out = []
    for k in range(n):
        syllables, frequent = sides[k % 2]
        words = [rng.choice(frequent) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        out.append((k, " ".join(words) + "."))
    return out


def odds_plainly(model, key, node):
    """(log odds by order, gate) of a bit with Python integers."""
    context, kind = (key >> 8) & ((1 << 48) - 1), key >> 56
    odds, seen = [], []
    for i, k in enumerate(cm.ORDERS):
        base = context & ((1 << 8 * k) - 1)
        base |= (kind << 8 * k) if k <= cm.WITH_CLASS else 0
        if k > 1:
            base = base * 0x9E3779B97F4A7C15 & M
            mixed = ((base ^ (node * 0xC2B2AE3D27D4EB4F & M)) * 0x165667B19E3779F9) & M
            mixed ^= mixed >> 29
            slot = (mixed * 0x9E3779B97F4A7C15 & M) >> (64 - cm.SLOT_BITS[i])
        else:
            slot = base * 256 + node
        slot += cm.OFFSETS[i]
        n, one = float(model.seen[slot]), float(model.ones[slot])
        seen.append(n)
        odds.append(max(-cm.LIMIT, min(cm.LIMIT, math.log((one + cm.PRIOR) / (n - one + cm.PRIOR)))))
    longest = max((i for i, n in enumerate(seen) if n > 0), default=len(seen) - 1)
    level = max(0, sum(seen[longest] >= s for s in cm.STEPS) - 1)
    return odds, longest * len(cm.STEPS) + level


def chance_plainly(model, key, node):
    odds, gate = odds_plainly(model, key, node)
    mixed = sum(o * (model.weights[gate][i] + model.weights[cm.GATES + node][i]) for i, o in enumerate(odds))
    mixed = max(-cm.LIMIT, min(cm.LIMIT, mixed))
    place = min(max(mixed / cm.CELL_WIDTH + cm.CELLS // 2, 0), cm.CELLS - 1.001)
    low, share = int(place), place - int(place)
    cell = [model.cells[1][gate][j] / model.cells[0][gate][j] for j in (low, low + 1)]
    refined = min(max(cell[0] * (1 - share) + cell[1] * share, 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(mixed + math.log(refined / (1 - refined))) / 2))


def spelt_plainly(model, kind, word):
    """log10 of the probability of a word and the space behind it, bit by bit."""
    past, total = list(cm.HISTORY), 0.0
    for byte in word + b" ":
        key = (kind << 56) | (sum(b << (8 * i) for i, b in enumerate(reversed(past[-6:]))) << 8) | byte
        for shift in range(7, -1, -1):
            p = min(max(chance_plainly(model, key, (256 | byte) >> (shift + 1)), 1e-6), 1 - 1e-6)
            total += math.log10(p if byte >> shift & 1 else 1 - p)
        past.append(byte)
    return total


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string")
    classes = cm.word_classes(docs, "doc_id", "text")
    counted = cm.word_counts(docs, "doc_id", "text", classes).cache()
    return docs, classes, counted, cm.train(counted)


def test_frequent_words_of_a_language_share_a_class(trained):
    classes = trained[1]
    assert classes[b"the"] == classes[b"of"] == classes[b"and"] != classes[b"der"] == classes[b"und"]
    assert 0 < min(classes.values()) and max(classes.values()) < cm.CLASSES


def test_word_counts_by_class(trained):
    _, classes, counted, _ = trained
    expected = {}
    for doc, text in corpus(300):
        now, learn = 0, zlib.crc32(str(doc).encode()) % 7 != 2
        for word in [*text.lower().encode().split(), cm.END]:
            entry = expected.setdefault(word, [[0] * cm.CLASSES, [0] * cm.CLASSES])
            entry[0][now] += learn
            entry[1][now] += 1
            now = classes.get(word, now)
    assert {bytes(r.word): [list(r.c), list(r.n)] for r in counted.collect()} == expected


def test_slots_and_mixing_against_plain_loops(trained):
    _, _, counted, model = trained
    units = [(1, b"katomi"), (0, b"x"), (2, "chübergch".encode()), (3, b"unseen" * 9), (0, cm.END)]
    assert np.allclose(model.log10(units), [spelt_plainly(model, k, w) for k, w in units], atol=1e-3)
    learned = [(k, bytes(r.word)) for r in counted.collect() for k in range(cm.CLASSES) if r.c[k]]
    assert model.seen[cm.OFFSETS[0] : cm.OFFSETS[1]].reshape(-1, 256)[:, 1].sum() == sum(len(w) + 1 for _, w in learned)


def test_a_word_is_a_probability(trained):
    """The chances of all bytes after one context add up to one."""
    model = trained[3]
    total = 0.0
    for byte in range(256):
        key, p = (1 << 56) | (int.from_bytes(b"\0\0\0 ka", "big") << 8) | byte, 1.0
        for shift in range(7, -1, -1):
            one = chance_plainly(model, key, (256 | byte) >> (shift + 1))
            p *= one if byte >> shift & 1 else 1 - one
        total += p
    assert total == pytest.approx(1)


def test_training_helps_on_unseen_words(trained):
    model = trained[3]
    fresh = [(k, w.encode()) for _, t in corpus(40, seed=9) for k in (0,) for w in t.split()]
    start = cm.Mixer(model.seen, model.ones)
    assert model.log10(fresh).sum() > start.log10(fresh).sum() > cm.Mixer(np.zeros_like(model.seen), np.zeros_like(model.ones)).log10(fresh).sum()
    assert model.log10([(0, b"katomi")])[0] > model.log10([(0, b"xqzwvj")])[0] + 3


def test_long_words_are_scored_in_segments(trained, monkeypatch):
    model, word = trained[3], b"katomirelu" * 3_000
    whole = model.log10([(0, word), (1, b"ka")])
    monkeypatch.setattr(cm, "SEGMENT", 777)
    monkeypatch.setattr(cm, "BLOCK_BYTES", 5_000)
    assert np.allclose(model.log10([(0, word), (1, b"ka")]), whole)


def test_long_texts_are_read_in_pieces():
    text = " ".join(f"w{k % 50}" for k in range(5_000))
    assert [w for part in cm.pieces(text, 1_000) for w in part] == text.encode().split()
    assert list(cm.pieces("x" * 5_000, 1_000)) == [[b"x" * 5_000]]


def score_plainly(trained, rows):
    """{doc_id: [held_out, n_tokens, n_known, N, base, score]}: all sums token by token."""
    _, classes, counted, model = trained
    table = {bytes(r.word): (np.array(r.c), np.array(r.n)) for r in counted.collect()}
    own = [sum(int(c[k]) for c, _ in table.values()) for k in range(cm.CLASSES)]
    kinds = [sum(bool(c[k]) for c, _ in table.values()) for k in range(cm.CLASSES)]
    n, v = sum(own), sum(bool(c.sum()) for c, _ in table.values())
    once, twice = (sum(int(c.sum() == k) for c, _ in table.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    out = {}
    for doc, text in rows:
        now, base, score, known = 0, 0.0, 0.0, 0
        words = [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), cm.END]
        for word in words:
            c = table[word][0]
            known += bool(c.sum())
            base += math.log10((c.sum() + 1) / (n + v + 1))
            common = (max(c.sum() - d, 0) + d * v * 10 ** model.log10([(now, word)])[0]) / n
            score += math.log10((max(c[now] - d, 0) + d * kinds[now] * common) / own[now] if own[now] else common)
            now = classes.get(word, now)
        out[doc] = [zlib.crc32(str(doc).encode()) % 7 == 2, len(words), known, n, base, score]
    return out


def test_scores_token_by_token(trained, monkeypatch):
    monkeypatch.setattr(cm, "train", lambda words: trained[3])
    rows = cm.score(trained[0], share=1e-2).collect()  # most words travel to the table
    plain = score_plainly(trained, corpus(300)[:40])
    got = {r.doc_id: [r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] for r in rows}
    assert len(rows) == 300
    for doc, expected in plain.items():
        assert got[doc][:4] == expected[:4] and got[doc][4:] == pytest.approx(expected[4:], abs=1e-3)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # though the base leaves words it hasn't seen more than their share
    assert {r.doc_id: r.score for r in cm.score(trained[0], share=1e-5).collect()} == pytest.approx({r.doc_id: r.score for r in rows}, abs=1e-5)


def test_query_on_messy_documents(spark, tmp_path):
    rows = corpus(60) + [(0, None), (0, None), (None, "The OF and"), (None, None), (70, ""), (71, " \t\n\x0b\x0c\r "), (72, "x" * 300_000), (73, "ka " * 100_000), (74, "É a b ÀÉ"), (75, corpus(60)[4][1])]
    spark.createDataFrame([(i, t, "clash", 0.0) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op13_context_mixing"](spark, str(tmp_path)).collect()
    tokens = {k: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), cm.END] for k, (_, t) in enumerate(rows)}
    crc = [zlib.crc32((str(i) if i is not None else "").encode()) % 7 for i, _ in rows]
    counts = Counter(w for k, words in tokens.items() if crc[k] != 2 for w in words)
    n, v = sum(counts.values()), len(counts)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = [(i, crc[k] == 2, len(tokens[k]), sum(w in counts for w in tokens[k]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[k]), 3)) for k, (i, _) in enumerate(rows)]
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got], key=key) == sorted(expected, key=key)
    scores = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert scores[4] == scores[75] and scores[70] == scores[71] and all(math.isfinite(s) and s < 0 for s in scores.values())
    assert all(r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / sum(len(w) + 1 for w in tokens[k])) for r, k in ((next(r for r in got if r.doc_id == 72), 66), (next(r for r in got if r.doc_id == 73), 67)))


def test_without_training_rows(spark):
    row = cm.score(spark.createDataFrame([(2, "a")], "doc_id long, text string").where("false")).collect()
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = cm.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert row == [] and (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (2, 0, 0, 0.0)
    assert got.score == pytest.approx(-5 * 8 * math.log10(2), abs=1e-3) and got.bits_per_byte == pytest.approx(8, abs=1e-3)
