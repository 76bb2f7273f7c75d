"""Quality rules, media, urls, chat, packing and tokens on edge cases and against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderly.llm import chat, media, packing, quality, urls

EDGES = [None, "", " ", "\n\n", "one", "a  b\tc\n", "é" * 30, "the same text", "the same text", "long " * 30_000]


def docs_of(spark, texts, **extra):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t|!é*", max_size=200))
def test_counts_against_brute_force(text):
    assert quality.judge(text)[:5] == slow_counts(text)


def test_quality_edges(spark):
    out = {r.doc_id: r for r in quality.annotate(docs_of(spark, EDGES, kept="mine", quality="theirs")).collect()}
    assert len(out) == len(EDGES) and out[0].kept == "mine"
    for k, t in enumerate(EDGES):
        assert tuple(out[k].quality[:5]) == slow_counts(t)
    assert out[0].quality.base_failed and not out[0].quality.kept and out[0].quality.clean_text is None
    assert quality.annotate(docs_of(spark, [])).count() == 0


def test_lines_that_fail_are_removed(spark):
    body = ". ".join(f"word{k} and then word{k + 1}" for k in range(12)) + "."
    texts = [
        body + "\nHome | News | Sport | Contact\nAll rights reserved.",
        "\n".join("A | b | c | d | e | f" for _ in range(30)) + "\n" + body[:60],
        " ".join(f"word{k}***" for k in range(60)),
    ]
    out = quality.clean(docs_of(spark, texts, source="s")).collect()
    assert [(r.doc_id, r.text, r.source) for r in out] == [(0, body, "s")]


def test_companding_tables():
    mu, a = media.TABLES[media.MULAW], media.TABLES[media.ALAW]
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def one_block(block):
    """The textbook decoder, nibble by nibble."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_CHANGE[code])))
            out.append(value)
    return out


def test_adpcm_blocks_against_textbook():
    raw = np.random.default_rng(1).integers(0, 256, (5, media.UNIT), np.uint8)
    assert media.decode_blocks(raw).tolist() == [one_block(bytes(b)) for b in raw]


def test_resampling_keeps_samples_and_levels():
    pcm = np.full(50, 1000, np.int16)
    assert np.abs(media.resample(pcm) - 1000).max() <= 1
    wave = (8000 * np.sin(np.arange(400) * 0.2)).astype(np.int16)
    up = media.resample(wave)
    assert (up[::2] == wave).all()
    assert np.abs(up[100:700:2].astype(int) - up[100:700:2]).max() == 0
    assert np.abs(up[101:700:2] - 8000 * np.sin((np.arange(400) + 0.5) * 0.2)[50:350]).max() < 100


def test_media_round_trip(spark):
    stored = media.decode_media(media.encode_text(docs_of(spark, EDGES, digest="x", pcm="y")), "media.media")
    rows = {r.doc_id: r for r in media.digest(stored, "media.media", "pcm").collect()}
    assert {r.doc_id: r.digest for r in media.digest(stored, "media.media").collect()} == {k: r.digest for k, r in rows.items()}
    codecs = set()
    for k, t in enumerate(EDGES):
        data = (t or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 192)) * 192)
        d, m, p = rows[k].digest, bytes(rows[k].media.media), bytes(rows[k].pcm)
        assert rows[k].media.n_bytes == len(data) and d.payload_bytes == len(padded)
        assert d.payload_sha256 == hashlib.sha256(padded).hexdigest() and d.tail_crc32 == zlib.crc32(padded[-16:])
        assert d.media_sha256 == hashlib.sha256(m).hexdigest() and d.media_bytes == len(m)
        assert (d.pcm_bytes, d.pcm_sha256) == (len(p), hashlib.sha256(p).hexdigest()) and p[:4] == b"RIFF"
        codec, coded = media.read_wav(m)
        codecs.add(codec)
        if codec == media.ADPCM:
            plain = np.array([v for at in range(0, len(coded), 192) for v in one_block(coded[at : at + 192])], np.int16)
        else:
            plain = media.TABLES[codec][np.frombuffer(coded, np.uint8)]
        assert np.array_equal(np.frombuffer(media.read_wav(p)[1], "<i2")[::2], plain)  # every second sample is the decoded one
        assert f"samples={2 * len(plain)};" in d.feature
    assert len(codecs) > 1 and rows[7].digest == rows[8].digest
    none = media.digest(media.decode_media(spark.createDataFrame([(None,)], "media binary"))).first()
    assert none.pcm is None and none.digest.payload_bytes is None


URLS = [
    (None, "", "", None), ("", "", "", None), ("no scheme", "", "", None), ("http://", "", "", None), ("HTTP://A.COM/x", "a.com", "/x", "com/"),
    ("http://blog.example.com/en/1", "blog.example.com", "/en/1", "example.com/en/"), ("http://www.example.com/en/1?a=/fr/", "www.example.com", "/en/1", "www.example.com/en/"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/"), ("https://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("https://x.net/es/9#t", "x.net", "/es/9", "net/es/"), ("https://x.net/de/9", "x.net", "/de/9", None), ("https://x.com?q", "x.com", "", None), ("https://É.ORG/A", "É.org", "/A", None),
    ("x://a.com/://b", "a.com", "/://b", "com/"),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(k, u[0]) for k, u in enumerate(URLS)] + [(90, "http://x.casino-bets.example.org/en/3"), (91, "http://city-garden.example.org/en/3")], "page_id long, url string")
    return {r.page_id: r for r in urls.judge(df.withColumn("host", F.lit("mine"))).collect()}


def test_url_rules(judged):
    for k, (_, host, path, rule) in enumerate(URLS):
        assert (judged[k].host, judged[k].path, judged[k].rule) == (host, path, rule)
        if rule:
            assert judged[k].verdict == ("block" if rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")
    assert judged[90].verdict == "block" and judged[91].verdict == "allow"


def slow_grams(host, path):
    """(which, gram) of the distinct n-grams of host and path."""
    out = []
    for name, text in (("h", f"^{host}$"), ("p", re.sub("[0-9]+", "0", path) + "$")):
        for size in (3, 4, 5):
            out += [(name, text[k : k + size]) for k in range(len(text) - size + 1)]
    return list(dict.fromkeys(out))


def test_url_model_against_brute_force(spark):
    parts = [("a.b-c.org", "/en/12/x"), ("", ""), ("é.org", "/É/ü"), ("x", "/"), ("aaaaaa.net", "/aaaaaa/99/1"), ("h" * 300, "/" + "p" * 2000)]
    weights = [((7 * k) % 11 - 5) / 10 for k in range(64)]
    grams = sorted({g for p in parts for g in slow_grams(*p)})
    hashed = spark.createDataFrame(grams, "name string, gram string").select("*", F.pmod(F.xxhash64("name", "gram"), F.lit(64)).cast("int").alias("slot"))
    slot = {(r.name, r.gram): r.slot for r in hashed.collect()}
    f = urls.features(F.col("host"), F.col("path"), 64)
    got = spark.createDataFrame(parts, "host string, path string").select("host", "path", f.alias("f"), urls.margin(f, weights, 0.25).alias("m")).collect()
    for r in got:
        expected = {slot[g] for g in slow_grams(r.host, r.path)}
        assert set(r.f) == expected and len(r.f) == len(expected)
        assert r.m == pytest.approx(sum(weights[i] for i in expected) / max(1, len(expected)) ** 0.5 + 0.25)


def test_url_training_against_plain_descent(spark):
    rows = [(f"http://{h}.org/{k}", float(h.startswith("bad"))) for k, h in enumerate(["bad-one", "good", "badly", "fine", "bad", "mild"])] + [("http://x.org", None)]
    table = spark.createDataFrame(rows, "url string, label double")
    weights, bias = urls.train(table, 32, 60, 0.01)
    host, path = urls.host_and_path(F.col("url"))
    known = [(r.f, r.label) for r in table.where("label IS NOT NULL").select(urls.features(host, path, 32).alias("f"), "label").collect()]
    x = np.zeros((len(known), 33))
    for k, (f, _) in enumerate(known):
        x[k, f] = len(f) ** -0.5
    x[:, 32] = 1
    y, ridge = np.array([v for _, v in known]), np.array([0.01] * 32 + [0])

    def loss(w):
        return float(np.mean(np.logaddexp(0, x @ w) - y * (x @ w)) + (ridge * w * w).sum() / 2)

    w = np.zeros(33)
    for _ in range(20_000):
        w -= 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + ridge * w)
    assert loss(np.array([*weights, bias])) <= loss(w) * 1.01
    assert urls.train(table.limit(0), 8) == ([0.0] * 8, 0.0)


def test_url_training_separates(spark):
    weights, bias = urls.train(urls.labelled(spark))
    host, path = urls.host_and_path(F.col("url"))
    scored = urls.labelled(spark).select("label", (urls.margin(urls.features(host, path), weights, bias) > 0).cast("double").alias("p"))
    assert scored.where("label = p").count() > 0.97 * scored.count()


NASTY = ["", "plain", "</s>", "<s>[0user]x</s>", "a\\</s>b", "<\\/s>", "\\", "<\\s>\\\\<s>", "\n</s>\n<s>", "é</s>é", "[0assistant]", "<s", "</s"]


def test_chat_round_trip(spark):
    rows = [(k, 0, "user", t) for k, t in enumerate(NASTY)] + [(k, 1, "assistant", t[::-1] + t) for k, t in enumerate(NASTY)]
    rows += [(100, 0, "odd]role", "x"), (100, 1, "assistant", "y</s>"), (101, None, None, None), (101, 2, "assistant", "twice"), (101, 2, "assistant", "twice"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for k in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert out[k].turns_sha256 == hashlib.sha256(said.encode()).hexdigest(), k
        assert (out[k].n_turns, out[k].loss_chars) == (len(turns), len(loss))
        assert out[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers(tokenizer):
    from tokenizers import Tokenizer

    own, theirs = packing.Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    theirs.encode_special_tokens = True
    texts = ["", " ", "a  b\n\n c \t d", "it's 12 34's  !!", "<|endoftext|> é ñ 漢字 \u200b x", "\x1c\x00 q", "word" * 500]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_the_tokenizers(spark, tokenizer):
    from tokenizers import Tokenizer

    theirs, end = Tokenizer.from_file(tokenizer), np.array([packing.END_ID], "<u4").tobytes()
    added = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>\n c", "<|endoftext", "<<|endoftext|>> é 漢字", "x <|ENDOFTEXT|>"]
    texts = [*added, "", "a  b\n\n c \t d", "<|endoftext|>it's 12 34's  !!" * 9]
    rows = {r.doc_id: r for r in packing.pieces(docs_of(spark, texts), tokenizer).collect()}
    for k, t in enumerate(texts):
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert (rows[k].length, rows[k].ids_crc32) == (len(ids) + 1, zlib.crc32(np.array(ids, "<u4").tobytes() + end)), t


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plans_hold_every_piece_once(counts):
    used = Counter()
    for pattern, times in packing.plan(counts, 64, 20):
        assert times > 0 and sum(n * k for n, k in pattern.items()) <= 64
        for n, k in pattern.items():
            used[n] += k * times
    assert used == Counter(counts)


def test_plan_is_close_to_the_bound():
    counts = {n: 50 for n in range(5, 60)}
    bound = -(-sum(n * c for n, c in counts.items()) // 64)
    assert sum(t for _, t in packing.plan(counts, 64)) <= 1.02 * bound + 1


def fewest(pieces, capacity, most):
    """The least number of bins, by depth-first search over the pieces, longest first."""
    pieces = sorted(pieces, reverse=True)

    def fits(k, rooms):
        if k == len(pieces):
            return True
        seen = set()
        for i, room in enumerate(rooms):
            if room >= pieces[k] and room not in seen:
                seen.add(room)
                if fits(k + 1, rooms[:i] + (room - pieces[k],) + rooms[i + 1 :]):
                    return True
        return False

    return next(n for n in range(-(-sum(pieces) // capacity), most + 1) if fits(0, (capacity,) * n))


def test_plans_against_exact_optima():
    rng, worse = np.random.default_rng(3), 0
    for _ in range(60):
        counts = Counter(rng.integers(2, 20, rng.integers(2, 12)).tolist())
        needed = sum(times for _, times in packing.plan(counts, 24, 30))
        best = fewest(list(counts.elements()), 24, needed)
        assert best <= needed <= best + 1
        worse += needed > best
    assert worse <= 6


def test_rounding_takes_the_linear_programs_patterns():
    counts = {17: 40, 23: 40, 24: 40, 31: 10, 33: 10}
    solution, price = packing.fractional(counts, 64, packing.ROUNDS, packing.ETA)
    assert sum(x for _, x in solution) == pytest.approx(sum(n * c for n, c in counts.items()) / 64, rel=0.05) and set(price) == set(counts)
    planned = {tuple(sorted(p.items())) for p, _ in packing.plan(counts, 64)}
    assert planned & {tuple(sorted(p.items())) for p, x in solution if x >= 1}


def test_places_with_clashing_names_and_hot_lengths(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") < 300, 40).otherwise(F.col("id") % 60 + 1).cast("long").alias("length"), *[F.lit(7).alias(c) for c in ("n", "block", "blocks", "rank", "row", "offset")])
    out = packing.place(rows, 64, block_rows=32).collect()
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(out) == 500 and len({r.id for r in out}) == 500 and out[0].block == out[0].row == 7
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64


def test_packing_places_pieces(spark, tokenizer):
    df = docs_of(spark, [*EDGES, *(f"text number {k} " * (k % 40) for k in range(200))], sequence_id=5)
    rows = packing.pack(df, tokenizer).collect()
    own = packing.Encoder(tokenizer)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d in df.collect():
        ids, pieces = own.encode(d.text or "") + np.array([2], "<u4").tobytes(), sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids) // 4
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        assert all(r.length == 1024 for r in pieces[1:])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(df.limit(0), tokenizer).count() == 0
