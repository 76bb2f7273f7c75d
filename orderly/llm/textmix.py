"""Language-model scores of whole texts by logistic mixing of hashed-context bit predictors (see ``contextmix`` for the network).

A text is coded as one stream of bytes: its words (A-Z lower-cased) and one end, with a space behind each. A byte's contexts are the bytes
before it, whichever words they belong to; only before a text's first byte stands the same history for all. Every bit of every byte is
predicted by the mixed predictors, and nothing else takes part in the score.

What is gathered. A byte with its longest context is one integer, a key. Keys are counted in the tasks and then over all training rows in a
shuffle, so slots, steps of the weights and refinement take each distinct key once, with its number of occurrences. The slots (a fixed number)
and weights are the model that every task is sent. The commonest keys (a fixed number) are scored once for all tasks; the others are where they occur,
and kept in a table of fixed size, whose entries the latest key takes over. Distinct words are counted for the base score alone: the COMMON commonest are looked up where the texts are read, the others
travel to the table of words, so no word is a hot key of that join.

Null texts are empty; an empty text is its end alone. A null id counts as the empty string in the split. Repeated rows are scored one by one (and
counted as often as they are there). Without training rows every bit has probability one half. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderly.llm.contextmix import CELL_WIDTH, CELLS, END, FREQUENT, GATES, HELD_OUT, HISTORY, LIMIT, LONGEST_SHARED, MULTIPLIERS, NEAR, PIECE, STEPS, Mixer, bits, pieces, remainder, train, word_classes
from orderly.session import bounded_batches, materialize, release

COMMON = 200_000
MOST_KEYS = 3_000_000  # distinct ones that a task counts before it passes them on
TEXTS_BYTES = 1 << 19  # of texts that are worked on at once
SORTED = 1 << 22  # keys that are sorted at once
BUCKET = 1 << 22  # bytes of text for each bucket of keys
FIXED, FIXED_BITS = 2_500_000, 22  # commonest keys that are scored beforehand, and the size of their table
KEPT_BITS = (18,)
STEP = 1 << 14  # keys that are scored at once, in a processor's cache
STEPPED = 1 << 18  # keys in whose permutation steps are taken


SPACE = np.uint64(32)
CONTEXT = (1 << 48) - 1  # six bytes
INPUTS = ("1", "2", "3", "4", "word", "6")
SLOT_BITS = (19, 19, 20, 20, 21, 21)
OFFSETS = tuple(int(x) for x in np.cumsum([0, *[1 << b for b in SLOT_BITS]]))


class Block:
    """Stretches of texts, as tokens: before each stretch stands what its first contexts hold. numbers are those of the stretches' texts."""

    def __init__(self):
        self.tokens: list[bytes] = []
        self.begins: list[int] = []
        self.kinds: list[int] = []
        self.numbers: list[int] = []
        self.size = 0

    def add(self, number: int, words: list[bytes], last: bool, past: bytes = HISTORY[:-1], kind: int = 0) -> None:
        self.begins.append(len(self.tokens))
        self.numbers.append(number)
        self.kinds.append(kind)
        self.tokens.append(past)
        self.tokens += words
        if last:
            self.tokens.append(END)
        self.size += sum(map(len, words)) + len(words)

    def keys(self, classes: dict[bytes, int]) -> np.ndarray:
        """For every byte of the words and the space behind each: class, the six bytes before and the byte itself as one integer."""
        data = np.frombuffer(b" ".join([*self.tokens, b""]), np.uint8)
        coded = data.astype(np.uint64)
        self.lengths = np.diff(np.flatnonzero(data == np.uint8(SPACE)), prepend=-1)
        if len(self.lengths) > len(self.tokens):  # what stands before a stretch may hold spaces
            self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens)) + 1
        self.real = np.ones(len(self.tokens), bool)
        self.real[self.begins] = False
        own = np.fromiter(map(classes.get, self.tokens, repeat(0)), np.uint64, len(self.tokens))
        own[self.begins] = self.kinds
        marked = np.where((own > 0) | ~self.real, np.arange(len(own)), 0)
        behind = own[np.maximum.accumulate(marked)]
        self.behind = int(behind[-1])
        two = coded.copy()
        two[1:] |= coded[:-1] << np.uint64(8)
        keys = two.copy()
        keys[2:] |= two[:-2] << np.uint64(16)
        keys[4:] |= two[:-4] << np.uint64(32)
        keys[6:] |= coded[:-6] << np.uint64(48)
        keys |= np.repeat(np.append(np.uint64(0), behind[:-1]) << np.uint64(56), self.lengths)
        return keys[np.repeat(self.real, self.lengths)]

    def bytes_of(self) -> np.ndarray:
        """The number of coded bytes by stretch."""
        return np.add.reduceat(np.where(self.real, self.lengths, 0), self.begins)


def read_blocks(texts: Iterator[str | None], classes: dict[bytes, int], most: int = TEXTS_BYTES) -> Iterator[tuple[Block, np.ndarray]]:
    """Texts in blocks of about ``most`` bytes, each with its keys. Contexts run through a text, also from one block to the next."""
    block = Block()
    for number, text in enumerate(texts):
        parts = pieces(text, most)
        words, kept = next(parts), {}
        for following in parts:  # a text of several pieces
            block.add(number, words, False, **kept)
            yield block, block.keys(classes)
            tail = b" ".join([kept.get("past", HISTORY[:-1]), *words[-len(HISTORY) :]])
            kept, block, words = {"past": tail[1 - len(HISTORY) :], "kind": block.behind}, Block(), following
        block.add(number, words, True, **kept)
        if block.size >= most:
            yield block, block.keys(classes)
            block = Block()
    if block.tokens:
        yield block, block.keys(classes)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often they are there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


class TextMixer(Mixer):
    """Predictors by the last 1, 2, 3, 4 and 6 bytes, whatever words they belong to, and by the bytes of the word so far (the last six at
    most), all but the longest also by the class of the last frequent word."""

    size = OFFSETS[-1]

    @staticmethod
    def contexts(keys: np.ndarray) -> list[np.ndarray]:
        context, kind = (keys >> np.uint64(8)) & np.uint64(CONTEXT), keys >> np.uint64(56)
        out = [(context & np.uint64((1 << (8 * k)) - 1)) | (kind << np.uint64(8 * k)) for k in (1, 2, 3, 4)]
        word = np.full(len(keys), CONTEXT, np.uint64)
        for k in range(6, 0, -1):
            word[(context >> np.uint64(8 * (k - 1))) & np.uint64(255) == SPACE] = (1 << (8 * k)) - 1
        out += [(context & word) | (kind << np.uint64(48)), context]
        return [out[0] << np.uint64(8), *(x * MULTIPLIERS[0] for x in out[1:])]

    @staticmethod
    def places(base: list[np.ndarray], node: np.ndarray) -> np.ndarray:
        """Slots by input and key; the first is not hashed."""
        out = np.empty((len(INPUTS), len(node)), np.int64)
        out[0] = base[0] | node
        own = node * MULTIPLIERS[1]
        for i in range(1, len(INPUTS)):
            mixed = (base[i] ^ own) * MULTIPLIERS[2]
            mixed ^= mixed >> np.uint64(29)
            out[i] = ((mixed * MULTIPLIERS[0]) >> np.uint64(64 - SLOT_BITS[i])).view(np.int64) + OFFSETS[i]
        return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts, from several such lists."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else np.zeros(0, np.int64)


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = keys * MULTIPLIERS[0]
    return ((mixed ^ (mixed >> np.uint64(32))) * MULTIPLIERS[1]) >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which compress better."""
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers_of(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def key_counts(docs: DataFrame, id_col: str, text_col: str, classes: dict[bytes, int], most: int = MOST_KEYS, bucket_bits: int = 6) -> DataFrame:
    """(key, n) of the training rows: how often a byte follows its longest context. Tasks pass on what they have counted by hashed buckets of
    keys, each as two columns of numbers; a bucket is added up at once, so there should be about one for every BUCKET bytes of text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def passed() -> Iterator[pa.RecordBatch]:
            key, n = keys[0], counts[0]
            bucket = bucket_of(key, bucket_bits).astype(np.uint16 if bucket_bits <= 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            key, n, bucket = key[order], n[order].astype(np.int64), bucket[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]).tolist()
            for start, stop in zip(starts, [*starts[1:], len(key)], strict=True):
                both = [pa.array([planes(x[start:stop])], pa.binary()) for x in (key, n)]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[start])], pa.int32()), *both], ["bucket", "keys", "counts"])

        def sorted_at_once() -> Iterator[np.ndarray]:
            found, held = [], 0
            for _, key in read_blocks((text.as_py() for batch in batches for text in batch.column("text")), classes):
                found.append(key)
                held += len(key)
                if held >= SORTED:
                    yield np.concatenate(found)
                    found, held = [], 0
            if found:
                yield np.concatenate(found)

        for found in sorted_at_once():
            key, n = distinct(found)
            keys.append(key)
            counts.append(n)
            size += len(key)
            if size > most:
                keys, counts = ([x] for x in summed(keys, counts))
                size = len(keys[0])
                if size > most // 2:
                    yield from passed()
                    keys, counts, size = [], [], 0
        if keys:
            keys, counts = ([x] for x in summed(keys, counts))
            yield from passed()

    def added(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for found, name, kind in ((keys, "keys", np.uint64), (counts, "counts", np.int64)):
                found += [numbers_of(x.as_py(), kind) for x in batch.column(name)]
        key, n = summed(keys, counts)
        for start in range(0, len(key), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array(x[start : start + PIECE].view(np.int64)) for x in (key, n)], ["key", "n"])

    rows = docs.where(remainder(F.col(id_col)) != HELD_OUT).select(F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(counted, "bucket int, keys binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(added, "key long, n long")  # sorted by bucket and key, so steps come in the same order in every run


def counted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, how often) from batches of (key, n), in parts of about STEPPED."""
    parts, size = [], 0
    for batch in batches:
        parts.append([batch.column(x).to_numpy() for x in ("key", "n")])
        size += batch.num_rows
        if size >= STEPPED:
            yield np.concatenate([k for k, _ in parts]).view(np.uint64), np.concatenate([n for _, n in parts])
            parts, size = [], 0
    if parts:
        yield np.concatenate([k for k, _ in parts]).view(np.uint64), np.concatenate([n for _, n in parts])


def word_counts(docs: DataFrame, id_col: str, text_col: str, most: int = 500_000) -> DataFrame:
    """(word, c, n) of every distinct word: occurrences in training rows and in all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, learned = found = Counter(), Counter()

        def passed() -> Iterator[pa.RecordBatch]:
            for learn, counts in enumerate(found):
                words = list(counts)
                for start in range(0, len(words), PIECE):
                    part = words[start : start + PIECE]
                    n = np.fromiter(map(counts.__getitem__, part), np.int64, len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(n * learn), pa.array(n)], ["word", "c", "n"])
                counts.clear()

        for batch in batches:
            for text, learn in zip(batch.column("text"), batch.column("learn").to_pylist(), strict=True):
                for words in pieces(text.as_py()):
                    found[learn].update(words)
                found[learn][END] += 1
                if len(held) + len(learned) > most:
                    yield from passed()
        yield from passed()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), (remainder(F.col(id_col)) != HELD_OUT).alias("learn"))
    return rows.mapInArrow(counted, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def between(x: np.ndarray, least: float, most: float) -> np.ndarray:
    return np.minimum(np.maximum(x, np.float32(least)), np.float32(most))


class Trained:
    """A mixer that learns no more, in single precision: what it reads off a slot's counts is worked out once."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, refined: np.ndarray):
        self.slots, self.by_order, self.refined = slots, np.ascontiguousarray(weights.T.astype(np.float32)), refined

    @staticmethod
    def tables(model: TextMixer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds by slot, whose last three bits are replaced by how well the slot is known (0: not seen, or else the place in STEPS plus 1); the
        weights; the refined probabilities."""
        known = np.where(model.seen > 0, np.maximum(np.searchsorted(STEPS, model.seen, side="right"), 1), 0).astype(np.int32)
        odds = model.log_odds(model.seen, model.ones).astype(np.float32).view(np.int32)
        return odds & ~np.int32(7) | known, model.weights, np.clip(model.cells[1] / model.cells[0], 1e-6, 1 - 1e-6).astype(np.float32).reshape(-1)

    def log10_of(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each key's byte after its context."""
        total = np.ones(len(keys))
        for start in range(0, len(keys), STEP):
            part = keys[start : start + STEP]
            base = TextMixer.contexts(part)
            for node, bit in bits(part):
                found = self.slots[TextMixer.places(base, node)]
                known, gate = found & np.int32(7), np.full(len(part), (len(INPUTS) - 1) * len(STEPS), np.int32)
                for k in range(len(INPUTS)):
                    np.copyto(gate, known[k] + np.int32(k * len(STEPS) - 1), where=known[k] > 0)
                at, mixed = node.view(np.int64) + GATES, np.zeros(len(part), np.float32)
                for weights, odds in zip(self.by_order, found.view(np.float32), strict=True):
                    mixed += odds * (weights[gate] + weights[at])
                mixed = between(mixed, -LIMIT, LIMIT)
                place = between(mixed / np.float32(CELL_WIDTH) + np.float32(CELLS // 2), 0, CELLS - 1.001)
                low = place.astype(np.int32)
                share, cell = place - low, gate * CELLS + low
                refined = self.refined[cell] * (1 - share) + self.refined[cell + 1] * share
                odds = between((mixed + np.log(refined / (1 - refined))) / 2, -13.8155, 13.8155)
                total[start : start + STEP] /= 1 + np.exp(np.where(bit == 1, -odds, odds))
        return np.log10(total)


def places_of(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    mixed = keys * MULTIPLIERS[0]
    mixed ^= mixed >> np.uint64(31)
    mixed *= MULTIPLIERS[1]
    mixed >>= shift
    return mixed.view(np.int64)


class Kept:
    """The log10 probabilities of keys: those of the commonest in a table that stays as it is, where a key stands in its own place or the one
    beside it; the others in small tables, where later keys take the places of earlier ones."""

    def __init__(self, model: Trained, bits: Sequence[int] = KEPT_BITS, common: tuple[np.ndarray, np.ndarray] | None = None, common_bits: int = FIXED_BITS):
        """common: keys, the commonest last, and their log10 probabilities."""
        self.model = model
        self.tables = [(np.uint64(64 - b), np.full(1 << b, ~np.uint64(0)), np.zeros(1 << b, np.float32)) for b in bits]  # no key has all bits
        keys, values = common or (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        common_bits = common_bits if len(keys) else 1
        self.shift, self.held, self.values = np.uint64(64 - common_bits), np.full(1 << common_bits, ~np.uint64(0)), np.zeros(1 << common_bits, np.float32)
        at = places_of(keys, self.shift)
        self.held[at], self.values[at] = keys, values
        lost = np.flatnonzero(self.held[at] != keys)
        lost = lost[self.held[at[lost] ^ 1] == ~np.uint64(0)]
        self.held[at[lost] ^ 1], self.values[at[lost] ^ 1] = keys[lost], values[lost]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out, others = np.empty(len(keys), np.float32), [np.zeros(0, np.int64)]
        for start in range(0, len(keys), STEP):
            part = keys[start : start + STEP]
            at = places_of(part, self.shift)
            found = self.values.take(at)
            missed = np.flatnonzero(self.held.take(at) != part)
            beside = at[missed] ^ 1
            found[missed] = self.values.take(beside)
            others.append(missed[self.held.take(beside) != part[missed]] + start)
            out[start : start + STEP] = found
        missed = np.concatenate(others)
        if len(missed):
            out[missed] = self.rarer(keys[missed])
        return out

    def rarer(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        if level == len(self.tables):
            return self.model.log10_of(keys).astype(np.float32)
        shift, held, values = self.tables[level]
        at = places_of(keys, shift)
        out = values[at]
        missed = np.flatnonzero(held[at] != keys)
        if len(missed):
            asked = keys[missed]
            if level:  # distinct already
                out[missed] = found = self.rarer(asked, level + 1)
            else:
                new, _ = distinct(asked)
                out[missed] = found = self.rarer(new, level + 1)[np.searchsorted(new, asked)]
            held[at[missed]], values[at[missed]] = asked, found
        return out


def common_keys(keys: DataFrame, tables: Broadcast, most: int = FIXED) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log10 probabilities) of the commonest keys, ``most`` at most, the commonest last (by eighths of a doubling): those
    counted more often than a bound that a histogram gives. Their scores are worked out once, in the tasks."""
    step = F.floor(F.log2("n") * 8).cast("short")  # eighths of a doubling
    least, held = None, 0
    for r in sorted(keys.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r["step"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trained(*tables.value)
        for batch in batches:
            key = batch.column("key").to_numpy()
            lp = pa.array(model.log10_of(key.view(np.uint64)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("step"), lp], ["key", "step", "lp"])

    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    found = keys.select("key", step.alias("step")).where(F.col("step") >= least).mapInArrow(scored, "key long, step short, lp float").toArrow()
    key, steps, lp = (found.column(x).to_numpy() for x in ("key", "step", "lp"))
    order = np.argsort(steps, kind="stable")
    return key[order].view(np.uint64), lp[order]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score (the unigram model's), score (this model's log10
    probability), n_bytes (of the words, with a byte behind each) and bits_per_byte."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = materialize(word_counts(docs, id_col, text_col))
    short = counted.where(F.octet_length("word") <= LONGEST_SHARED)
    frequent = short.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).orderBy(F.desc("c"), "word").limit(FREQUENT)
    classes = word_classes(docs, id_col, text_col, [bytes(r["word"]) for r in frequent.collect()])
    learned, different, coded = (int(x or 0) for x in counted.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.col("c") * (F.octet_length("word") + 1))).first())
    keys = materialize(key_counts(docs, id_col, text_col, classes, bucket_bits=max(4, (coded // BUCKET).bit_length())))
    model = train(keys, read=counted_keys, mixer=TextMixer)
    shipped = spark.sparkContext.broadcast(Trained.tables(model))
    del model
    common_scores = spark.sparkContext.broadcast(common_keys(keys, shipped))
    release(keys)
    floor = float(learned + different + 1)
    table = short.orderBy(F.desc("n"), "word").limit(common).select("word", "c").toArrow()
    words, c = table.column("word").to_pylist(), table.column("c").to_numpy()
    near, far = {w: i for i, w in enumerate(words[:NEAR])}, {w: i for i, w in enumerate(words[NEAR:], NEAR)}  # the commonest apart, in a table that stays in a processor's cache
    looked_at = spark.sparkContext.broadcast((near, far, np.stack([c > 0, np.log10((c + 1) / floor)]) if len(c) else np.zeros((2, 0))))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "n_tokens", "n_bytes", "n_known", "base_score", "score", "word", "tf"]
        near, far, values = looked_at.value
        kept = Kept(Trained(*shipped.value), common=common_scores.value)

        def sums(texts: Sequence[str | None]) -> tuple[list[np.ndarray], Counter]:
            """n_tokens, n_bytes, n_known, base and score by text, and how often rare words are in them."""
            n, size, known, base, total = np.zeros((5, len(texts)))
            met: Counter = Counter()
            for block, keys in read_blocks(iter(texts), classes):
                tokens, lengths, begins = block.tokens, block.bytes_of(), np.array(block.begins)
                at = np.fromiter(map(near.get, tokens, repeat(-1)), np.int32, len(tokens))
                missed = np.flatnonzero((at < 0) & block.real)
                at[missed] = np.fromiter(map(far.get, map(tokens.__getitem__, missed.tolist()), repeat(-1)), np.int32, len(missed))
                counts = np.diff(np.append(begins, len(tokens)))
                owner = np.repeat(block.numbers, counts)
                there = (at >= 0) & block.real
                rare = np.flatnonzero(~there & block.real)
                met.update(zip(owner[rare].tolist(), map(tokens.__getitem__, rare.tolist()), strict=True))
                for out, value in zip((known, base), values, strict=True):
                    out += np.bincount(owner[there], value[at[there]], len(texts))
                sums = np.add.reduceat(kept.log10(keys), np.cumsum(lengths) - lengths, dtype=np.float64) if len(keys) else 0
                for out, of in ((n, counts - 1), (size, lengths), (total, sums)):
                    np.add.at(out, block.numbers, of)
            return [*(x.astype(np.int64) for x in (n, size, known)), base, total], met

        def parts() -> Iterator[tuple[list[int], pa.Array, list[str | None]]]:
            """Rows of a batch, in parts of about TEXTS_BYTES."""
            for batch in batches:
                rows, start, size = batch.column("row").to_pylist(), 0, 0
                texts = batch.column("text")
                for i, text in enumerate(texts):
                    size += len(text.as_py() or "")
                    if size >= TEXTS_BYTES or i == len(texts) - 1:
                        yield rows[start : i + 1], batch.column("id")[start : i + 1], texts[start : i + 1].to_pylist()
                        start, size = i + 1, 0

        for rows, ids, texts in parts():
            heads, met = sums(texts)
            m = len(met)
            numbers = [pa.concat_arrays([pa.array(x), pa.nulls(m, pa.float64() if x.dtype == np.float64 else pa.int64())]) for x in heads]
            marks = [b"\xff%d" % row for row in rows]  # no word of a text, and a key of its own for every row
            words = pa.array(marks + [w for _, w in met], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows + [rows[i] for i, _ in met], pa.int64()), pa.concat_arrays([ids, pa.nulls(m, ids.type)]), *numbers, words, pa.array([None] * len(rows) + list(met.values()), pa.int64())], names
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    sums = "n_tokens long, n_bytes long, n_known long, base_score double, score double"
    parts = rows.mapInArrow(looked_up, f"row long, id {id_type}, {sums}, word binary, tf long")
    met = parts.join(counted.select("word", "c"), "word", "left")
    tf, head, c = F.col("tf"), F.col("tf").isNull(), F.coalesce("c", F.lit(0))
    added = {"n_known": F.when(c > 0, tf).otherwise(0), "base_score": tf * F.log10((c + 1) / F.lit(floor))}
    sums = [F.sum(x).alias(x) for x in ("n_tokens", "n_bytes", "score")]
    summed_up = met.groupBy("row").agg(F.max("id").alias("id"), *sums, *[F.sum(F.when(head, F.col(x)).otherwise(y)).alias(x) for x, y in added.items()])
    return summed_up.select(
        F.col("id").alias(id_col),
        (remainder(F.col("id")) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(learned).cast("long").alias("train_tokens"),
        "base_score",
        F.round("score", 6).alias("score"),
        "n_bytes",
        (-F.round("score", 6) * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
