"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lower-cased) and one end. Frequent words that occur in the same documents form classes (languages, say), and the class of the last such
word is known when the next word is coded. The model codes a word byte by byte with a space behind it, every byte as eight binary
decisions. Each predictor tells a bit from how often it was 0 and 1 after the last k bytes of the word (before its first byte
stands a space), the class for the shorter ones, and the bits of the byte so far, found in a table of hashed slots. Their log odds are combined with weights that
two gates choose, the longest context that was seen with how often, and the partial byte; the mixed odds are refined by an adaptive table over the
first gate and the odds themselves. Weights are learned online: every task takes steps on its words in turn, each occurrence predicted from the
counts without itself, and the tasks' weights are averaged round by round; the last round also fills the refinement table. These bits
are what a word costs that was not seen before; words that were seen share the rest by absolute discounting: counts within the class, less
the discount, then counts over all classes, then the bits.

What is gathered. Occurrences of every distinct word by class are counted over all documents, so that table follows the corpus; slot counts come from the distinct words
of the training rows. The slots (a fixed number, see ``SLOT_BITS``) and the weights are the model that every task is sent. A distinct word is scored once a class,
whatever its number of occurrences. Words that make up at least ``SHARE`` of all tokens, which are 1 / SHARE at most, are looked up
where the texts are read; only the others travel to the table of words, so no word is a hot key of that join.

Null texts are empty; an empty text is its end alone. A null id counts as the empty string in the split. Repeated rows are scored one by one (and counted as often
as they are there). Without training rows every bit has probability one half. Other columns are ignored; an empty table gives no rows. Words
of any length are scored whole, in segments.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderly.session import bounded_batches, materialize

SHARE = 2e-6
LONGEST_SHARED = 256
NEAR = 2_000
FOLDS, HELD_OUT = 7, 2
END = b"\n"

FREQUENT = 64  # words that may give a class
STRETCH = 10_000  # of words in which a frequent one occurs
CLASSES = 8  # with the one before any such word
ALIKE = 0.25  # least mean similarity of words in a class
ORDERS = (0, 1, 2, 3, 4, 6)
WITH_CLASS = 3  # up to this order contexts are told apart by class
SLOT_BITS = (11, 19, 20, 20, 20, 21)
OFFSETS = tuple(int(x) for x in np.cumsum([0, *[1 << b for b in SLOT_BITS]]))
SLOTS = OFFSETS[-1]
RANGE = 1 << 14  # of slots whose counts travel together
PRIOR = 0.4  # added to both counts of a slot
LIMIT = 13.0  # of log odds
STEPS = (1, 2, 4, 16)  # counts at which the longest seen order counts as better known
GATES = len(ORDERS) * len(STEPS)
NODES = 256
CELLS = 33  # of the refinement, over log odds from -8 to 8
CELL_WIDTH = 0.5
CELL_PRIOR = 20.0
RATE = 0.05
ROUNDS = 1
CHUNK = 16_384  # distinct (context, byte) pairs a step
HISTORY = b"\0\0\0\0\0 "
SEGMENT = 65_536
BLOCK_BYTES = 1 << 21
PIECE = 1 << 16  # of the distinct keys of a block, or of counted words, that are worked on at once
MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def remainder(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


# --- words of texts ---


def pieces(text: str | None, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text in lists, long texts in several."""
    data, start = (text or "").encode(), 0
    while len(data) - start > most:
        stop = max(data.rfind(space, start, start + most) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if stop <= start:
            break
        yield data[start:stop].lower().split()
        start = stop
    yield data[start:].lower().split()


def kinds_of(words: list[bytes], classes: dict[bytes, int], now: int) -> tuple[np.ndarray, int]:
    """The class of every word's place, which is that of the last frequent word before it (``now`` before all), and the class behind them."""
    own = np.fromiter(map(classes.get, words, repeat(0)), np.int8, len(words))
    marks = np.flatnonzero(own)
    if not len(marks):
        return np.full(len(words), now, np.int8), now
    ends = np.append(marks, len(words) - 1)
    return np.repeat(np.append(np.int8(now), own[marks]), np.diff(ends, prepend=-1)), int(own[marks[-1]])


def runs(text: str | None, classes: dict[bytes, int]) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text and its end in runs of one class (0: no frequent word yet)."""
    now = 0
    for words in pieces(text):
        kinds, behind = kinds_of(words, classes, now)
        cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(words)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield int(kinds[start]), words[start:end] if end - start < len(words) else words
        now = behind
    yield now, [END]


def tokens(text: str | None, classes: dict[bytes, int]) -> dict[int, Counter]:
    """The words of a text and its end, counted by class."""
    found: dict[int, Counter] = {}
    for k, words in runs(text, classes):
        found.setdefault(k, Counter()).update(words)
    return found


def training_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(remainder(F.col(id_col)) != HELD_OUT).select(F.col(text_col).cast("string").alias("text"))


def frequent_words(docs: DataFrame, id_col: str, text_col: str, most: int = 200_000) -> list[bytes]:
    """The FREQUENT commonest words of the training rows. A task counts stretches of about ``most`` distinct words, and passes on those that
    make up one in STRETCH of a stretch at least; words that are rarer everywhere give no class."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()

        def flushed() -> pa.RecordBatch:
            least = found.total() / STRETCH
            rows = [(w, c) for w, c in found.items() if c >= least]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column("text"):
                for words in pieces(text.as_py()):
                    found.update(words)
                if len(found) > most:
                    yield flushed()
        yield flushed()

    counts = training_texts(docs, id_col, text_col).mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    rows = counts.where(F.octet_length("word") <= LONGEST_SHARED).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    return [bytes(r["word"]) for r in rows]


def grouped(together: np.ndarray) -> list[list[int]]:
    """Groups of words by average linkage, from the numbers of documents that hold both; the largest CLASSES - 1 of them."""
    alone = np.sqrt(np.maximum(np.diag(together), 1.0))
    alike = together / alone[:, None] / alone[None, :]
    groups = [[i] for i in range(len(together))]
    while len(groups) > 1:
        best, a, b = max((alike[np.ix_(x, y)].mean(), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups[:i]))
        if best < ALIKE:
            break
        groups[-b] += groups.pop(-a)
    return sorted(groups, key=lambda g: (-together[g, g].sum(), g))[: CLASSES - 1]


def word_classes(docs: DataFrame, id_col: str, text_col: str, words: list[bytes] | None = None) -> dict[bytes, int]:
    """A class from 1 for frequent words (or those given), from the training rows: words that share their documents share a class."""
    words = frequent_words(docs, id_col, text_col) if words is None else words
    place, m = {w: i for i, w in enumerate(words)}, len(words)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = np.zeros((m, m), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                met = [place[w] for w in set().union(*[place.keys() & set(part) for part in pieces(text.as_py())])]
                together[np.ix_(met, met)] += 1
        at = np.flatnonzero(together)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(together.reshape(-1)[at], pa.int64())], ["at", "n"])

    together = np.zeros(m * m)
    for r in training_texts(docs, id_col, text_col).mapInArrow(paired, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        together[r["at"]] = r["n"]
    return {words[i]: 1 + k for k, group in enumerate(grouped(together.reshape(m, m)) if m else []) for i in group}


def word_counts(docs: DataFrame, id_col: str, text_col: str, classes: dict[bytes, int], most: int = 500_000) -> DataFrame:
    """(word, c, n) of every distinct word: occurrences by class in training rows and in all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(Counter(), Counter()) for _ in range(CLASSES)]

        def flushed() -> Iterator[pa.RecordBatch]:
            """One class after another, so that little stands beside the counts."""
            for k, (held, learned) in enumerate(found):
                words = list(learned.keys() | held.keys())
                for start in range(0, len(words), PIECE):
                    part = words[start : start + PIECE]
                    c = np.fromiter((learned[w] for w in part), np.int64, len(part))
                    n = c + np.fromiter((held[w] for w in part), np.int64, len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(np.full(len(part), k, np.int32)), pa.array(c), pa.array(n)], ["word", "k", "c", "n"])
                held.clear()
                learned.clear()

        for batch in batches:
            for text, learn in zip(batch.column("text"), batch.column("learn").to_pylist(), strict=True):
                for k, words in runs(text.as_py(), classes):
                    found[k][learn].update(words)
                if sum(len(c) for pair in found for c in pair) > most:
                    yield from flushed()
        yield from flushed()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), (remainder(F.col(id_col)) != HELD_OUT).alias("learn"))
    by_class = rows.mapInArrow(counted, "word binary, k int, c long, n long").repartition("word")
    by_class = by_class.groupBy("word", "k").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    sums = [F.array(*[F.sum(F.when(F.col("k") == k, F.col(x)).otherwise(0)) for k in range(CLASSES)]).alias(x) for x in ("c", "n")]
    return by_class.groupBy("word").agg(*sums).sortWithinPartitions("word")  # neighbours share contexts, and online steps come in the same order in every run


# --- contexts, slots and the network ---


def blocks(units: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(class, context and byte as one integer, number of the unit) for every byte of units (class, word) and the space behind each."""
    parts, owners, size = [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        past = np.zeros(len(data), np.uint64)
        for back in range(1, len(HISTORY) + 1):
            past[back:] |= data[:-back] << np.uint64(8 * (back - 1))
        lengths = np.array([len(p) for p in parts])
        unit = np.repeat(np.array(owners), lengths - len(HISTORY))
        kind = np.array([k for k, _ in units], np.uint64)[unit] << np.uint64(56)
        real = np.ones(len(data), bool)
        starts = np.cumsum(lengths) - lengths
        real[(starts[:, None] + np.arange(len(HISTORY))).reshape(-1)] = False
        return ((past << np.uint64(8)) | data)[real] | kind, unit

    for number, (_, word) in enumerate(units):
        coded = HISTORY + word + b" "
        for start in range(0, len(coded) - len(HISTORY), SEGMENT):
            parts.append(coded[start : start + len(HISTORY) + SEGMENT])
            owners.append(number)
            size += len(parts[-1])
            if size >= BLOCK_BYTES:
                yield made()
                parts, owners, size = [], [], 0
    if parts:
        yield made()


def bases(keys: np.ndarray) -> list[np.ndarray]:
    """For each order, what its slots are numbered or hashed from besides the partial byte."""
    context, kind, out = (keys >> np.uint64(8)) & np.uint64((1 << 48) - 1), keys >> np.uint64(56), []
    for k in ORDERS:
        base = context & np.uint64((1 << (8 * k)) - 1)
        if k <= WITH_CLASS:
            base |= kind << np.uint64(8 * k)
        out.append(base * (MULTIPLIERS[0] if k > 1 else np.uint64(256)))
    return out


def slots(base: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """Slots by order and key; orders 0 and 1 are not hashed."""
    out = np.empty((len(ORDERS), len(node)), np.int64)
    for i, k in enumerate(ORDERS):
        if k > 1:
            mixed = (base[i] ^ (node * MULTIPLIERS[1])) * MULTIPLIERS[2]
            mixed ^= mixed >> np.uint64(29)
            out[i] = ((mixed * MULTIPLIERS[0]) >> np.uint64(64 - SLOT_BITS[i])).astype(np.int64) + OFFSETS[i]
        else:
            out[i] = (base[i] + node).astype(np.int64) + OFFSETS[i]
    return out


def bits(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(partial byte, bit) for the eight bits of the keys' bytes, the highest first."""
    byte = keys & np.uint64(255)
    for shift in range(7, -1, -1):
        yield (np.uint64(256) | byte) >> np.uint64(shift + 1), ((byte >> np.uint64(shift)) & np.uint64(1)).astype(np.int8)


class Mixer:
    """Slot counts, the weights of both gates, and the refinement table."""

    size = SLOTS

    @staticmethod
    def contexts(keys: np.ndarray) -> list[np.ndarray]:
        return bases(keys)

    @staticmethod
    def places(base: list[np.ndarray], node: np.ndarray) -> np.ndarray:
        return slots(base, node)

    def __init__(self, seen: np.ndarray, ones: np.ndarray, weights: np.ndarray | None = None, cells: np.ndarray | None = None):
        self.seen, self.ones = seen, ones  # float32, by slot
        if weights is None:
            weights = np.zeros((GATES + NODES, len(ORDERS)))
            weights[:GATES] = 0.3
        if cells is None:
            odds = (np.arange(CELLS) - CELLS // 2) * CELL_WIDTH
            cells = np.stack([np.full((GATES, CELLS), CELL_PRIOR), np.tile(CELL_PRIOR / (1 + np.exp(-odds)), (GATES, 1))])
        self.weights, self.cells = weights, cells
        self.squares = np.full(weights.shape, 1e-4)

    def inputs(self, base: list[np.ndarray], node: np.ndarray, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log odds by order, first gate). With the bit given, its own occurrence is taken out of the counts."""
        at = self.places(base, node)
        n, ones = self.seen[at], self.ones[at]
        if bit is not None:
            n, ones = np.maximum(n - 1, 0), np.maximum(ones - bit, 0)
        odds = self.log_odds(n, ones)
        longest = len(ORDERS) - 1 - np.argmax(n[::-1] > 0, axis=0)
        known = np.take_along_axis(n, longest[None], axis=0)[0]
        return odds, longest * len(STEPS) + np.maximum(np.searchsorted(STEPS, known, side="right") - 1, 0)

    @staticmethod
    def log_odds(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
        odds = np.log((ones + np.float32(PRIOR)) / (np.maximum(n - ones, 0) + np.float32(PRIOR)))
        return np.clip(odds, -LIMIT, LIMIT)

    def mixed(self, odds: np.ndarray, gate: np.ndarray, node: np.ndarray) -> np.ndarray:
        weights = (self.weights[gate] + self.weights[GATES + node.astype(np.int64)]).astype(np.float32)
        return np.clip(np.einsum("kn,nk->n", odds, weights), -LIMIT, LIMIT)

    def cell(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower of two cells that the odds lie between, and the share of the upper one."""
        place = np.clip(odds / CELL_WIDTH + CELLS // 2, 0, CELLS - 1.001)
        low = place.astype(np.int64)
        return low, place - low

    def chance(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The probability of a 1: the mean, as odds, of the mixed one and its refinement."""
        low, share = self.cell(odds)
        table = self.cells[1] / self.cells[0]
        refined = np.clip(table[gate, low] * (1 - share) + table[gate, low + 1] * share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(odds + np.log(refined / (1 - refined))) / 2))

    def log10(self, units: list[tuple[int, bytes]]) -> np.ndarray:
        """The log10 probability of each unit's word with the space behind it."""
        out = np.zeros(len(units))
        for keys, owner in blocks(units):
            distinct, place = np.unique(keys, return_inverse=True)
            out += np.bincount(owner, self.log10_of(distinct)[place], len(units))
        return out

    def log10_of(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each key's byte after its context."""
        total = np.ones(len(keys))
        for start in range(0, len(keys), PIECE):
            part = keys[start : start + PIECE]
            base = self.contexts(part)
            for node, bit in bits(part):
                odds, gate = self.inputs(base, node)
                p = np.clip(self.chance(self.mixed(odds, gate, node), gate), 1e-6, 1 - 1e-6)
                total[start : start + PIECE] *= np.where(bit == 1, p, 1 - p)
        return np.log10(total)

    def learn(self, units: list[tuple[int, bytes]], mass: np.ndarray, cells: np.ndarray | None) -> None:
        """Online steps on the units. mass gets the occurrences by gate; cells, if given, the refinement's counts."""
        for keys, _ in blocks(units):
            self.learn_keys(*np.unique(keys, return_counts=True), mass, cells)

    def learn_keys(self, distinct: np.ndarray, weight: np.ndarray, mass: np.ndarray, cells: np.ndarray | None) -> None:
        """Online steps on distinct keys that occur so often."""
        order = np.random.default_rng(len(distinct)).permutation(len(distinct))
        for start in range(0, len(order), CHUNK):
            part = order[start : start + CHUNK]
            base, w = self.contexts(distinct[part]), weight[part]
            for node, bit in bits(distinct[part]):
                odds, gate = self.inputs(base, node, bit)
                mixed = self.mixed(odds, gate, node)
                pull = w * (bit - 1 / (1 + np.exp(-mixed)))
                both = np.concatenate([gate, GATES + node.astype(np.int64)])
                load = np.bincount(both, np.concatenate([w, w]), len(self.weights))
                step = np.stack([np.bincount(both, np.tile(pull * odds[k], 2), len(self.weights)) for k in range(len(ORDERS))], axis=1)
                step /= np.maximum(load, 1)[:, None]
                self.squares += step**2
                self.weights = self.weights + RATE * step / np.sqrt(self.squares)
                mass += load
                if cells is not None:
                    low, share = self.cell(mixed)
                    for at, part_of in ((low, 1 - share), (low + 1, share)):
                        index = gate * CELLS + at
                        cells[0] += np.bincount(index, w * part_of, GATES * CELLS).reshape(GATES, CELLS)
                        cells[1] += np.bincount(index, w * part_of * bit, GATES * CELLS).reshape(GATES, CELLS)


def gathered(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words, c, n) of Arrow batches, c and n by class, in lists of at least ``most`` bytes but for the last."""
    words, c, n, size = [], [], [], 0
    for batch in batches:
        words += batch.column("word").to_pylist()
        for name, parts in (("c", c), ("n", n)):
            parts.append(batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, CLASSES))
        size += batch.column("word").nbytes
        if size >= most:
            yield words, np.concatenate(c), np.concatenate(n)
            words, c, n, size = [], [], [], 0
    if words:
        yield words, np.concatenate(c), np.concatenate(n)


def units_of(words: list[bytes], counts: np.ndarray) -> list[tuple[int, bytes]]:
    """The (class, word) pairs that were counted, by word and class."""
    return [(k, words[i]) for i, k in zip(*(x.tolist() for x in np.nonzero(counts)), strict=True)]


def word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct keys, how often) of the distinct words by class in a table (word, c, n), in blocks."""
    for words, c, _ in gathered(batches):
        for keys, _ in blocks(units_of(words, c)):
            yield np.unique(keys, return_counts=True)


Read = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]


def packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def slot_counts(table: DataFrame, read: Read = word_keys, mixer: type[Mixer] = Mixer) -> tuple[np.ndarray, np.ndarray]:
    """How often the keys that ``read`` finds in a table's batches met each slot, and how often with a 1. Tasks pass on their counts by ranges of
    slots, which are added up in a shuffle; as many numbers as there are slots come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ones = np.zeros((2, -(-mixer.size // RANGE) * RANGE), np.int64)
        for distinct, weight in read(batches):
            for start in range(0, len(distinct), PIECE):
                part, load = distinct[start : start + PIECE], weight[start : start + PIECE]
                base = mixer.contexts(part)
                for node, bit in bits(part):
                    for row in mixer.places(base, node):
                        np.add.at(seen, row, load)
                        np.add.at(ones, row[bit == 1], load[bit == 1])
        seen, ones = seen.reshape(-1, RANGE), ones.reshape(-1, RANGE)
        for at in np.flatnonzero(seen.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(seen[at])]), pa.array([packed(ones[at])])], ["at", "seen", "ones"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, RANGE), np.int64)
        for batch in batches:
            for which, name in enumerate(("seen", "ones")):
                for part in batch.column(name):
                    total[which] += unpacked(part.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([packed(x.astype(np.float32))]) for x in total)], ["at", "seen", "ones"])

    form = "at int, seen binary, ones binary"
    total = table.mapInArrow(counted, form).groupBy("at").applyInArrow(added, form).toArrow()
    seen, ones = np.zeros((2, -(-mixer.size // RANGE), RANGE), np.float32)
    for at, *both in zip(*(total.column(x) for x in ("at", "seen", "ones")), strict=True):
        seen[at.as_py()], ones[at.as_py()] = (unpacked(x.as_py(), np.float32) for x in both)
    return seen.reshape(-1)[: mixer.size], ones.reshape(-1)[: mixer.size]


def train(table: DataFrame, rounds: int = ROUNDS, read: Read = word_keys, mixer: type[Mixer] = Mixer) -> Mixer:
    """The mixer of a table, (word, c, n) or what else ``read`` finds keys in. A round moves as many numbers a task as there are weights and cells."""
    context = table.sparkSession.sparkContext
    model = mixer(*slot_counts(table, read, mixer))
    counts = context.broadcast((packed(model.seen), packed(model.ones)))
    for number in range(rounds):
        now, last = model.weights, number == rounds - 1

        def steps(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, last: bool = last) -> Iterator[pa.RecordBatch]:
            own = mixer(*(unpacked(x, np.float32) for x in counts.value), weights=now)
            mass, cells = np.zeros(len(now)), np.zeros((2, GATES, CELLS)) if last else None
            for distinct, weight in read(batches):
                own.learn_keys(distinct, weight, mass, cells)
            load = np.repeat(mass, len(ORDERS))
            value = own.weights.reshape(-1) * load
            if last:
                value, load = np.concatenate([value, cells.reshape(-1)]), np.concatenate([load, np.ones(cells.size)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value)), pa.int32()), pa.array(value), pa.array(load)], ["at", "value", "load"])

        parts = table.mapInArrow(steps, "at int, value double, load double")
        rows = parts.groupBy("at").agg(F.sum("value").alias("value"), F.sum("load").alias("load")).collect()
        value, load = np.zeros((2, now.size + 2 * GATES * CELLS))
        for r in rows:
            value[r["at"]], load[r["at"]] = r["value"], r["load"]
        averaged = np.where(load[: now.size] > 0, value[: now.size] / np.maximum(load[: now.size], 1), now.reshape(-1)).reshape(now.shape)
        cells = model.cells + value[now.size :].reshape(model.cells.shape) if last else None
        model = mixer(model.seen, model.ones, averaged, cells)
    counts.destroy()
    return model


class Discount:
    """Absolute discounting from counts within the class to counts of all classes to the mixed bits."""

    def __init__(self, words: DataFrame):
        total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
        by_class = [F.array(*[f(F.col("c")[k]) for k in range(CLASSES)]) for f in (F.sum, lambda x: F.count_if(x > 0))]
        fields = [F.sum(total), F.count_if(total > 0), F.count_if(total == 1), F.count_if(total == 2), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))]
        row = words.agg(*[f.alias(f"f{i}") for i, f in enumerate([*fields, *by_class])]).first()
        self.learned, self.distinct, once, twice, self.everything = (int(x or 0) for x in row[:5])
        self.by_class, self.distinct_by_class = (np.array([int(x or 0) for x in r]) for r in row[5:])
        self.d = once / (once + 2 * twice) if once and twice else 0.5

    def log10(self, kind: np.ndarray, c: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """kind and c (counts by class) for units whose bits have a log10 probability."""
        spelt = 10.0**np.maximum(bits, -280)
        if not self.learned:
            return bits
        common = (np.maximum(c.sum(axis=1) - self.d, 0) + self.d * self.distinct * spelt) / self.learned
        size = np.maximum(self.by_class[kind], 1)
        own = (np.maximum(c[np.arange(len(kind)), kind] - self.d, 0) + self.d * self.distinct_by_class[kind] * common) / size
        rest = np.log10(np.where(self.by_class[kind] > 0, self.d * self.distinct_by_class[kind] / size, 1) * self.d * self.distinct / self.learned)
        return np.where(bits < -280, rest + bits, np.log10(np.where(self.by_class[kind] > 0, own, common)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score (the unigram model's), score (this model's log10
    probability), n_bytes (of the words, with a byte behind each) and bits_per_byte."""
    spark = docs.sparkSession
    bounded_batches(spark)
    classes = word_classes(docs, id_col, text_col)
    counted = materialize(word_counts(docs, id_col, text_col, classes))
    discount = Discount(counted)
    model = train(counted)
    shipped = spark.sparkContext.broadcast((model.seen, model.ones, model.weights, model.cells))
    floor = float(discount.learned + discount.distinct + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer(*shipped.value)
        for part, c, n in gathered(batches):
            word, kind = np.nonzero(n)
            lp = discount.log10(kind, c[word], own.log10(units_of(part, n)))
            columns = [pa.array([part[i] for i in word.tolist()], pa.binary()), pa.array(kind, pa.int32()), pa.array(c.sum(axis=1)[word]), pa.array(n[word, kind]), pa.array(lp)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "k", "c", "n", "lp"])

    units = materialize(counted.mapInArrow(scored, "word binary, k int, c long, n long, lp double"))
    shipped.destroy()
    frequent = units.where((F.col("n") >= max(share * discount.everything, 1)) & (F.octet_length("word") <= LONGEST_SHARED))  # at most 1 / share rows
    table = frequent.orderBy(F.desc("n"), "word", "k").select("word", "k", "c", "lp").toArrow()
    c, lp, kinds, words = (table.column(x).to_numpy() for x in ("c", "lp", "k", "word"))
    near, far = {}, {}  # the commonest words apart, in a table that stays in a processor's cache
    for word in words:
        if word not in near and word not in far:
            (near if len(near) < NEAR else far)[word] = len(near) + len(far)
    values = np.full((CLASSES, len(near) + len(far) + 1, 3), np.nan)  # NaN where a word of that class, or any in the last place, isn't here
    for kind, word, count, chance in zip(kinds.tolist(), words, c.tolist(), lp.tolist(), strict=True):
        values[kind, near.get(word, far.get(word))] = count > 0, np.log10((count + 1) / floor), chance
    known = spark.sparkContext.broadcast((near, far, values))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "n_tokens", "n_bytes", "n_known", "base_score", "score", "word", "k", "tf"]
        near, far, values = known.value
        for batch in batches:
            heads, row_of, rare_words, rare_kinds, rare_counts = [], [], [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                n = size = now = 0
                sums, rare = np.zeros(3), {}
                for words in chain(pieces(text.as_py()), [[END]]):
                    kinds, now = kinds_of(words, classes, now)
                    at = np.fromiter(map(near.get, words, repeat(-1)), np.int32, len(words))
                    missed = np.flatnonzero(at < 0)
                    at[missed] = np.fromiter(map(far.get, [words[i] for i in missed.tolist()], repeat(-1)), np.int32, len(missed))
                    found = values[kinds, at]
                    absent = np.isnan(found[:, 2])
                    n += len(words)
                    size += len(words) + sum(map(len, words))
                    sums += found[~absent].sum(axis=0)
                    for k in np.unique(kinds[absent]).tolist():
                        rare.setdefault(k, Counter()).update([words[i] for i in np.flatnonzero(absent & (kinds == k)).tolist()])
                heads.append((n, size, int(sums[0]), sums[1], sums[2]))
                for k, counts in rare.items():
                    row_of += [row] * len(counts)
                    rare_kinds += [k] * len(counts)
                    rare_words += counts.keys()
                    rare_counts += counts.values()
            h, m = len(heads), len(row_of)
            sums = [pa.array([x[i] for x in heads] + [None] * m, t) for i, t in enumerate([pa.int64()] * 3 + [pa.float64()] * 2)]
            ids = pa.concat_arrays([batch.column("id"), pa.nulls(m, batch.column("id").type)])
            rows = pa.concat_arrays([batch.column("row"), pa.array(row_of, pa.int64())])
            marks = [b"\xff%d" % row for row in batch.column("row").to_pylist()]  # no word of a text, and a key of its own for every row
            rare_columns = [pa.array(marks + rare_words, pa.binary()), pa.array([-1] * h + rare_kinds, pa.int32()), pa.array([None] * h + rare_counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([rows, ids, *sums, *rare_columns], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    sums = "n_tokens long, n_bytes long, n_known long, base_score double, score double"
    parts = rows.mapInArrow(looked_up, f"row long, id {id_type}, {sums}, word binary, k int, tf long")
    met = parts.join(units.select("word", "k", "c", "lp"), ["word", "k"], "left")
    tf, head = F.col("tf"), F.col("tf").isNull()
    added = {"n_known": F.when(F.col("c") > 0, tf).otherwise(0), "base_score": tf * F.log10((F.col("c") + 1) / F.lit(floor)), "score": tf * F.col("lp")}
    sums = [F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"), *[F.sum(F.when(head, F.col(c)).otherwise(x)).alias(c) for c, x in added.items()]]
    summed = met.groupBy("row").agg(F.max("id").alias("id"), *sums)
    return summed.select(
        F.col("id").alias(id_col),
        (remainder(F.col("id")) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(discount.learned).cast("long").alias("train_tokens"),
        "base_score",
        F.round("score", 6).alias("score"),
        "n_bytes",
        (-F.round("score", 6) * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
