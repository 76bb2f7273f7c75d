"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, written in numpy.

Every word is described by word and character inputs: learned vectors of the hashed word and of the byte n-grams in it,
trained with the network, beside how much more often the word and its n-grams occur in toxic training documents
(cross-fitted, so that no training document speaks for its own words). The network reads overlapping windows over the
whole text, pools its states by attention and gives each window a logit; a document is scored by its highest window,
calibrated with the number of windows. Documents are bags: in training, the window that stands out carries the label.

The model is fitted on a bounded sample of labelled rows (``max_toxic`` and ``max_clean``, chosen by a hash of the id, of
texts of up to ``max_bytes``) by one task on an executor, and broadcast; its size depends on neither the corpus nor the labels. Scoring is a function of one text, so it takes
one pass without a shuffle. Sums are taken in one order and windows in blocks of one shape, so that a text's score doesn't
depend on what shares its batch: equal texts get equal scores. Null and empty texts, and texts without words, score 0;
so does everything where the sample lacks one of the two labels. Rows that repeat are scored alike; label rows with
null ids or labels are left out, and of several labels for an id the highest counts. Input columns other than id and text are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.session import bounded_batches

WINDOW = 48
STRIDE = 32
HIDDEN = 8
THRESHOLD = 0.3
MAX_TOXIC = 1500
MAX_CLEAN = 3000
MAX_BYTES = 32_768
FOLDS = 4
WORD_SLOTS = 1 << 17
GRAMS = ((3, 1 << 15), (5, 1 << 17))
STRIP = b".,;:!?\"'()[]{}*%$&#|<>-_"
SCALARS = 1 + 2 * len(GRAMS) + 1
VECTOR = 4
WORD_VECTORS = GRAM_VECTORS = 1 << 14
INPUTS = SCALARS + 2 * VECTOR
CACHE_WORDS = 100_000
WINDOW_BLOCK = 512
CALIBRATION = 5  # one document in so many of the sample calibrates the scores and trains nothing else,
FEW = 20  # unless fewer of them than this are toxic: then all train and all calibrate
BATCH, STEPS = (8, 128), 20  # documents a step: least and most; steps an epoch at least


def words_of(text: str | None) -> list[bytes]:
    return [w.strip(STRIP) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]


def slots_of(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The slot of each word, and for each n-gram size the slots of all grams with the position where each word's begin."""
    word = np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64) % WORD_SLOTS
    grams = []
    for size, slots in GRAMS:
        marked = [(b"^" + w + b"$").ljust(size, b"$") for w in words]
        data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        lengths = np.array([len(m) for m in marked], np.int64)
        mixed = np.zeros(len(data) - size + 1, np.uint64)
        for k in range(size):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + data[k : k + len(mixed)] + np.uint64(k + 1)
        ends = np.cumsum(lengths)
        inside = np.ones(len(data), bool)
        for k in range(1, size):
            inside[ends - k] = False
        counts = lengths - size + 1
        grams.append(((mixed >> np.uint64(40)).astype(np.int64)[inside[: len(mixed)]] % slots, np.cumsum(counts) - counts))
    return word, grams


@dataclass
class Odds:
    """Log odds of toxicity by word slot and by gram slot."""

    word: np.ndarray
    grams: list[np.ndarray]

    def scalars(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), SCALARS), np.float32)
        if not words:
            return out
        word, grams = slots_of(words)
        out[:, 0] = self.word[word]
        for k, (slot, begin) in enumerate(grams):
            values = self.grams[k][slot]
            out[:, 1 + 2 * k] = np.maximum.reduceat(values, begin)
            out[:, 2 + 2 * k] = np.add.reduceat(values, begin) / np.diff(np.append(begin, len(values)))
        out[:, -1] = 1
        return out


class Presence:
    """In how many documents of either label each slot occurs."""

    def __init__(self) -> None:
        self.docs = np.zeros(2)
        self.tables = [np.zeros((2, n), np.float32) for n in (WORD_SLOTS, *(s for _, s in GRAMS))]

    def add(self, words: list[bytes], label: int) -> None:
        """Count a document of these words."""
        self.docs[label] += 1
        if words:
            word, grams = slots_of(words)
            for table, slots in zip(self.tables, [word, *(s for s, _ in grams)], strict=True):
                table[label, np.unique(slots)] += 1

    def plus(self, other: Presence) -> Presence:
        out = Presence()
        out.docs = self.docs + other.docs
        out.tables = [a + b for a, b in zip(self.tables, other.tables, strict=True)]
        return out

    def odds(self) -> Odds:
        def log_odds(table: np.ndarray) -> np.ndarray:
            share = (table + 1) / (self.docs[:, None] + 2)
            base = 1 / (self.docs + 2)
            return (np.log(share[1] / share[0]) - np.log(base[1] / base[0])).astype(np.float32)

        word, *grams = map(log_odds, self.tables)
        return Odds(word, grams)


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over n words: they overlap, and the last reaches the end."""
    return np.arange(1 + max(0, -(-(n - WINDOW) // STRIDE))) * STRIDE


def windows_of(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words laid end to end: the word positions of every window (-1 beyond a text's end), and the
    text of every window. Texts without words have none."""
    places, owners, at = [], [], 0
    for doc, n in enumerate(lengths):
        if n:
            grid = window_starts(n)[:, None] + np.arange(WINDOW)
            places.append(np.where(grid < n, grid + at, -1).astype(np.int32))
            owners.append(np.full(len(grid), doc, np.int32))
        at += n
    if not places:
        return np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(owners)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Slots:
    """Rows of the vector tables for a list of words: one word vector each, and the grams' with the place where each word's begin."""

    word: np.ndarray
    gram: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(words: list[bytes]) -> Slots:
        word, grams = slots_of(words)
        slot, begin = grams[-1]
        return Slots(word % WORD_VECTORS, slot % GRAM_VECTORS, begin)

    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.begin, len(self.gram)))

    def pick(self, rows: np.ndarray) -> Slots:
        counts = self.counts()[rows]
        begin = np.cumsum(counts) - counts
        at = np.repeat(self.begin[rows] - begin, counts) + np.arange(counts.sum())
        return Slots(self.word[rows], self.gram[at], begin)


def times(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """rows @ table, every sum in the same order, so that a row's result doesn't depend on the rows beside it (a matrix
    product may order its sums by place and shape)."""
    return np.einsum("nh,hk->nk", rows, table)


class Network:
    """Word and gram vectors, two gated recurrent layers (forward, backward), attention over their states, one logit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {
            "x": rng.normal(0, 0.3, (2, INPUTS, 3 * h)).astype(np.float32),
            "u": rng.normal(0, 0.3, (2, h, 3 * h)).astype(np.float32),
            "v": rng.normal(0, 0.3, 2 * h).astype(np.float32),
            "o": rng.normal(0, 0.3, 2 * h).astype(np.float32),
            "b": np.zeros(1, np.float32),
        }
        self.words = rng.normal(0, 0.1, (WORD_VECTORS, VECTOR)).astype(np.float32)
        self.grams = rng.normal(0, 0.1, (GRAM_VECTORS, VECTOR)).astype(np.float32)

    def inputs(self, scalars: np.ndarray, slots: Slots) -> np.ndarray:
        """Inputs of words: the scalars, the word's vector and the mean of its grams' vectors."""
        if not len(scalars):
            return np.zeros((0, INPUTS), np.float32)
        mean = np.add.reduceat(self.grams[slots.gram], slots.begin) / slots.counts()[:, None].astype(np.float32)
        return np.concatenate([scalars, self.words[slots.word], mean], 1)

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """The gates' shares of inputs, for both directions: (2, words, 3 hidden)."""
        return np.stack([times(inputs, self.w["x"][d]) for d in (0, 1)])

    def forward(self, gates: np.ndarray, places: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: gates has a last row of zeros for the places beyond a text's end."""
        n, steps, h = len(places), places.shape[1], HIDDEN
        states = np.zeros((steps, n, 2 * h), np.float32)
        for d in (0, 1):
            state = np.zeros((n, h), np.float32)
            u = self.w["u"][d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = gates[d][places[:, t]]
                r = times(state, u)
                zr = sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                z, reset, inner = zr[:, :h], zr[:, h:], r[:, 2 * h :]
                c = np.tanh(g[:, 2 * h :] + reset * inner)
                if keep is not None:
                    keep.append((d, t, state, z, reset, inner, c))
                state = state + z * (c - state)
                states[t, :, d * h : (d + 1) * h] = state
        score = np.where(places.T >= 0, (states * self.w["v"]).sum(2), -1e9)
        share = np.exp(score - score.max(0))
        share /= share.sum(0)
        pooled = share[0][:, None] * states[0]
        for t in range(1, steps):
            pooled += share[t][:, None] * states[t]
        if keep is not None:
            keep.append((states, share, pooled))
        return (pooled * self.w["o"]).sum(1) + self.w["b"][0]

    def logits(self, gates: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Logits of windows in blocks of one shape, the last filled up with empty windows."""
        out = np.empty(len(places), np.float32)
        for k in range(0, len(places), WINDOW_BLOCK):
            part = places[k : k + WINDOW_BLOCK]
            full = np.full((WINDOW_BLOCK, places.shape[1]), -1, places.dtype)
            full[: len(part)] = part
            out[k : k + len(part)] = self.forward(gates, full)[: len(part)]
        return out

    def gradients(self, inputs: np.ndarray, places: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the inputs."""
        keep: list = []
        h = HIDDEN
        logit = self.forward(np.concatenate([self.project(inputs), np.zeros((2, 1, 3 * h), np.float32)], 1), places, keep)
        states, share, pooled = keep.pop()
        g = ((sigmoid(logit) - labels) * weights / len(labels)).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["o"], grad["b"][0] = g @ pooled, g.sum()
        d_pool = g[:, None] * self.w["o"]
        d_share = np.einsum("nh,tnh->tn", d_pool, states)
        d_score = share * (d_share - (share * d_share).sum(0))
        grad["v"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = share[:, :, None] * d_pool + d_score[:, :, None] * self.w["v"]
        padded = np.concatenate([inputs, np.zeros((1, INPUTS), np.float32)])
        d_gates = np.zeros((2, len(padded), 3 * h), padded.dtype)
        for d in (1, 0):
            carried = np.zeros((len(labels), h), np.float32)
            for dd, t, state, z, reset, inner, c in reversed(keep):
                if dd != d:
                    continue
                ds = carried + d_states[t, :, d * h : (d + 1) * h]
                dz = ds * (c - state) * z * (1 - z)
                dc = ds * z * (1 - c * c)
                dr = dc * inner * reset * (1 - reset)
                from_input = np.concatenate([dz, dr, dc], 1)
                from_state = np.concatenate([dz, dr, dc * reset], 1)
                np.add.at(d_gates[d], places[:, t], from_input)
                grad["u"][d] += state.T @ from_state
                carried = ds * (1 - z) + from_state @ self.w["u"][d].T
        d_gates[:, -1] = 0  # beyond a text's end nothing is read
        for d in (0, 1):
            grad["x"][d] = padded.T @ d_gates[d]
        return grad, sum(d_gates[d, :-1] @ self.w["x"][d].T for d in (0, 1))


@dataclass
class Model:
    odds: Odds
    network: Network
    calibration: np.ndarray  # weights of the highest logit, the log number of windows, and 1

    def gates(self, words: list[bytes]) -> np.ndarray:
        """The gates of words: (2, words, 3 hidden)."""
        return self.network.project(self.network.inputs(self.odds.scalars(words), Slots.of(words)))

    def score(self, texts: list[str | None], memory: Memory | None = None) -> np.ndarray:
        """Scores of whole texts. memory holds the gates of words seen before."""
        memory = memory or Memory()
        docs = [words_of(t) for t in texts]
        known = memory.number
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list({w for ws in docs for w in ws if w not in known})
        memory.add(new, self.gates(new) if new else None)
        ids = np.fromiter((known[w] for ws in docs for w in ws), np.int64, sum(map(len, docs)))
        places, owner = windows_of([len(ws) for ws in docs])
        if not len(places):
            return np.zeros(len(texts))
        ids = np.append(ids, -1)  # the row of zeros
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, self.network.logits(memory.gates, ids[places]))
        many = np.log1p(np.bincount(owner, minlength=len(texts)))
        found = np.isfinite(top)
        a, b, c = self.calibration
        return np.where(found, np.round(sigmoid(a * np.where(found, top, 0) + b * many + c), 6), 0.0)


class Memory:
    """Gates of words by number, in a table that grows by doubling and whose last row is zero."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.gates = np.zeros((2, 1, 3 * HIDDEN), np.float32)

    def add(self, words: list[bytes], gates: np.ndarray | None) -> None:
        start = len(self.number)
        if start + len(words) + 1 > self.gates.shape[1]:
            wider = np.zeros((2, 2 * (start + len(words)) + 1, 3 * HIDDEN), np.float32)
            wider[:, :start] = self.gates[:, :start]
            self.gates = wider
        for k, w in enumerate(words):
            self.number[w] = start + k
        if gates is not None:
            self.gates[:, start : start + len(words)] = gates


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + weight * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - weight * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], labels: list[int], epochs: int = 12, batch: int | None = None, seed: int = 7, vectors: bool = True, recurrent: bool = True) -> Model | None:
    """A model from labelled texts, or None where a label is missing. Without ``vectors`` words have no learned inputs;
    without ``recurrent`` the network keeps its first weights and only the calibration is fitted (both for comparison)."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    lexicon = list(number)
    if not lexicon:
        return None
    slots = Slots.of(lexicon)
    parts = [Presence() for _ in range(FOLDS)]
    for k, (ws, label) in enumerate(zip(ids, labels, strict=True)):
        parts[k % FOLDS].add([lexicon[i] for i in np.unique(ws)], int(label))
    whole = Presence()
    for part in parts:
        whole = whole.plus(part)
    known = np.empty((FOLDS, len(lexicon), SCALARS), np.float32)
    for fold in range(FOLDS):
        rest = Presence()
        for k, part in enumerate(parts):
            if k != fold:
                rest = rest.plus(part)
        odds = rest.odds()
        for k in range(0, len(lexicon), 20_000):
            known[fold, k : k + 20_000] = odds.scalars(lexicon[k : k + 20_000])
    known = known.reshape(-1, SCALARS)  # a row for each word as a document of either fold sees it
    flat = np.concatenate([ws + np.int32(k % FOLDS * len(lexicon)) for k, ws in enumerate(ids)] + [np.array([-1], np.int32)])
    places, owner = windows_of([len(ws) for ws in ids])
    del lexicon, ids, parts
    rows = flat[places]  # -1 beyond a text's end
    del places, flat
    network, rng = Network(seed), np.random.default_rng(seed)
    if not vectors:
        network.words[:] = network.grams[:] = 0
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.unique(owner))
    kinds = y[owner[order][first]]
    weights = np.where(kinds == 1, len(kinds) / (2 * max(1, (kinds == 1).sum())), len(kinds) / (2 * max(1, (kinds == 0).sum())))
    strong = np.append(known[:, 0] + known[:, 3], 0)
    logit = np.concatenate([strong[rows[k : k + 4096]].max(1) for k in range(0, len(rows), 4096)])

    def inputs_of(used: np.ndarray) -> tuple[np.ndarray, Slots]:
        picked = slots.pick(used % len(slots.word))
        return network.inputs(known[used], picked), picked

    def all_logits() -> np.ndarray:
        out = []
        for k in range(0, len(rows), 2048):
            part = rows[k : k + 2048]
            used = np.unique(part[part >= 0])
            gates = np.concatenate([network.project(inputs_of(used)[0]), np.zeros((2, 1, 3 * HIDDEN), np.float32)], 1)
            out.append(network.logits(gates, np.where(part >= 0, np.searchsorted(used, part), -1)))
        return np.concatenate(out)

    apart = np.arange(len(kinds)) % CALIBRATION == CALIBRATION - 1
    few = kinds[apart].sum() < FEW or (kinds[apart] == 0).sum() < FEW
    learn = np.flatnonzero(~apart | few)  # the others calibrate
    batch = batch or min(BATCH[1], max(BATCH[0], len(kinds) // STEPS))
    mean, var = ({k: np.zeros_like(v) for k, v in network.w.items()} for _ in range(2))
    squares = {"words": np.full(WORD_VECTORS, 1e-6, np.float32), "grams": np.full(GRAM_VECTORS, 1e-6, np.float32)}
    step = 0
    for epoch in range(epochs if recurrent else 0):
        if epoch and epoch % 3 == 0:
            logit = all_logits()
        best = np.lexsort((-logit, owner))[first]  # the window that stands out in each document
        mixed = rng.permutation(learn)
        for k in range(0, len(mixed), batch):
            pick = mixed[k : k + batch]
            part = rows[best[pick]]
            used = np.unique(part[part >= 0])
            values, picked = inputs_of(used)
            drop = (rng.random(len(used)) < 0.5).astype(np.float32)[:, None] * 2  # words without their vectors, by turns
            values[:, SCALARS:] *= drop
            grad, d_inputs = network.gradients(values, np.where(part >= 0, np.searchsorted(used, part), -1), kinds[pick], weights[pick])
            step += 1
            rate = 0.01 / (1 + 0.1 * epoch)
            for name, value in grad.items():
                mean[name] = 0.9 * mean[name] + 0.1 * value
                var[name] = 0.99 * var[name] + 0.01 * value**2
                network.w[name] -= rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(var[name] / (1 - 0.99**step)) + 1e-7)
            if vectors:
                d_inputs[:, SCALARS:] *= drop
                counts = picked.counts()
                of_gram = np.repeat(d_inputs[:, SCALARS + VECTOR :] / counts[:, None], counts, axis=0)
                for name, slot, value in (("words", picked.word, d_inputs[:, SCALARS : SCALARS + VECTOR]), ("grams", picked.gram, of_gram)):
                    total = np.zeros((len(squares[name]), VECTOR), np.float32)
                    np.add.at(total, slot, value)
                    squares[name] += (total**2).mean(1)
                    table = getattr(network, name)
                    table -= 0.02 * total / np.sqrt(squares[name])[:, None]
    logit = all_logits()
    top = np.maximum.reduceat(logit[order], first)
    many = np.log1p(np.diff(np.append(first, len(order))))
    apart = np.flatnonzero(apart | few)
    calibration = logistic(np.stack([top, many, np.ones(len(top))], 1)[apart], kinds[apart], 1.0)
    return Model(whole.odds(), network, calibration)


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """id, text and label of at most so many rows of either kind, by the order of a hash of the id, without those held
    out and without texts of over ``max_bytes``. docs: id, text; labels: id, toxic."""
    docs = docs.where(F.octet_length("text") <= max_bytes)
    known = labels.where("id IS NOT NULL AND toxic IS NOT NULL").where(remainder(F.col("id")) != 2)
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = []
    for kind, most in ((1, max_toxic), (0, max_clean)):
        part = known.where(F.col("toxic") == kind).join(docs.select("id").distinct(), "id")
        chosen.append(part.orderBy(F.xxhash64("id"), "id").limit(most))
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by the two limits
    return docs.join(picked, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))


def trained(rows: DataFrame) -> Model | None:
    """The model fitted to a bounded sample (id, text, toxic). Fitting is one task on an executor: the driver sees neither
    texts nor inputs, only the model, and a lost executor costs one more run of it with the same outcome."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            known = pd.concat(parts).sort_values(["h", "id"])
            model = fit(known["text"].tolist(), known["toxic"].astype(int).tolist())
            if model is not None:
                yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = rows.withColumn("h", F.xxhash64("id")).repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    out: str = "toxicity",
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """docs with a double column ``out`` (0 to 1, higher: likelier toxic)."""
    bounded_batches(docs.sparkSession)
    model = trained(
        sample(
            docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
            labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")),
            max_toxic,
            max_clean,
            max_bytes,
        )
    )
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, memory = shared.value, Memory()
        for texts in batches:
            values, found, at = texts.tolist(), [], 0
            while at < len(values):
                to, size = at, 0
                while to < len(values) and (to == at or size < 1_500_000):
                    size += len(values[to] or "")
                    to += 1
                found.append(model.score(values[at:to], memory))
                at = to
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(out, scored.asNondeterministic()(F.col(text_col).cast("string")))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with the columns of docs."""
    mark = "__toxicity"
    return score(docs, labels, id_col, text_col, out=mark).where(F.col(mark) < threshold).select(*docs.columns)
