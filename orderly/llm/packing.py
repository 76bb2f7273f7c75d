"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut; the first piece takes the rest).
The histogram of piece lengths has at most ``capacity`` entries whatever the corpus holds, so it is the one thing
that goes to the driver. There the configuration LP (fewest sequences whose patterns cover the histogram) is solved
by multiplicative weights: lengths that patterns cover too little gain weight, and an integer knapsack dynamic
program finds the pattern worth most under the weights. The averaged solution is rounded down to whole patterns and the
program solved again for the rest; the few pieces that no rounding takes are packed longest first, each sequence by a
bounded knapsack with the program's prices. The plan
says, for each length, which ranks of its pieces go to which run of sequences; pieces look their place up by rank.

Null texts count as empty, which is a document of the end token alone. Repeated rows are packed once each. An empty
table gives an empty result. Ranks are dealt over salted blocks of bounded size, so a length that a third of all pieces share is
numbered in parallel. Only the id and text columns are read; others may have any name.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.session import bounded_batches, materialize

CAPACITY = 1024
END_ID = 2
ROUNDS = 60
ETA = 0.3
TOLERANCE = 0.03
PATTERNS_A_ROUND = 400
RESOLVES = 6
ROUND_UP = 0.4
PRICE_SHARE = 0.6
BLOCK_ROWS = 65_536
RANK_BITS = 40

PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
)


class Encoder:
    """Ids of whole texts under a byte-level BPE tokenizer file. The merges run on the file's vocabulary as ranks,
    which gives the ids of the file's own tokenizer several times faster (the tests compare them)."""

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def encode_added(self, text: str) -> bytes:
        """encode, with added tokens inside the text as their single ids: what the tokenizer does by default."""
        return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones but for the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32."""

    @F.pandas_udf(PIECE)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for texts in batches:
            out = []
            for text in texts:
                ids = encoder.encode_added(text or "") + end
                out.append(
                    [
                        {"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + n)])}
                        for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))
                    ]
                )
            yield pd.Series(out)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.explode(encoded(F.col(text_col).cast("string"))).alias("p")).select(id_col, "p.*")


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity, the most that pieces in it can be worth and the piece to take first (-1:
    none): an unbounded integer knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fits[room]:
            worth = best[room - lengths[:k]] + value[:k]
            top = worth.argmax()
            if worth[top] > best[room] + 1e-15:
                best[room], pick[room] = worth[top], top
    return best, pick


def fractional(counts: dict[int, int], capacity: int, rounds: int, eta: float) -> tuple[list[tuple[dict[int, int], float]], dict[int, float]]:
    """Patterns with their fractional numbers of uses and the lengths' prices, by multiplicative weights over the covering rows. One knapsack
    prices the best pattern with each length in it; a round uses those within a few per cent of the best."""
    lengths = np.array(sorted(counts))
    need = np.array([counts[n] for n in lengths], float)
    price = lengths / capacity  # a piece's weight: at first the share of a sequence that it takes up
    used: dict[tuple, float] = {}
    covered = np.zeros(len(lengths))
    for _ in range(rounds):
        best, pick = knapsack(price, lengths, capacity)
        worth = price + best[capacity - lengths]
        gain = np.zeros(len(lengths))
        for first in np.argsort(-worth, kind="stable")[:PATTERNS_A_ROUND]:
            if worth[first] < (1 - TOLERANCE) * worth.max():
                break
            pattern, room = {int(first): 1}, capacity - int(lengths[first])
            while room > 0:
                if pick[room] < 0:
                    room -= 1
                else:
                    pattern[int(pick[room])] = pattern.get(int(pick[room]), 0) + 1
                    room -= int(lengths[pick[room]])
            index, times = np.array(list(pattern)), np.array(list(pattern.values()), float)
            step = float(((need[index] - gain[index]) / times).min()) / 4  # no row gains more than its need in a round
            if step > 0:
                key = tuple(sorted((int(lengths[i]), k) for i, k in pattern.items()))
                used[key] = used.get(key, 0.0) + step
                gain[index] += times * step
        covered += gain
        price = price * np.exp(-eta * gain / need)
        price *= (need @ (lengths / capacity)) / (need @ price)
    scale = 1 / max(1.0, float(np.median(covered / need)))
    return [(dict(k), v * scale) for k, v in used.items()], dict(zip(lengths.tolist(), (price * capacity / lengths).tolist(), strict=True))


def fills(left: dict[int, int], capacity: int, price: dict[int, float]) -> list[tuple[int, int, np.ndarray]]:
    """Steps of a bounded knapsack that fills every room as far as the pieces left allow, among equal fills with the
    longest and dearest pieces: (length, number taken at once, which rooms take the step). Numbers are powers of two, so that many equal
    lengths are few steps."""
    best = np.zeros(capacity + 1)
    steps = []
    for n in sorted(left):
        number, part = min(left[n], capacity // n), 1
        while number > 0:
            take = min(part, number)
            worth = best[: capacity + 1 - n * take] + take * n * (1 + PRICE_SHARE * n / capacity * price.get(n, 1.0))
            better = np.zeros(capacity + 1, bool)
            better[n * take :] = worth > best[n * take :] + 1e-12
            best[n * take :] = np.where(better[n * take :], worth, best[n * take :])
            steps.append((n, take, better))
            number -= take
            part *= 2
    return steps


def filling(steps: list[tuple[int, int, np.ndarray]], room: int) -> dict[int, int]:
    """The pieces that fill a room."""
    pattern: dict[int, int] = {}
    for n, take, better in reversed(steps):
        if better[room]:
            pattern[n] = pattern.get(n, 0) + take
            room -= n * take
    return pattern


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, eta: float = ETA) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole numbers of uses that hold every piece of the histogram exactly once. The linear program's
    full patterns are rounded down, and the program is solved again for what that leaves until rounding yields little;
    then its patterns are used once each, most used first, as far as the pieces last; the rest is filled by a knapsack
    that prefers the lengths that the program holds dear."""
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], most: float) -> int:
        times = int(min([most, *(left.get(n, 0) // k for n, k in pattern.items())]))
        if times > 0:
            out.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= k * times
                if not left[n]:
                    del left[n]
        return max(0, times)

    use({capacity: 1}, float("inf"))
    price: dict[int, float] = {}
    for _ in range(RESOLVES):
        if not left:
            break
        solution, price = fractional(left, capacity, rounds, eta)
        full = sorted(((p, x) for p, x in solution if sum(n * k for n, k in p.items()) == capacity), key=lambda s: (-s[1], sorted(s[0].items())))
        gained = sum(use(p, np.floor(x + 1e-9)) for p, x in full)
        if gained < 0.2 * sum(x for _, x in solution):
            for pattern, x in full:
                if x >= ROUND_UP:
                    use(pattern, 1)
            break
    while left:
        longest = max(left)
        steps = fills({n: c - (n == longest) for n, c in left.items()}, capacity, price)
        for n in sorted(left, reverse=True):
            if n in left:
                pattern = filling(steps, capacity - n)
                pattern[n] = pattern.get(n, 0) + 1
                if n == longest or sum(m * k for m, k in pattern.items()) == capacity:
                    use(pattern, float("inf"))  # not at all where others took the pieces
    return out


def placements(patterns: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each length, runs of ranks: from rank ``first_rank`` on, ``each`` pieces go to every sequence from
    ``first_sequence`` on, at ``offset`` and behind."""
    rows, sequence, ranks = [], 0, {}
    for pattern, times in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            each = pattern[n]
            rows.append((n, ranks.get(n, 0), each, sequence, offset))
            ranks[n] = ranks.get(n, 0) + each * times
            offset += n * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first_rank", "each", "first_sequence", "offset"])


def place(rows: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """rows (with a long column ``length``) plus sequence_id and offset, which replace columns of these names. Rows are
    ranked within their length in salted blocks of about ``block_rows``; the driver sees a number for each length."""
    spark = rows.sparkSession
    rows = rows.drop("sequence_id", "offset")
    counts = {int(r["length"]): int(r["count"]) for r in rows.groupBy("length").count().collect()}
    if not counts:
        return rows.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    runs = placements(plan(counts, capacity, rounds)).sort_values(["length", "first_rank"])
    starts = (runs["length"].to_numpy(np.int64) << RANK_BITS) + runs["first_rank"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((starts, runs[["first_rank", "each", "first_sequence", "offset"]].to_numpy(np.int64)))
    cut = spark.createDataFrame([(n, -(-c // block_rows)) for n, c in counts.items()], "n long, blocks long")
    # The rows stand in a struct, so that no name of theirs meets one of these; both tables have a row for each length at most.
    salted = rows.select(F.struct("*").alias("row"), F.col("length").alias("n")).join(F.broadcast(cut), "n")
    salted = salted.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    sizes = salted.groupBy("n", "block").count()
    sizes = sizes.select("n", "block", (F.sum("count").over(Window.partitionBy("n").orderBy("block")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("n", "block").orderBy("row")) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, runs = shared.value
        length, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        first, each, sequence, offset = runs[np.searchsorted(starts, (length << RANK_BITS) + rank, "right") - 1].T
        into = rank - first
        return pd.DataFrame({"sequence_id": sequence + into // each, "offset": offset + into % each * length})

    found = ranked.join(sizes, ["n", "block"]).withColumn("place", placed("n", F.col("rank") + F.col("before")))
    return found.select("row.*", "place.*")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: its place in a sequence of at most ``capacity`` tokens."""
    return place(materialize(pieces(docs, tokenizer_path, id_col, text_col, capacity)), capacity)
