"""Conversation structure repair by scalar big-integer weights.

A repaired conversation is empty, or an optional system turn followed by user and assistant turns in pairs. Every row is
kept, given another role, or deleted, and empty turns may be inserted; the cheapest edits are wanted and, among those, the
audit (the edits' initials in order) that is least in ASCII. One Python integer holds both: its high digits are the cost, and
below them stands a digit for each place of the audit, first place highest, in a fixed number of places with zeros behind the last
letter. Putting an edit in front of a weight adds its cost to the high digits, moves the letters one place down and writes
the letter into the first place. So the shortest path through the acyclic graph of (row, state of the grammar) under
plain integer minimum, from the last row back to the first, decides cost, edits and ties at once; no pointers back are kept.

Order and faults. Rows of a conversation are ordered by turn (nulls first), role and text; equal rows are interchangeable. Null roles
and texts are one space, so a null text is blank and a null role can't be kept. The first fault of a row counts:
blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (the last character that is not white
space is not one of . ! ?). A null conv_id is a conversation of its own; turns that repeat are separate rows. Columns other than
the four are ignored. An empty table gives no rows; a conversation whose rows are all marked as dropped has zeros and an empty audit.

Scale. Rows meet by conversation in sorted partitions that Spark spills; a task keeps a byte for each row of the one conversation it is at, and its
texts are read as a stream. Time is in proportion to the rows, times the length of the audit over the bits of a machine word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderly.session import bounded_batches, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
BITS = 3
DIGIT = {letter: 1 + i for i, letter in enumerate(sorted(COSTS))}
LETTER = {digit: letter for letter, digit in DIGIT.items()}

START, SYSTEM, USER, DONE = range(4)
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", DONE: "user"}

INITIALS = "-sua"
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
DROPPED = -1
SPACE = "[\\x20\\x09-\\x0D]"
MOST = 2**63 - 1


def row_code(initial: str, fault: int) -> int:
    return 4 * INITIALS.index(initial) + fault


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows given as codes; of equal cost, the audit least in ASCII."""
    places = 3 * len(codes) + 2  # an edit a row, and two insertions before, between and after them
    low_bits = BITS * places
    low = (1 << low_bits) - 1
    first = low_bits - BITS
    never = 1 << (low_bits + 64)

    def then(cost: int, letter: str, rest: int) -> int:
        return (((rest >> low_bits) + cost) << low_bits) | (DIGIT[letter] << first) | ((rest & low) >> BITS)

    def with_insertions(best: list[int]) -> list[int]:
        once = best
        for _ in range(2):  # a third one in a row leads back to a state it came from
            once = [min(best[q], then(COSTS[INSERT], INSERT, once[FOLLOWS[q, NEXT_ROLE[q][0]]])) for q in range(4)]
        return once

    ends = with_insertions([0, never, never, 0])
    for code in reversed(codes):
        initial, fault = INITIALS[code >> 2], code & 3
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        best = []
        for q in range(4):
            ways = [then(COSTS[DELETE], DELETE, ends[q])]
            if fault not in (BLANK, DUPLICATE):
                ways.append(then(COSTS[REROLE] + extra, REROLE, ends[FOLLOWS[q, NEXT_ROLE[q][0]]]))
                if (q, initial) in FOLLOWS:
                    ways.append(then(COSTS[KEEP] + extra, KEEP, ends[FOLLOWS[q, initial]]))
            best.append(min(ways))
        ends = with_insertions(best)
    letters, rest = [], ends[START] & low
    while rest:
        letters.append(LETTER[rest >> first])
        rest = (rest << BITS) & low
    return ends[START] >> low_bits, "".join(letters)


@lru_cache(maxsize=50_000)
def cheapest_short(codes: bytes) -> tuple[int, str]:
    return cheapest(codes)


class Replay:
    """The turns that an audit makes of a conversation's rows, one edit at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _turn(self, role: str, text: str) -> tuple[str, str]:
        self.state = FOLLOWS[self.state, role[0]]
        return role, text

    def insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield self._turn(NEXT_ROLE[self.state], "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The turns up to and with this row's own, if it stays."""
        yield from self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter != DELETE:
            yield self._turn(role if letter == KEEP else NEXT_ROLE[self.state], text)


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped) with code, in partitions by conversation."""
    last = F.regexp_extract("text", f"([^\\x20\\x09-\\x0D]){SPACE}*\\z", 1)
    copies = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(last == "", BLANK).when(F.row_number().over(copies) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    head = F.left("role", F.lit(1))
    initial = F.when(head == "s", 1).when(head == "u", 2).when(head == "a", 3).otherwise(0)
    return rows.repartition("conv_id").withColumn("code", F.when(F.col("dropped"), DROPPED).otherwise(4 * initial + fault).cast("int"))


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(a, b) for a, b in ("su", "ua", "au")}


def plan_row(codes: bytes, turns: np.ndarray) -> tuple:
    """What PLAN has behind conv_id, from a conversation's codes and its turns (ascending, without nulls)."""
    kinds = np.frombuffer(codes, np.uint8) & 3
    heads = [INITIALS[c >> 2] for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(heads, heads[1:], strict=False))
    gaps = 0
    if len(turns):
        gaps = int(turns[-1]) - int(turns[0]) + 1 - int(1 + np.count_nonzero(np.diff(turns)))
    cost, audit = cheapest_short(codes) if len(codes) <= 64 else cheapest(codes)
    return (min(gaps, MOST), *[int(np.count_nonzero(kinds == k)) for k in (BLANK, DUPLICATE, TRUNCATED)], illegal, cost, audit)


def runs(keys: pa.Array) -> Iterator[tuple[int | None, int, int]]:
    """(key, from, to) of the runs of equal keys."""
    nulls = np.asarray(keys.is_null())
    values = keys.fill_null(0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(values) != 0) | (nulls[1:] != nulls[:-1])) + 1
    edges = [0, *cuts.tolist(), len(values)]
    for start, end in zip(edges, edges[1:], strict=False):
        if end > start:
            yield (None if nulls[start] else int(values[start])), start, end


def plan_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of PLAN for each conversation, from sorted (conv_id, turn, code)."""
    names = [field.split()[0] for field in PLAN.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names])
    key, codes, turns, begun = None, [], [], False

    def planned() -> tuple:
        return (key, *plan_row(b"".join(codes), np.concatenate(turns) if turns else np.zeros(0, np.int64)))

    for batch in batches:
        out = []
        code = batch.column("code").to_numpy(zero_copy_only=False)
        turn = batch.column("turn")
        known = ~np.asarray(turn.is_null())
        turn = turn.fill_null(0).to_numpy(zero_copy_only=False)
        for k, start, end in runs(batch.column("conv_id")):
            if not begun or k != key:
                if begun:
                    out.append(planned())
                key, codes, turns, begun = k, [], [], True
            there = code[start:end] != DROPPED
            codes.append(code[start:end][there].astype(np.uint8).tobytes())
            numbered = turn[start:end][there & known[start:end]]
            turns.append(numbered[np.r_[True, np.diff(numbered) != 0]] if len(numbered) else numbered)
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema)
    if begun:
        yield pa.RecordBatch.from_pylist([dict(zip(names, planned(), strict=True))], schema)


def in_order(rows: DataFrame, first: str, *last: str) -> DataFrame:
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), first, F.asc_nulls_first("turn"), "role", "text", *last)


def plan(rows: DataFrame) -> DataFrame:
    """One row of PLAN for each conversation of rows (conv_id, turn, role, text, dropped). Of equal rows, the duplicates come last."""
    coded = in_order(faults(rows), "dropped", "code").select("conv_id", "turn", "code")
    return coded.mapInArrow(plan_conversations, PLAN)


def replayed(rows: DataFrame, plans: DataFrame, made: Callable[[str], object], add: Callable[[object, str, str], list[dict]], end: Callable[[object, dict], list[dict]], schema: str) -> DataFrame:
    """Streams each conversation's plan and then its rows through a fold: made(audit) starts it, add(state, role, text) takes a repaired
    turn and end(state, plan) closes the conversation; what add and end return are rows of the result."""
    fields = [F.col(c) for c in plans.columns if c != "conv_id"]
    heads = plans.select("conv_id", F.lit(False).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*fields).alias("plan"))
    texts = rows.where(~F.col("dropped")).select("conv_id", F.lit(True).alias("row"), "turn", "role", "text", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    target = rows.sparkSession.createDataFrame([], schema).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        head = replay = state = None

        def closed() -> list[dict]:
            out = [r for role, text in replay.insertions() for r in add(state, role, text)]
            return [{"conv_id": head["conv_id"], **r} for r in [*out, *end(state, head["plan"])]]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not row["row"]:
                    out += closed() if head else []
                    head, replay, state = row, Replay(row["plan"]["audit"]), made(row["plan"]["audit"])
                else:
                    out += [{"conv_id": head["conv_id"], **r} for turn in replay.row(row["role"], row["text"]) for r in add(state, *turn)]
            yield pa.RecordBatch.from_pylist(out, arrow)
        if head:
            yield pa.RecordBatch.from_pylist(closed(), arrow)

    both = heads.unionByName(texts).repartition("conv_id")
    return in_order(both, "row").mapInArrow(fold, target)


def clean_rows(rows: DataFrame, dropped: Column | None = None) -> DataFrame:
    """The columns that planning reads, nulls as one space."""
    space = F.lit(" ")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.lit(False) if dropped is None else dropped).alias("dropped"),
    )


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position (from 0), role, text."""
    bounded_batches(conversations.sparkSession)
    rows = clean_rows(conversations)
    plans = materialize(plan(rows).select("conv_id", "audit"))

    def add(count: list[int], role: str, text: str) -> list[dict]:
        count[0] += 1
        return [{"position": count[0] - 1, "role": role, "text": text}]

    return replayed(rows, plans, lambda audit: [0], add, lambda count, planned: [], "conv_id long, position long, role string, text string")


def audit(rows: DataFrame) -> DataFrame:
    """PLAN with repaired_sha256, the digest of the repaired turns as ``role:text`` lines, for rows as clean_rows() gives them."""
    bounded_batches(rows.sparkSession)
    plans = materialize(plan(rows))

    def add(state: list, role: str, text: str) -> list[dict]:
        state[0].update(f"{state[1]}{role}:{text}".encode())
        state[1] = "\n"
        return []

    def end(state: list, planned: dict) -> list[dict]:
        return [{**planned, "repaired_sha256": state[0].hexdigest()}]

    return replayed(rows, plans, lambda audit: [hashlib.sha256(), ""], add, end, PLAN + ", repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(`conv_id:turn`) % 20: 0 drops a row (it stays as a mark that the conversation was there), 1 empties its text, 2 removes the
    text's . ! and ?, 3 repeats the row, 4 sets its role to user. Nulls are one space, in the key too."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    rows = clean_rows(conversations, kind == 0).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")
