"""Quality rules, line first.

Each line of a document meets three rules: punctuation (too many symbol and exclamation marks for its words),
navigation (a menu of short entries between bars) and boilerplate (a fixed notice phrase). Lines that fail are
removed, and a document that loses too much of its text this way is rejected, as are documents that fail the base
rule (too few words, or too many words in repeated eight-word windows).

Everything is a function of one text, so the operator is one pass without a shuffle: a hot source or a group of
copies costs no more than its rows. Null and empty texts have no words, fail the base rule and are rejected with all
counts 0. Rows that repeat are judged alike. An input column with the output's name is replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.session import bounded_batches

# Marks, and phrases of notices, matched in lower case.
SYMBOLS = b"#*$%&|<>"
MARKS = b"#*$%&|<>!"
BOILERPLATE = (
    b"all rights reserved",
    b"click here",
    b"cookie policy",
    b"is licensed under",
    b"licensed under the",
    b"licensed under cc",
    b"privacy policy",
    b"released under the",
    b"sign in to",
    b"subscribe to our",
    b"terms of service",
    b"terms of use",
)
SPACE = b" \t\n\v\f\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MAX_LOST_PCT = 60

SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ]
    + [T.StructField("base_failed", T.BooleanType())]
    + [T.StructField(name, T.LongType()) for name in ("n_lines", "n_failed_lines", "text_bytes", "lost_bytes")]
    + [T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())]
)


def line_fails(line: bytes, n_words: int) -> bool:
    """Whether a line with words breaks the navigation, punctuation or boilerplate rule."""
    bars = line.count(b"|")
    if bars >= 2 and n_words <= 4 * (bars + 1):
        return True
    if 2 * (len(line) - len(line.translate(None, MARKS))) > n_words:
        return True
    low = line.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found at least twice. Hashes only rule repeats out; where some collide, the
    windows are compared by exact ranks, doubled from pairs of words."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    rank: np.ndarray = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    step = 1
    while step < window:
        rank = pd.factorize(rank[:-step] * len(words) + rank[step:])[0].astype(np.int64)
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(text: str | None, max_lost_pct: int = MAX_LOST_PCT) -> tuple:
    """The output struct's values for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    blanks = len(data) - len(data.translate(None, SPACE))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    kept_lines = []
    n_lines = dup = failed = total = lost = 0
    for line in data.split(b"\n"):
        n = len(line.split())
        if not n:
            kept_lines.append(line)
            continue
        n_lines += 1
        total += len(line)
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, n):
            failed += 1
            lost += len(line)
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PCT * n_words
    kept = not base_failed and 100 * lost <= max_lost_pct * total
    clean = b"\n".join(kept_lines).decode("utf-8", "surrogatepass") if text is not None else None
    return (
        n_words,
        len(text or "") - blanks,
        n_symbols,
        dup,
        repeat,
        base_failed,
        n_lines,
        failed,
        total,
        lost,
        kept,
        clean,
    )


def annotate(docs: DataFrame, text_col: str = "text", out: str = "quality", max_lost_pct: int = MAX_LOST_PCT) -> DataFrame:
    """docs with a struct column ``out``: the counts, base_failed, kept and clean_text (the text without the lines
    that failed; null for a null text). Blank lines stay and count nowhere."""
    names = SCHEMA.fieldNames()
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SCHEMA)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(t, max_lost_pct) for t in texts], columns=names)

    return docs.withColumn(out, judged.asNondeterministic()(F.col(text_col).cast("string")))


def clean(docs: DataFrame, text_col: str = "text", max_lost_pct: int = MAX_LOST_PCT) -> DataFrame:
    """The documents that pass, with the columns of docs and the failing lines removed from the text."""
    mark = "__quality"
    kept = annotate(docs, text_col, mark, max_lost_pct).where(F.col(f"{mark}.kept"))
    return kept.withColumn(text_col, F.col(f"{mark}.clean_text")).select(*docs.columns)
