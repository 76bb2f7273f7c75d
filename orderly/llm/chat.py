"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as ``<s>[`` level role ``]`` text ``</s>``. The rendering is parsed back by a
deterministic grammar (split at ``</s>``, then one header, then a text without ``<s>``), and the turns recovered are
compared with the source. Where they differ, the conversation is rendered at the next level: 0 leaves texts as they
are, 1 escapes the control strings and the escape character in texts, 2 also writes roles in hexadecimal. Level 2 can
always be read back. The loss mask is a list of spans of the rendered string, one for each text of an assistant.

DataFrame functions only. Conversations are grouped by their id, as each becomes one string; rows with a null id form one
conversation. Turns are ordered by turn, role and text, null turns first; null roles and texts count as empty, and
repeated rows are turns of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
HEADER = r"(?s)^<s>\[([012])([^\]]*)\](.*)$"
LEVELS = (0, 1, 2)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit(CLOSE), F.lit("<\\/s>")), F.lit(OPEN), F.lit("<\\s>"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("<\\s>"), F.lit(OPEN)), F.lit("<\\/s>"), F.lit(CLOSE))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def render(turns: Column, level: int) -> Column:
    """The string of an array of (role, text)."""

    def one(turn: Column) -> Column:
        role = F.lower(F.hex(F.encode(turn["role"], "UTF-8"))) if level == 2 else turn["role"]
        text = escape(turn["text"]) if level else turn["text"]
        return F.concat(F.lit(f"{OPEN}[{level}"), role, F.lit("]"), text, F.lit(CLOSE))

    return F.array_join(F.transform(turns, one), "")


def chunks(formatted: Column) -> Column:
    """What stands before each ``</s>``; the empty rest behind the last one is left out."""
    parts = F.split(formatted, CLOSE, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """The turns of a rendered string as an array of (role, text); null texts where the grammar is broken."""

    def one(chunk: Column) -> Column:
        level = F.regexp_extract(chunk, HEADER, 1)
        role = F.regexp_extract(chunk, HEADER, 2)
        text = F.regexp_extract(chunk, HEADER, 3)
        known = (level != "") & ~F.contains(text, F.lit(OPEN))
        return F.struct(
            F.when(level == "2", F.decode(F.unhex(role), "UTF-8")).otherwise(role).alias("role"),
            F.when(known, F.when(level == "0", text).otherwise(unescape(text))).alias("text"),
        )

    return F.transform(chunks(formatted), one)


def loss_spans(formatted: Column) -> Column:
    """(start, length), in code points from 1, of the texts of assistants in a rendered string."""

    def step(state: Column, chunk: Column) -> Column:
        text = F.length(F.regexp_extract(chunk, HEADER, 3))
        role = F.concat(F.regexp_extract(chunk, HEADER, 1), F.regexp_extract(chunk, HEADER, 2))
        span = F.array(F.struct((state["at"] + F.length(chunk) - text).alias("start"), text.alias("length")))
        masked = role.isin("0assistant", "1assistant", "2" + b"assistant".hex())
        return F.struct(
            (state["at"] + F.length(chunk) + len(CLOSE)).alias("at"),
            F.when(masked, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(chunks(formatted), start, step, lambda state: state["spans"])


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    raw = F.regexp_extract(formatted, HEADER, 1) == "0"  # a conversation has one level
    pieces = F.transform(spans, lambda s: F.substring(formatted, s["start"], s["length"]))
    return F.array_join(F.transform(pieces, lambda t: F.when(raw, t).otherwise(unescape(t))), "")


def format_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: id_col, formatted, loss_mask (array of start and length)."""
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(row)).alias("t"))
    source = grouped.select(id_col, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("t"))
    for level in LEVELS:
        tried = render(F.col("t"), level)
        if level == 0:
            source = source.withColumn("formatted", tried)
        else:
            source = source.withColumn("formatted", F.when(parse(F.col("formatted")) == F.col("t"), F.col("formatted")).otherwise(tried))
    return source.select(id_col, "formatted", loss_spans(F.col("formatted")).alias("loss_mask"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the rendered strings say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted.withColumn("t", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    turns = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
