"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks.

Source i has the share p_i of all tokens. Its weight is p_i^a / sum p^a; the exponent a is found by bisection as the
least (most even mix) at which the weights' entropy is at most the target and no source is repeated more often than
the limit. The target lies between the entropy of the shares and the greatest possible, by default half-way, so shares that
are not equal are always evened out. The budget is the least for which the source that is repeated least is used once in full, so no document is
lost. Each source is a number of whole passes and a part of one more: its documents are dealt to blocks of about
``block_tokens`` tokens by a hash of id and text, every pass takes the blocks in a permutation of its own, and in a block
each document has a place by a hash that differs from pass to pass. The last pass takes the documents whose place lies
within the budget. A document's place ``at`` is the share of its source's budget that comes before it, so that in the order of ``at`` the
sources run side by side.

Null sources are a source of their own; null and empty texts count no tokens and come once in every full pass. Rows that
repeat come as often as any other, side by side. An empty table gives no rows. Input columns may
have any names. The driver sees a few sums; sources may be many, and a hot source has more blocks, not larger ones: their
running sums are taken over ranges of blocks, and no block is sorted as a whole. Whole rows move once, into the order of the mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderly.operators.quantiles import dealt_by_range
from orderly.session import materialize, release

REPEAT_LIMIT = 1.5
EVENNESS = 0.5
BLOCK_TOKENS = 50_000
SEED = 17
GRID = 16


def exponent_of(shares: DataFrame, repeat_limit: float, entropy_share: float | None, evenness: float = EVENNESS) -> float:
    """The least exponent in [0, 1] at which the entropy of the weights is at most the target and no source is passed through more than
    ``repeat_limit`` times. The target is ``entropy_share`` of the greatest possible entropy (or that of the shares, if higher); without it, the target lies the part ``evenness`` of the way from the shares' to the greatest.
    shares: lp, the logarithm of each source's share. Each round tries a grid inside the bracket in one aggregation."""
    ends = shares.agg(F.count("*").alias("n"), F.min("lp").alias("low"), F.max("lp").alias("high"), F.sum(-F.col("lp") * F.exp("lp")).alias("entropy")).first()
    if not ends["n"]:
        return 1.0
    most = math.log(ends["n"])
    target = (ends["entropy"] + evenness * max(0.0, most - ends["entropy"]) if entropy_share is None else max(ends["entropy"], entropy_share * most)) + 1e-12
    low, high = max(0.0, 1 - math.log(repeat_limit) / max(ends["high"] - ends["low"], 1e-300)), 1.0
    for _ in range(10):
        tries = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        # Powers relative to the greatest share, so that no sum under- or overflows.
        part = [F.exp(a * (F.col("lp") - ends["high"])) for a in tries]
        sums = shares.agg(*[F.sum(p).alias(f"z{k}") for k, p in enumerate(part)], *[F.sum(p * a * (F.col("lp") - ends["high"])).alias(f"e{k}") for k, (p, a) in enumerate(zip(part, tries, strict=True))]).first()
        fits = [math.log(sums[f"z{k}"]) - sums[f"e{k}"] / sums[f"z{k}"] <= target for k in range(GRID + 1)]
        first = fits.index(True) if True in fits else GRID
        if first == 0:
            return tries[0]
        low, high = tries[first - 1], tries[first]
    return high


def temperature(tokens: DataFrame, repeat_limit: float = REPEAT_LIMIT, entropy_share: float | None = None) -> DataFrame:
    """tokens (source, tokens) with weight and passes: the share of the mix and how often it goes through the source.
    Sources without tokens have the weight 0 and one pass."""
    known = tokens.where("tokens > 0")
    total = known.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total[0]:
        return tokens.withColumns({"weight": F.lit(0.0), "passes": F.lit(1.0)})
    a = exponent_of(known.select(F.log(F.col("tokens") / total[0]).alias("lp")), repeat_limit, entropy_share)
    raised = F.when(F.col("tokens") > 0, F.exp(a * F.log(F.col("tokens") / total[1])))
    whole = known.agg(F.sum(raised)).first()[0]
    return tokens.withColumns({"weight": F.coalesce(raised / whole, F.lit(0.0)), "passes": F.coalesce(F.exp((a - 1) * F.log(F.try_divide(F.col("tokens"), F.lit(total[1])))), F.lit(1.0))})


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def scheduled(
    rows: DataFrame,
    repeat_limit: float = REPEAT_LIMIT,
    entropy_share: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """From rows (id, source, text, row): id, source, row, tokens, weight, pass, block and at for every time that a row comes
    in the mix. Text is read twice: for the sizes of sources and blocks, and for the rows themselves."""
    known = rows.withColumns({"tokens": token_count(F.col("text")), "h": F.xxhash64("id", "text")}).drop("text")
    narrow = materialize(known.select("source", "h", "tokens"))
    sums = materialize(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    part = (F.col("passes") - F.col("full")) * F.col("tokens")
    plan = temperature(sums, repeat_limit, entropy_share).withColumn("full", F.floor(F.col("passes") + 1e-9)).select(
        F.col("source").alias("name"), "weight", "full", F.round(F.greatest(part, F.lit(0.0))).cast("long").alias("rest"),
        F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).alias("blocks"), F.col("tokens").alias("whole"),
    )
    plan = materialize(plan)
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1)))

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(plan, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("blocks")))

    sizes = dealt(narrow).groupBy("source", "block", "full", "rest").agg(F.sum("tokens").alias("size")).withColumn("pass", passes)
    turns = sizes.select(F.struct("source", "pass").alias("run"), "block", "size", F.xxhash64(F.lit(seed), "pass", "source", "block").alias("turn"))
    begun = dealt_by_range(turns, "run", ["turn", "block"], F.col("size")).select(
        F.col("run.source").alias("s"), F.col("run.pass").alias("p"), F.col("block").alias("k"), "size", (F.col("upto") - F.col("size")).alias("begin")
    )
    begun = materialize(begun)
    release(narrow, sums)
    every = dealt(known).withColumn("pass", passes)
    met = every.join(begun, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("block") == F.col("k")))
    within = F.pmod(F.xxhash64("h", "pass", F.lit(seed + 1)), F.lit(1 << 40)) / float(1 << 40)
    placed = met.withColumn("place", F.col("begin") + F.col("size") * within).where("pass < full OR place < rest")
    budget = F.greatest(F.col("full") * F.col("whole") + F.col("rest"), F.lit(1))
    at = (F.col("pass") * F.col("whole") + F.col("place")) / budget
    return placed.select("id", "source", "row", "h", "tokens", "weight", "pass", "block", at.alias("at"))


def rows_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), row.alias("row"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """One row for every time that a row of docs comes in the mix: id_col, source_col, tokens, weight (of the source),
    pass (from 0), block and at (its place in the mix, from 0 to 1)."""
    planned = scheduled(rows_of(docs, id_col, text_col, source_col, F.lit(0)), **parameters)
    return planned.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "weight", "pass", "block", "at")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """docs with every row as often as its source's weight asks for, in the order of the mix, with the columns of docs."""
    planned = scheduled(rows_of(docs, id_col, text_col, source_col, F.struct(*docs.columns)), **parameters)
    return planned.select("at", "h", "row").repartitionByRange("at", "h").sortWithinPartitions("at", "h").select("row.*")
