"""Registration of queries, and the tables in the roles of frames, tokens and second tracks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderly.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EPOCH_US = 1_704_067_200_000_000


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.replace("{FR}", FR_SQL).replace("{TOK}", TOK_SQL)
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


FR_SQL = f"""fr AS (
  SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id AS eid, event_type AS kind, value,
    epoch_us(ts) - {EPOCH_US} AS us, CASE WHEN event_type <> 'error' AND value > 0 THEN value END AS f, (event_id * 37 % 100) / 100.0::DOUBLE AS strength,
    (event_id * 13 % 60 - 60)::DOUBLE AS rms, (event_id * 29 % 60 - 70)::DOUBLE AS rms2,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 0.01::DOUBLE AS t
  FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames of 10 ms: the user is the recording; errors and frequencies of 0 are unvoiced (NULL)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    eid = F.col("event_id")
    return (
        table(spark, sf_dir, "events")
        .withColumn("i", F.row_number().over(order).cast("long"))
        .select(
            F.col("user_id").alias("rec"), "i", eid.alias("eid"), F.col("event_type").alias("kind"), "value",
            (micros(F.col("ts")) - EPOCH_US).alias("us"), F.when((F.col("event_type") != "error") & (F.col("value") > 0), F.col("value")).alias("f"),
            (eid * 37 % 100 / 100.0).alias("strength"), (eid * 13 % 60 - 60).cast("double").alias("rms"),
            (eid * 29 % 60 - 70).cast("double").alias("rms2"), (F.col("i") * F.lit(0.01)).alias("t"),
        )
    )


TOK_SQL = """tok AS (
  SELECT rec, tok, (tok * 12 + 1) * 0.01::DOUBLE AS a, (tok * 12 + 1) * 0.01::DOUBLE + (10 + (tok * 7 + rec) % 4) * 0.01::DOUBLE AS b
  FROM (SELECT DISTINCT rec, (i - 1) // 12 AS tok FROM fr))"""


def token_span() -> dict[str, Column]:
    """Start a and end b of the token of a block."""
    a = (F.col("tok") * 12 + 1) * F.lit(0.01)
    return {"a": a, "b": a + (10 + (F.col("tok") * 7 + F.col("rec")) % 4) * F.lit(0.01)}


def tokens(fr: DataFrame) -> DataFrame:
    """Blocks of 12 frames as tokens of 100 to 130 ms."""
    return fr.select("rec", F.expr("(i - 1) div 12").alias("tok")).distinct().withColumns(token_span())


def token_frames(fr: DataFrame, halo: float = 0.03) -> DataFrame:
    """tokens with the frames around them. A token's place follows from its block, so each frame is dealt to its own block
    and to the two beside it and no table is joined; the range is what remains to be tested."""
    block = F.expr("(i - 1) div 12")
    last = F.max(block).over(Window.partitionBy("rec"))
    dealt = fr.withColumns({"last": last, "tok": F.explode(F.array(block - 1, block, block + 1))}).where("tok BETWEEN 0 AND last")
    near = dealt.withColumns(token_span())
    return near.where((F.col("t") >= F.col("a") - halo) & (F.col("t") < F.col("b") + halo)).drop("last")
