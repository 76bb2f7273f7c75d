"""Lexicon look-ups: candidates of every character, ranked and capped; spellings parsed by initials and finals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrences(texts: DataFrame, lexicon: DataFrame, text_id: str, text: str) -> DataFrame:
    """Every character of every text with the lexicon words it is part of: a join on the character with the word's
    place in the text as residual flag ``whole`` (the word stands there in full). A row carries what surrounds its
    character as far as the longest word reaches, not the text."""
    reach = lexicon.agg(F.max(F.length("word"))).first()[0] or 1
    padded = F.concat(F.lit("\n" * (reach - 1)), F.col(text), F.lit("\n" * (reach - 1)))
    around = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("char"), F.substring(padded, i + 1, F.lit(2 * reach - 1)).alias("near")))
    chars = texts.select(text_id, F.posexplode(around).alias("i", "c")).select(text_id, "i", "c.*").where("char != ''")
    words = lexicon.select("*", F.posexplode(F.split("word", "")).alias("j", "char")).where("char != ''")
    whole = (F.col("i") >= F.col("j")) & (F.substring(F.col("near"), reach - F.col("j"), F.length("word")) == F.col("word"))
    return chars.join(words, "char").withColumn("whole", whole).drop("near")


def hits(texts: DataFrame, lexicon: DataFrame, text_id: str, text: str) -> DataFrame:
    """text_id, i, hits and whole of every character of every text that lexicon words have: at how many places of words it stands, and in how many words that stand
    there in full. The same as counting occurrences(), without a row for each: places are counted by character first, and only where the first two
    characters of some word stand is the text compared with words, of the lengths that begin so."""
    words = lexicon.where("word != ''").groupBy("word").agg(F.count("*").alias("times"))
    reach = words.agg(F.max(F.length("word"))).first()[0] or 1
    places = words.select("times", F.explode(F.split("word", "")).alias("char")).where("char != ''").groupBy("char").agg(F.sum("times").alias("n"))
    near = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("char"), F.substring(F.col(text), i + 1, F.lit(reach)).alias("near")))
    chars = texts.select(text_id, F.posexplode(near).alias("i", "c")).select(text_id, "i", "c.*").where("char != ''")
    counted = chars.join(F.broadcast(places), "char").groupBy(text_id, "i").agg(F.sum("n").alias("hits"))  # a row for each character that words have
    heads = words.select(F.left("word", F.lit(2)).alias("head"), F.length("word").alias("size")).groupBy("head").agg(F.collect_set("size").alias("sizes"))
    begun = chars.select(text_id, "i", "near", F.explode(F.array_distinct(F.array(F.left("near", F.lit(2)), F.left("near", F.lit(1))))).alias("head")).join(heads, "head")
    stands = begun.select(text_id, "i", "near", F.explode("sizes").alias("size")).where(F.length("near") >= F.col("size"))
    stands = stands.withColumn("word", F.left("near", F.col("size"))).join(words, "word")
    covered = stands.select(text_id, F.explode(F.sequence("i", F.col("i") + F.col("size") - 1)).alias("i"), "times")
    full = covered.groupBy(text_id, "i").agg(F.sum("times").alias("whole"))
    return counted.join(full, [text_id, "i"], "left").select(text_id, "i", "hits", F.coalesce("whole", F.lit(0).cast("long")).alias("whole"))


def ranked(candidates: DataFrame, keys: list[str], same: str, order: list[str], most: int = 6) -> DataFrame:
    """The first of equal candidates (``same``) and of those the first ``most`` in order, with their rank r."""
    first = Window.partitionBy(*keys, same).orderBy(*order)
    unique = candidates.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return unique.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= most)


def parse_syllables(spellings: DataFrame, initials: DataFrame, finals: DataFrame, aliases: DataFrame, specials: DataFrame | None = None, conditioned: DataFrame | None = None) -> DataFrame:
    """spelling, initial, final, ipa, method and the number of parses. Aliases are resolved first. A whole syllable listed in
    specials (spelling, final) has no initial; one in conditioned (spelling, initial, final) is split as it says; any other
    has every split whose halves are both in the tables, and is valid where that is exactly one: the rest keep NULLs and
    their count."""
    spark = spellings.sparkSession
    none = spark.createDataFrame([], "spelling string, initial string, final string")
    listed = (conditioned if conditioned is not None else none).select("spelling", "initial", "final", F.lit("conditioned").alias("method"), F.lit(1).alias("order"))
    if specials is not None:
        listed = listed.unionByName(specials.select("spelling", F.lit("").alias("initial"), "final", F.lit("special").alias("method"), F.lit(0).alias("order")))
    listed = listed.groupBy("spelling").agg(F.min_by(F.struct("initial", "final", "method"), "order").alias("whole")).withColumnRenamed("spelling", "s")
    named = spellings.select("spelling").distinct().join(aliases, "spelling", "left").select("spelling", F.coalesce("alias", "spelling").alias("s")).join(listed, "s", "left")
    ways = F.expr("transform(sequence(0, length(s)), k -> struct(left(s, k) AS initial, substring(s, k + 1) AS final, 'regular' AS method))")
    cut = named.select("spelling", F.explode(F.when(F.col("whole").isNull(), ways).otherwise(F.array("whole"))).alias("w")).select("spelling", "w.*")
    hits = cut.join(initials, "initial").join(finals, "final")
    ipa = F.concat("initial_ipa", "final_ipa")
    one = hits.groupBy("spelling").agg(F.count("*").alias("parses"), F.first(F.struct("initial", "final", ipa.alias("ipa"), "method")).alias("p"))
    only = F.col("parses") == 1
    return named.select("spelling").join(one, "spelling", "left").select(
        "spelling", *[F.when(only, F.col(f"p.{c}")).alias(c) for c in ("initial", "final", "ipa", "method")], F.coalesce("parses", F.lit(0)).alias("parses")
    )
