"""Texts are told apart by a few bits of their hashes, so that those of large tables are not shuffled for it."""

import random

import pytest
from pyspark.sql import functions as F

from orderly.llm import jaccard

COPIES = 5


@pytest.fixture
def without_broadcasts(spark):
    """As on tables that are too large for the threshold."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def shuffled(spark, df):
    """The rows of df and the bytes shuffled for them."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    return df.collect(), written() - before


def documents(spark, n=200):
    rng = random.Random(7)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(150)) for _ in range(n)]
    rows = [*enumerate(texts), *((n + i, texts[i]) for i in range(COPIES)), *((None, texts[i] + " tail") for i in range(COPIES))]
    return jaccard.materialize(spark.createDataFrame(rows, "doc_id long, text string")), texts


def test_deduplication_shuffles_no_text_that_stays(spark, without_broadcasts):
    docs, texts = documents(spark)
    rows, sent = shuffled(spark, jaccard.deduplicate(docs))
    assert sorted((r.doc_id, r.text) for r in rows) == list(enumerate(texts))
    assert sent < sum(map(len, texts)) / 5


def test_one_of_each_and_token_sets_shuffle_few_texts(spark, without_broadcasts):
    docs, texts = documents(spark)
    hashed = jaccard.materialize(docs.select(jaccard.text_hash("text").alias("h"), "text"))
    often = jaccard.materialize(hashed.groupBy("h").count().where("count > 1").select("h"))
    rows, sent = shuffled(spark, jaccard.one_of_each(hashed, often))
    assert len(rows) == len({r.text for r in rows}) == len(texts) + COPIES
    assert sent < sum(map(len, texts)) / 5
    asked = hashed.where(F.col("text") == texts[0]).select(F.lit(1).alias("fp"), "h").distinct()
    assert [(r.fp, len(r.tokens)) for r in jaccard.token_sets(hashed, often, asked, 5).collect()] == [(1, 146)]


def test_a_full_table_of_bits_changes_no_row(spark, monkeypatch):
    docs, texts = documents(spark, 40)
    monkeypatch.setattr(jaccard, "SIFT_BITS", 1)
    assert sorted((r.doc_id, r.text) for r in jaccard.deduplicate(docs).collect()) == list(enumerate(texts))
    some, others = jaccard.sifted(docs, F.xxhash64("doc_id"), docs.limit(1).select(F.xxhash64("doc_id").alias("x")))
    assert (some.count(), others.count()) == (docs.count(), 0)


def test_no_wanted_hash(spark):
    docs, _ = documents(spark, 10)
    some, others = jaccard.sifted(docs, F.xxhash64("doc_id"), docs.limit(0).select(F.xxhash64("doc_id").alias("x")))
    assert (some.count(), others.count()) == (0, docs.count())
