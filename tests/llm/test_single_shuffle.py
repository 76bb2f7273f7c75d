"""Keys of the similarity join are brought together once, and not counted before."""

from orderly.llm.jaccard import candidates


def test_rows_of_keys_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    buckets = {1: [5], 2: [7, 3], 3: [4, 1, 2], 4: [10, 11, 12, 13]}
    rows = [(key, fp) for key, sets in buckets.items() for fp in sets]
    pairs, heavy, shared = candidates(spark.createDataFrame(rows, "key long, fp long").mapInPandas(passed, "key long, fp long"), light=3)
    assert {tuple(r) for r in pairs.collect()} == {(3, 7), (1, 2), (1, 4), (2, 4), (10, 11), (10, 12), (10, 13)}
    assert {tuple(r) for r in heavy.collect()} == {(4, fp) for fp in buckets[4]}
    assert {r.key: r.c for r in shared.collect()} == {2: 2, 3: 3, 4: 4}
    assert read.value == len(rows)
