"""The pipeline's stages on a small corpus, and that queries and oracles belong together."""

import corpus_pipeline
from orderly.llm import registry


def test_registry():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in registry.queries() if q.startswith("op")}
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stages_keep_clean_documents(spark, tmp_path):
    clean = [". ".join(f"Line{k} word{k + j} says thing{j} plainly" for j in range(12)) + "." for k in range(0, 600, 20)]
    texts = [*clean, clean[0], clean[1] + " More.", "too short", None, " ".join(f"bad{k}***" for k in range(60))]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(clean)))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(range(len(clean)))
