import corpus_pipeline

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path, docs, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table = docs.select(COLUMNS)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        after = stage(spark, table, str(tmp_path))
        assert after.columns == COLUMNS
        after.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        assert table.count() <= before.count()
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            kept = {(r[0], t) for r, (_, t) in zip(brute.near_duplicates(rows, threshold=80), rows, strict=True) if r[3]}
            assert sorted(kept, key=str) == sorted(((r.doc_id, r.text) for r in table.collect()), key=str)
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text or "") for r in table.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in table.collect()}


def test_run_and_empty(spark, tmp_path, no_docs, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    no_docs.select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
