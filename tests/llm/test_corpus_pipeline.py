import hashlib

import corpus_pipeline


def test_stages(spark, rows, tmp_path):
    path = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, path)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
    texts = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in now.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, now, path)
    assert sorted((r.doc_id, r.decoded_sha256) for r in last.collect()) == texts
    assert corpus_pipeline.run(spark, path).count() == len(texts)


def test_odd_rows(spark, odd, none):
    for docs in (odd, none):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
