"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline

from turnwise.llm.quality_rules import judge_documents


def test_stages(spark, folder, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language", "near duplicates", "packing"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == documents.columns
        rows = kept.collect()
        assert 0 < len(rows) <= docs.count()
        if name == "quality rules":
            want = {r.doc_id for r in judge_documents(docs).filter("kept").collect()}
            assert {r.doc_id for r in rows} == want
        docs = spark.createDataFrame(rows, documents.schema)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_odd_rows_pass_through_every_stage(spark, folder, odd, empty):
    for frame in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, folder).count() >= 0
