import corpus_pipeline as c
from thermoline.llm import decontam, ngram_join, pii, quality_rules


def test_stages_one_after_another(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    step = docs.where(docs.doc_id.isin(sorted(good)))
    first = {r.doc_id for r in ngram_join.near_duplicates(step).where("doc_id = class_id").collect()}
    step = step.where(step.doc_id.isin(sorted(first)))
    clean = {r.doc_id for r in decontam.contamination(step, spark.read.parquet(f"{d}/benchmark.parquet")).where("n_items = 0").collect()}
    out = c.run(spark, d).collect()
    assert {r.doc_id for r in out} == clean
    assert all(r.round_trip for r in out)
    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "segmentation"]


def test_all_stages_but_the_last_keep_the_columns(spark, table, odd):
    for docs in (table(odd), table([])):
        for _, stage in c.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == table([]).columns
            docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
        assert c.STAGES[-1][1](spark, docs, "").count() >= 0


def test_masked_texts_hold_no_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert all(not pii.base_spans(r.text) for r in pii.masked(docs).collect())
