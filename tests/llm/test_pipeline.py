import corpus_pipeline
from kinfold.llm import decontaminate, jaccard, language
from kinfold.session import written


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, d), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        sizes.append(docs.count())
        if "Jaccard" in name:
            assert jaccard.near_duplicates(docs).where("doc_id <> component_id").count() == 0
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in jaccard.near_duplicates(before).select("component_id").distinct().collect()}
        if "decontamination" in name:
            assert decontaminate.report(docs, spark.read.parquet(f"{d}/benchmark.parquet")).where("contaminated").count() == 0
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5] > 0


def test_stages_on_odd_rows(spark, odd, no_docs):
    """Nulls, empty and very long texts, repeated rows and clashing names go through every stage."""
    d = "/root/testdata/sf0.001"
    for docs in (odd[0], no_docs, no_docs.selectExpr("*", "1 as `a.b`")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, d), "stage")
            assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        if columns == odd[0].columns:
            # the twelve texts with words and different sets, less near copies
            assert {r[0] for r in docs.select("doc_id").collect()} <= {None, 1, 6, 8, 10, 12}
        else:
            assert docs.count() == 0


def test_strange_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    gone = docs.join(language.accepted(docs), "doc_id", "left_anti").join(labels, "doc_id", "left").collect()
    assert len(gone) > 5 and not any(r["quality"] == 1 for r in gone)
