import corpus_pipeline
from plumbline.llm import decontam, langid, quality
from tests.llm.test_results import classes_of, shingle_sets


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    scored = {r.doc_id: r.kept for r in quality.classify(docs).collect()}
    first = [r for r in rows if scored[r.doc_id]]
    one = spark.createDataFrame(first, docs.schema)
    accepted = {r.doc_id: r.accepted for r in langid.identify(one).collect()}
    second = [r for r in first if accepted[r.doc_id]]
    classes = classes_of(shingle_sets(second))
    third = [r for r in second if classes.get(r.doc_id, (r.doc_id, 0))[0] == r.doc_id]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = {r.doc_id for r in decontam.contaminated(spark.createDataFrame(third, docs.schema), bench).collect()}
    want = {r.doc_id for r in third} - leaks
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
    assert len(want) > 0.7 * len({classes_of(shingle_sets(rows))[r.doc_id][0] for r in rows if r.text})


def test_stage_names_and_columns(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
