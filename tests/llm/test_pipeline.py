import corpus_pipeline
from corvid.llm import queries
from corvid.llm.toxicity import score_toxicity

from . import reference as ref

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.count())
        if k < 4:
            assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString(), name
        if k == 0:
            bad = {r.doc_id for r in score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
        if k == 1:
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if k == 2:
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            assert {r.doc_id for r in docs.collect()} == {i for i, _, _, c in ref.jaccard(rows) if i == c}
        if k == 3:
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            leaked = {r.doc_id for r in before.collect() for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if b.text in r.text}
            assert leaked <= gone
    assert kept == sorted(kept, reverse=True) and docs.columns[0] == "doc_id" and docs.where("not round_trip").count() == 0
    final = {(r.doc_id, tuple(r.ids)) for r in docs.collect()}
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()} == final


def test_pipeline_takes_empty_and_ugly_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    ugly = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 50_000, "en", "s", 100_000)], schema)
    for docs in (spark.createDataFrame([], schema), ugly):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    assert docs.count() >= 3


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert "pipeline" in names and set(queries.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
