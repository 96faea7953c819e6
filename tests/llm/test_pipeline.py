import zlib

import corpus_pipeline
from chronoreel.llm import queries


def test_stages(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    columns, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, d).cache()
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns
        assert set(kept) <= set(before) and len(kept) > 0.8 * len(before), name
        if name == "toxicity":
            assert not toxic & set(kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept)


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_messy_stages(spark, messy, empty, sf_dir):
    docs = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == messy.columns and docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_names():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}


def test_last_stage_has_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert pieces and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    totals = {}
    for r in pieces:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + len(r.ids) // 4
    assert totals == {r.doc_id: r.doc_tokens for r in pieces}
