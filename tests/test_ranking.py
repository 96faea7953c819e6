"""Keyword ranking beyond the broadcast bound; columns that hits carry; top-k inside a video against a plain loop."""

import numpy as np

from chronoreel.operators import extras, search
from chronoreel.sources import fixtures as X


def test_bm25_alike_beyond_the_bound(spark, monkeypatch):
    rows = [(1, "red fox runs red"), (2, "blue fox"), (3, None), (4, ""), (None, "fox red"), (5, "unrelated words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "nothing shared"), (3, None)], "query_id long, query string")
    near = {(r.query_id, r.doc_id): round(r.score, 9) for r in extras.bm25(docs, queries).collect()}
    monkeypatch.setattr(extras, "ASKED_TERMS", 0)
    far = {(r.query_id, r.doc_id): round(r.score, 9) for r in extras.bm25(docs, queries).collect()}
    assert near == far and sorted(near) == [(1, 1), (1, 2)]
    assert near[1, 1] > near[1, 2] > 0


def test_bm25_without_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red fox")], "query_id long, query string")
    assert extras.bm25(docs, queries).collect() == []


def test_topk_inside_a_video_and_carried_columns(spark, sf_dir):
    chunks, asked = X.chunks(spark, sf_dir), X.query_vectors(spark, sf_dir)
    found = search.vector_topk(chunks, asked, 3, same_video=True, carry=("video_id", "start_ms")).collect()
    rows = chunks.collect()
    unit = {r.chunk_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows}
    want = set()
    for q in asked.collect():
        v = np.array(q.query) / np.linalg.norm(q.query)
        scored = sorted((-round(float(v @ unit[r.chunk_id]), 6), r.chunk_id, r.video_id, r.start_ms) for r in rows if r.video_id == q.query_video)
        want |= {(q.query_id, i, video, start) for s, i, video, start in [x for x in scored if -x[0] >= 0][:3]}
    assert {(r.query_id, r.chunk_id, r.video_id, r.start_ms) for r in found} == want
