"""Before a row counts, the branch that it stands for is shown to be taken."""

import pytest

from chronoreel.operators import entities as E
from chronoreel.plans import branches, registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def near_dir():
    return "/root/testdata/sf0.01"


def test_resolution_takes_every_branch(spark, near_dir):
    rows = QUERIES["reference_resolution"](spark, near_dir).collect()
    by_looks = [r for r in rows if r.reference == "穿红衣服的人"]
    between = [r for r in by_looks if r.score is not None and E.RESOLVE <= r.score < E.MATCH]
    assert between and all(r.resolved is not None for r in between)
    assert any(r.score is None and r.resolved is None for r in by_looks) and any((r.score or 0) >= E.MATCH for r in by_looks)
    for cue in ("刚才的那个人", "开头的人", "最后的那辆车"):
        assert any(r.reference == cue and r.resolved is not None for r in rows)


def test_near_vectors(spark, near_dir):
    hits = QUERIES["qa_cache_hits"](spark, near_dir).collect()
    assert any(r.hit for r in hits) and any(r.score is not None and not r.hit for r in hits)
    runs = QUERIES["alike_near"](spark, near_dir).collect()
    assert any(r.n > 1 for r in runs) and any(r.n == 1 for r in runs)


def test_ideographs(spark, near_dir):
    rows = QUERIES["keywords_mixed"](spark, near_dir).collect()
    assert sum(r["last"] is not None and len(r["last"]) == 2 and "一" <= r["last"][0] <= "鿿" for r in rows) > len(rows) / 2


def test_labels_defaults_changes(spark, near_dir):
    codes = QUERIES["label_codecs"](spark, near_dir)
    assert {r.relation for r in codes.select("relation").distinct().collect()} == {"strong", "contextual", "independent", "unknown"}
    assert {r.kind for r in codes.select("kind").distinct().collect()} == {"person", "object", "location", "text", "unknown"}
    assert {r.found for r in QUERIES["chunk_lookup"](spark, near_dir).select("found").distinct().collect()} == {True, False}
    titles = QUERIES["conversation_titles"](spark, near_dir).collect()
    assert {r.summary for r in titles} > {"none"} and any(r.updated_at > 100 for r in titles)
    flushes = QUERIES["delta_flushes"](spark, near_dir)
    messages = spark.read.parquet(f"{near_dir}/conversations.parquet").count()
    assert flushes.count() < messages


def test_words_alone_find_something(spark, near_dir):
    """Questions without a vector are answered by the path that ranks by words."""
    rows = QUERIES["four_path_retrieve"](spark, near_dir).collect()
    assert {r.query_id // 20 % 3 for r in rows} == {0, 1, 2}
    texts = {r.doc_id for r in spark.read.parquet(f"{near_dir}/documents.parquet").select("doc_id").collect()}
    assert all(r.chunk_id % 4 == 1 and r.chunk_id in texts for r in rows if r.query_id // 20 % 3 == 0)


def test_fused_sql_has_the_path():
    assert "UNION ALL SELECT query_id, chunk_id, 0.3" in branches.FOUR_PATHS_SQL and "% 3 > 0 AND ((collection" in branches.FOUR_PATHS_SQL


def test_profiles_are_found(spark, near_dir):
    """The path by entities brings chunks of profiles, whose ids are hashes."""
    rows = QUERIES["entity_path_retrieve"](spark, near_dir).collect()
    assert any(len(r.chunk_id) == 32 for r in rows) and any(len(r.chunk_id) < 32 for r in rows)
