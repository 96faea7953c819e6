"""Numbers in text are rounded as the SQL rounds them: by the exact value, halves to even."""

from pyspark.sql import functions as F

from chronoreel.functions import text as TX
from chronoreel.operators import evidence as V


def test_sizes_halfway(spark):
    sizes = [(0, "0 B"), (1023, "1023 B"), (1280, "1.2 KB"), (1792, "1.8 KB"), (5 * 2**18, "1.2 MB"), (9 * 2**28, "2.2 GB"), (2**60, "1048576.0 TB"), (None, None)]
    df = spark.createDataFrame(sizes, "size long, want string")
    assert df.where(~TX.human_size(F.col("size")).eqNullSafe(F.col("want"))).collect() == []


def test_scores_halfway(spark):
    scores = [(0.125, "0.12"), (0.145, "0.14"), (0.115, "0.12"), (0.375, "0.38"), (0.995, "0.99"), (0.0, "0.00")]
    rows = [(i, 1, "text", s, 0, 1000, None, "", "strong", s, "") for i, (s, _) in enumerate(scores)]
    kind = "query_id long, rank int, hit_path string, score double, start_ms long, end_ms long, scene_id long, evidence_type string, audio_relation string, relation_confidence double, text string"
    found = {r.query_id: r.evidence for r in V.evidence_text(spark.createDataFrame(rows, kind)).collect()}
    for i, (_, want) in enumerate(scores):
        assert f"（相似度 {want}）" in found[i] and f"（置信度 {want}）" in found[i]
