"""The tools asked in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoreel import sql_tools
from chronoreel.operators import align
from chronoreel.plans import scenes as S
from chronoreel.sources import fixtures as X


def _view(df):
    name = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def evidence(spark, sf_dir):
    """All scenes of conversations with what is seen and said; every third has a summary and a fused text of its own."""
    scenes, segments, visual = X.seg_scenes(spark, sf_dir), X.segments(spark, sf_dir), S._visual_all(spark, sf_dir)
    speech = align.scene_speech(align.overlaps(scenes, segments))
    gated = align.gate_scenes(scenes, segments, visual)
    fused = scenes.where("(video_id + scene_id) % 3 = 0").select("video_id", "scene_id", F.concat(F.lit("heard "), "scene_id").alias("audio_summary"), F.concat(F.lit("both "), "scene_id").alias("fused"))
    return align.scene_evidence(scenes, gated, visual, speech, fused)


def _shown(rows):
    said = F.array_join(F.transform("speech_segments", lambda x: F.concat_ws("|", x["start_ms"], x["end_ms"], x["text"])), "\n")
    return rows.select(
        "video_id", "scene_id", "start_ms", "end_ms", "keyframe_ms", F.md5("description").alias("description_md5"), F.md5("visual_description").alias("visual_md5"), "audio_summary", "fused_description",
        "audio_relation", F.round("relation_confidence", 9).alias("relation_confidence"), F.size("speech_segments").alias("n_speech"), F.md5(said).alias("speech_md5"),
    )


def scene_evidence(spark, sf_dir):
    return _shown(evidence(spark, sf_dir))


def sql_scene_info(spark, sf_dir):
    """The scene at 25 s of every conversation, with its evidence, through the table function."""
    sql_tools.register(spark)
    return _shown(spark.sql(f"SELECT * FROM get_scene_info(TABLE({_view(evidence(spark, sf_dir))}), timestamp_ms => 25000)"))


_EVIDENCE_SQL = f"""WITH {S._SPEECH_SQL}, gated AS ({S.GATE_ALL_SQL}),
spoken AS (SELECT video_id, scene_id, count(*)::INT AS n, string_agg(concat_ws('|', start_ms, end_ms, text), chr(10) ORDER BY start_ms, seg_idx) AS said FROM speech GROUP BY ALL),
numbers AS (SELECT max(item_id) + 1 AS numbers FROM benchmark),
e AS (SELECT s.video_id, s.scene_id, s.start_ms, s.end_ms, s.start_ms AS keyframe_ms, b.text AS visual, CASE WHEN (s.video_id + s.scene_id) % 3 = 0 THEN 'heard ' || s.scene_id END AS audio_summary,
  CASE WHEN (s.video_id + s.scene_id) % 3 = 0 THEN 'both ' || s.scene_id END AS fused_description, coalesce(g.relation, 'unknown') AS audio_relation, coalesce(g.confidence, 0) AS relation_confidence, coalesce(p.n, 0) AS n_speech, coalesce(p.said, '') AS said
  FROM seg_scenes s CROSS JOIN numbers LEFT JOIN benchmark b ON b.item_id = (s.video_id * 7 + s.scene_id) % numbers LEFT JOIN gated g ON g.video_id = s.video_id AND g.scene_id = s.scene_id LEFT JOIN spoken p ON p.video_id = s.video_id AND p.scene_id = s.scene_id)
SELECT video_id, scene_id, start_ms, end_ms, keyframe_ms, md5(coalesce(fused_description, visual)) AS description_md5, md5(visual) AS visual_md5, audio_summary, fused_description, audio_relation, relation_confidence, n_speech, md5(said) AS speech_md5 FROM e"""


def sql_transcript(spark, sf_dir):
    sql_tools.register(spark)
    name = _view(X.segments(spark, sf_dir).select("video_id", "seg_idx", "start_ms", "end_ms", F.md5("text").alias("text_md5")))
    return spark.sql(f"SELECT * FROM get_transcript(TABLE({name}), start_ms => 5000, end_ms => 30000)")


TRANSCRIPT_SQL = f"""WITH {X.SEGMENTS} SELECT video_id, seg_idx, start_ms, end_ms, md5(text) AS text_md5,
  start_ms // 60000 || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || '-' || end_ms // 60000 || ':' || lpad((end_ms // 1000 % 60)::VARCHAR, 2, '0') AS label FROM segments WHERE end_ms >= 5000 AND start_ms <= 30000"""


def sql_search(spark, sf_dir):
    """The three chunks of every video nearest to the table's first vector, through the table function."""
    sql_tools.register(spark)
    chunks = X.chunks(spark, sf_dir)
    first = chunks.orderBy("chunk_id").select(F.transform("embedding", lambda x: x.cast("double")).alias("q")).first()
    query = ", ".join(f"CAST({x!r} AS DOUBLE)" for x in (first["q"] if first else []))
    return spark.sql(f"SELECT * FROM search_video_content(TABLE({_view(chunks.select('video_id', 'chunk_id', 'start_ms', 'embedding'))}), query => array({query}), top_k => 3)")


SEARCH_SQL = f"""WITH {X.CHUNKS}, q AS (SELECT embedding AS q FROM chunks ORDER BY chunk_id LIMIT 1),
s AS (SELECT video_id, chunk_id, start_ms, round(list_cosine_similarity(embedding, q), 6) AS score FROM chunks, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE score >= 0) SELECT * FROM r WHERE rank <= 3"""


QUERIES = {
    "scene_evidence": (scene_evidence, _EVIDENCE_SQL),
    "sql_scene_info": (sql_scene_info, _EVIDENCE_SQL + " WHERE start_ms <= 25000 AND 25000 < end_ms"),
    "sql_transcript": (sql_transcript, TRANSCRIPT_SQL),
    "sql_search": (sql_search, SEARCH_SQL),
}
