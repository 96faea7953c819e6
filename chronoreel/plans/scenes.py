"""Scenes, alignment, gate, fusion and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoreel.functions import text as TX
from chronoreel.functions import vectors
from chronoreel.operators import align, segment
from chronoreel.sources import fixtures as X

THRESHOLD = 100.0


def _scored(spark, sf_dir):
    return segment.differences(X.frames(spark, sf_dir))


def scene_segments(spark, sf_dir):
    return segment.scenes(_scored(spark, sf_dir), THRESHOLD)


_SCENES_SQL = f"""{X.FRAMES},
scored AS (SELECT *, abs(signal - lag(signal) OVER w) AS score FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms, event_id)),
opened AS (SELECT *, CAST(sum(CASE WHEN score > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scene_id FROM scored),
runs AS (SELECT video_id, scene_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n_frames FROM opened GROUP BY ALL),
scenes AS (SELECT video_id, scene_id, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY scene_id), last_ms + 1000) AS end_ms, start_ms AS keyframe_ms, n_frames FROM runs)"""


def boundary_candidates(spark, sf_dir):
    rows = segment.boundaries(_scored(spark, sf_dir), THRESHOLD)
    return rows.withColumn("score", F.round("score", 6))


def sampling_density(spark, sf_dir):
    return segment.sampling_density(X.frames(spark, sf_dir))


DENSITY_SQL = f"""WITH {X.FRAMES}, g AS (SELECT video_id, count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS z FROM frames GROUP BY 1),
m AS (SELECT video_id, n, CASE WHEN n > 1 THEN (z - a) // (n - 1) ELSE 0 END AS mean_interval_ms FROM g)
SELECT *, mean_interval_ms > 2000 AS sparse FROM m"""


def scene_at(spark, sf_dir):
    """For each event the scene 30 s later."""
    points = X.frames(spark, sf_dir).select("video_id", F.col("event_id").alias("point_id"), (F.col("ts_ms") + 30_000).alias("ts_ms"))
    return segment.scene_at(points, scene_segments(spark, sf_dir))


SCENE_AT_SQL = f"""WITH {_SCENES_SQL}, points AS (SELECT video_id, event_id AS point_id, ts_ms + 30000 AS ts_ms FROM frames)
SELECT p.video_id, p.point_id, p.ts_ms, coalesce(min(s.scene_id), -1) AS scene_id FROM points p
LEFT JOIN scenes s ON s.video_id = p.video_id AND p.ts_ms >= s.start_ms AND p.ts_ms < s.end_ms GROUP BY ALL"""


def histogram_distance(spark, sf_dir):
    """Distance of each user's value histogram (16 bins) from the next user's."""
    bins = X.table(spark, sf_dir, "events").select(F.col("user_id"), F.least(F.lit(15), F.floor(F.col("value") / 31)).cast("int").alias("bin"))
    counts = bins.groupBy("user_id", "bin").count()
    total = F.sum("count")
    hist = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"), total.alias("n"))
    full = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0)) / F.col("n"))
    hist = hist.select("user_id", full.alias("h"))
    after = hist.select((F.col("user_id") - 1).alias("user_id"), F.col("h").alias("g"))
    both = hist.join(after, "user_id")
    return both.select("user_id", F.round(vectors.histogram_distance(F.col("h"), F.col("g"), channels=1), 6).alias("distance"))


HISTOGRAM_SQL = """WITH b AS (SELECT user_id, least(15, floor(value / 31))::INTEGER AS bin FROM events),
c AS (SELECT user_id, bin, count(*) AS c FROM b GROUP BY ALL), n AS (SELECT user_id, sum(c)::DOUBLE AS n FROM c GROUP BY 1),
p AS (SELECT user_id, bin, c / n AS p FROM c JOIN n USING (user_id)),
s AS (SELECT a.user_id, sum(sqrt(a.p * b.p)) AS s FROM p a JOIN p b ON b.user_id = a.user_id + 1 AND b.bin = a.bin GROUP BY 1),
pairs AS (SELECT a.user_id FROM n a JOIN n b ON b.user_id = a.user_id + 1)
SELECT user_id, round(least(1.0, greatest(0.0, 1 - coalesce(s, 0))), 6) AS distance FROM pairs LEFT JOIN s USING (user_id)"""


def _speech(spark, sf_dir):
    return align.scene_speech(align.overlaps(X.seg_scenes(spark, sf_dir), X.segments(spark, sf_dir)))


def segment_scene_overlap(spark, sf_dir):
    rows = _speech(spark, sf_dir)
    return rows.select("video_id", "scene_id", "seg_idx", "start_ms", F.length("text").cast("long").alias("chars"), "overlap")


_SPEECH_SQL = f"""{X.SEGMENTS}, {X.SEG_SCENES},
pairs AS (SELECT s.video_id, s.scene_id, s.start_ms AS scene_start, s.end_ms AS scene_end, g.seg_idx, g.start_ms, g.end_ms, g.text,
    least(s.end_ms, g.end_ms) - greatest(s.start_ms, g.start_ms) AS overlap
  FROM seg_scenes s JOIN segments g ON g.video_id = s.video_id AND s.start_ms < g.end_ms AND g.start_ms < s.end_ms AND g.end_ms > g.start_ms),
shares AS (SELECT *, overlap::DOUBLE / (end_ms - start_ms) AS share FROM pairs),
ranked AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS chars FROM shares WHERE share >= 0.05
  WINDOW w AS (PARTITION BY video_id, scene_id ORDER BY share DESC, start_ms, seg_idx)),
speech AS (SELECT video_id, scene_id, scene_start, scene_end, seg_idx, start_ms, end_ms, left(text, 1500) AS text, overlap FROM ranked WHERE n = 1 OR (n <= 8 AND chars <= 1500))"""


def coverage_span(spark, sf_dir):
    speech, scenes = _speech(spark, sf_dir), X.seg_scenes(spark, sf_dir)
    both = align.coverage(speech).join(align.cross_span(speech, scenes), ["video_id", "scene_id"])
    return both.select("video_id", "scene_id", F.round("coverage", 6).alias("coverage"), "spanned", F.round("span", 6).alias("span"))


_COVER_SQL = """cover AS (SELECT video_id, scene_id, least(1.0, sum(overlap)::DOUBLE / greatest(1, any_value(scene_end) - any_value(scene_start))) AS coverage FROM speech GROUP BY ALL),
touch AS (SELECT p.video_id, p.scene_id, count(DISTINCT s.scene_id) AS spanned FROM speech p JOIN seg_scenes s ON s.video_id = p.video_id AND s.start_ms < p.end_ms AND p.start_ms < s.end_ms GROUP BY ALL),
n AS (SELECT video_id, count(*) AS n FROM seg_scenes GROUP BY 1),
signals AS (SELECT c.video_id, c.scene_id, c.coverage, t.spanned, greatest(0, t.spanned - 1)::DOUBLE / greatest(1, n.n) AS span FROM cover c JOIN touch t USING (video_id, scene_id) JOIN n USING (video_id))"""
COVERAGE_SQL = f"WITH {_SPEECH_SQL}, {_COVER_SQL} SELECT video_id, scene_id, round(coverage, 6) AS coverage, spanned, round(span, 6) AS span FROM signals"


def _visual_all(spark, sf_dir):
    """Scenes described by the text of the benchmark item of their number: words in common with some speech."""
    items = X.table(spark, sf_dir, "benchmark")
    grid = X.seg_scenes(spark, sf_dir).crossJoin(F.broadcast(items.agg((F.max("item_id") + 1).alias("numbers"))))
    n = F.pmod(F.col("video_id") * 7 + F.col("scene_id"), F.col("numbers"))
    return grid.select("video_id", "scene_id", n.alias("item_id")).join(items, "item_id", "left").select("video_id", "scene_id", F.col("text").alias("description"))


def av_gate_all(spark, sf_dir):
    """The gate with descriptions from all items."""
    return _gated(spark, sf_dir, _visual_all(spark, sf_dir))


def _gated(spark, sf_dir, visual):
    rows = align.gate_scenes(X.seg_scenes(spark, sf_dir), X.segments(spark, sf_dir), visual)
    return rows.select("video_id", "scene_id", F.round("key_overlap", 6).alias("key_overlap"), F.round("relevance", 9).alias("relevance"), "relation", F.round("confidence", 9).alias("confidence"))


_STOPS = "['" + "', '".join(TX.STOP_WORDS) + "']"


def keywords_sql(text: str) -> str:
    runs = rf"regexp_extract_all(coalesce({text}, ''), '[\x{{4E00}}-\x{{9FFF}}]+|[\p{{L}}\p{{N}}]+')"
    return f"list_filter(list_transform(list_filter({runs}, lambda w: length(w) >= 2), lambda w: lower(w)), lambda w: NOT list_contains({_STOPS}, w))"


GATE_SQL = f"""WITH {_SPEECH_SQL}, {_COVER_SQL},
said AS (SELECT video_id, scene_id, string_agg(text, ' ' ORDER BY start_ms, seg_idx) AS said FROM speech GROUP BY ALL),
k AS (SELECT g.*, list_distinct({keywords_sql("b.text")}) AS kv, list_distinct({keywords_sql("d.said")}) AS ka, length(d.said) AS chars
  FROM signals g JOIN said d USING (video_id, scene_id) LEFT JOIN benchmark b ON b.item_id = (g.video_id * 7 + g.scene_id) % 40),
o AS (SELECT *, CASE WHEN least(len(kv), len(ka)) > 0 THEN len(list_intersect(kv, ka))::DOUBLE / least(len(kv), len(ka)) ELSE 0.0 END AS key_overlap FROM k),
r AS (SELECT *, (0.55 * least(1.0, key_overlap / 0.25) + 0.45 * least(1.0, coverage / 0.4)) * (1 - 0.35 * least(1.0, span / 0.3)) AS relevance FROM o)
SELECT video_id, scene_id, round(key_overlap, 6) AS key_overlap, round(relevance, 9) AS relevance,
  CASE WHEN chars < 6 THEN 'unknown' WHEN relevance >= 0.6 THEN 'strong' WHEN relevance >= 0.3 THEN 'contextual' WHEN relevance >= 0.12 THEN 'unknown' ELSE 'independent' END AS relation,
  round(least(0.95, CASE WHEN chars < 6 THEN 0.3 WHEN relevance >= 0.6 THEN 0.55 + 0.4 * (relevance - 0.6) / 0.4 WHEN relevance >= 0.3 THEN 0.45 + 0.25 * (relevance - 0.3) / 0.3
    WHEN relevance >= 0.12 THEN 0.35 ELSE 0.5 + 0.3 * (0.12 - relevance) / 0.12 END), 9) AS confidence FROM r"""


GATE_ALL_SQL = GATE_SQL.replace(
    "LEFT JOIN benchmark b ON b.item_id = (g.video_id * 7 + g.scene_id) % 40",
    "CROSS JOIN (SELECT max(item_id) + 1 AS numbers FROM benchmark) LEFT JOIN benchmark b ON b.item_id = (g.video_id * 7 + g.scene_id) % numbers",
).replace("SELECT g.*, list", "SELECT g.video_id, g.scene_id, g.coverage, g.spanned, g.span, list")


def transcript_range(spark, sf_dir):
    rows = align.transcript_range(X.segments(spark, sf_dir), 4_000, 12_000)
    return rows.select("video_id", "seg_idx", "start_ms", "end_ms")


def transcript_text(spark, sf_dir):
    timed = align.transcript(X.segments(spark, sf_dir)).withColumnRenamed("transcript", "timed")
    plain = align.transcript(X.segments(spark, sf_dir), plain=True).withColumnRenamed("transcript", "plain")
    return timed.join(plain, "video_id")


_LABEL_B = "((x // 1000) // 60)::VARCHAR || ':' || lpad(((x // 1000) % 60)::VARCHAR, 2, '0')"
TRANSCRIPT_SQL = f"""WITH {X.SEGMENTS} SELECT video_id,
string_agg('[' || {_LABEL_B.replace("x", "start_ms")} || '-' || {_LABEL_B.replace("x", "end_ms")} || '] ' || trim(text) || chr(10), '' ORDER BY start_ms, seg_idx) AS timed,
string_agg(text, ' ' ORDER BY start_ms, seg_idx) AS plain FROM segments GROUP BY 1"""


def _fused(spark, sf_dir):
    """Scenes with speech, a program verdict and a made-up model reply: every third unparsable."""
    speech = _speech(spark, sf_dir)
    spoken = speech.groupBy("video_id", "scene_id").agg(F.first("scene_start").alias("start_ms"), F.first("scene_end").alias("end_ms"), F.count(F.lit(1)).alias("n"), F.min("seg_idx").alias("seg"))
    k = F.col("video_id") + F.col("scene_id")
    relation = F.when(k % 2 == 0, "strong").otherwise("contextual")
    reply = (
        F.when(k % 3 == 0, F.lit("sorry, no answer"))
        .when(k % 3 == 1, F.concat(F.lit('ok ```json\n{"relation": " Strong ", "confidence": 0.'), (k % 10).cast("string"), F.lit(', "audio_summary": " heard ", "fused_description": "both"}\n```')))
        .otherwise(F.concat(F.lit('{"relation": "contextual", "confidence": 0.9, "audio_summary": "", "fused_description": ""}')))
    )
    return spoken.select("video_id", "scene_id", "start_ms", "end_ms", F.concat(F.lit("scene "), F.col("scene_id").cast("string")).alias("visual"), F.concat(F.lit("said "), F.col("seg").cast("string")).alias("said"), relation.alias("relation"), F.lit(0.8).alias("confidence"), reply.alias("reply"))


def fusion_reconcile(spark, sf_dir):
    rows = align.reconcile(_fused(spark, sf_dir))
    return rows.select("video_id", "scene_id", "from_model", "relation", F.round("confidence", 6).alias("confidence"), "audio_summary", "fused")


_FUSED_SQL = f"""{_SPEECH_SQL},
spoken AS (SELECT video_id, scene_id, any_value(scene_start) AS start_ms, any_value(scene_end) AS end_ms, min(seg_idx) AS seg, video_id + scene_id AS k FROM speech GROUP BY ALL),
fusion AS (SELECT video_id, scene_id, start_ms, end_ms, 'scene ' || scene_id AS visual, 'said ' || seg AS said, k % 3 <> 0 AS from_model, CASE WHEN k % 2 = 0 THEN 'strong' ELSE 'contextual' END AS own,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'strong' ELSE 'contextual' END AS stated, CASE k % 3 WHEN 1 THEN (k % 10) / 10.0 ELSE 0.9 END::DOUBLE AS c, k FROM spoken),
fused AS (SELECT video_id, scene_id, start_ms, end_ms, visual, from_model, coalesce(stated, own) AS relation,
  CASE WHEN NOT from_model THEN 0.8 WHEN stated = own THEN greatest(c, 0.8) ELSE least(greatest(c, 0.3), 0.6) END::DOUBLE AS confidence,
  CASE WHEN k % 3 = 1 THEN 'heard' ELSE said END AS audio_summary,
  CASE k % 3 WHEN 0 THEN 'visual: ' || visual || chr(10) || 'audio: ' || said || ' (relation to the picture not confirmed)' WHEN 1 THEN 'both' ELSE visual END AS fused FROM fusion)"""
FUSION_SQL = f"WITH {_FUSED_SQL} SELECT video_id, scene_id, from_model, relation, round(confidence, 6) AS confidence, audio_summary, fused FROM fused"


def evidence_fanout(spark, sf_dir):
    rows = align.reconcile(_fused(spark, sf_dir)).withColumn("has_audio", F.lit(True))
    return align.evidence_chunks(rows)


FANOUT_SQL = f"""WITH {_FUSED_SQL},
parts AS (SELECT *, unnest([{{t: 'SceneSummary', o: 0, e: 'visual', x: visual, keep: true}}, {{t: 'SceneAudio', o: 5, e: 'audio', x: audio_summary, keep: true}}, {{t: 'SceneFused', o: 6, e: 'fused', x: fused, keep: fused <> visual}}]) AS k FROM fused)
SELECT sha1(concat_ws('|', video_id, k.o, start_ms, end_ms, scene_id, 'v1')) AS chunk_id, video_id, scene_id, start_ms, end_ms, k.t AS chunk_type, k.e AS evidence, k.x AS text FROM parts WHERE k.keep AND k.x <> ''"""


def timeline_text(spark, sf_dir):
    rows = align.reconcile(_fused(spark, sf_dir))
    relation = F.when((F.col("video_id") + F.col("scene_id")) % 5 == 0, "independent").otherwise(F.col("relation"))
    shown = align.display_text(relation, F.col("visual"), F.col("audio_summary"), F.col("fused"), F.col("confidence"), F.lit(True))
    return rows.select("video_id", "scene_id", shown.alias("shown"))


TIMELINE_SQL = rf"""WITH {_FUSED_SQL},
d AS (SELECT *, CASE WHEN (video_id + scene_id) % 5 = 0 THEN 'independent' ELSE relation END AS r FROM fused)
SELECT video_id, scene_id, left(CASE WHEN r = 'independent' AND audio_summary <> '' THEN 'visual: ' || visual || chr(10) || 'audio: ' || audio_summary ELSE fused END
  || chr(10) || '[' || r || ' · ' || printf('%.2f', confidence) || ']', 240) AS shown FROM d"""

QUERIES = {
    "scene_segments": (scene_segments, f"WITH {_SCENES_SQL} SELECT * FROM scenes"),
    "boundary_candidates": (boundary_candidates, f"WITH {_SCENES_SQL} SELECT video_id, ts_ms, event_id, round(score, 6) AS score FROM scored WHERE score > 100"),
    "sampling_density": (sampling_density, DENSITY_SQL),
    "scene_at": (scene_at, SCENE_AT_SQL),
    "histogram_distance": (histogram_distance, HISTOGRAM_SQL),
    "segment_scene_overlap": (segment_scene_overlap, f"WITH {_SPEECH_SQL} SELECT video_id, scene_id, seg_idx, start_ms, length(text) AS chars, overlap FROM speech"),
    "coverage_span": (coverage_span, COVERAGE_SQL),
    "av_gate_all": (av_gate_all, GATE_ALL_SQL),
    "transcript_range": (transcript_range, f"WITH {X.SEGMENTS} SELECT video_id, seg_idx, start_ms, end_ms FROM segments WHERE end_ms >= 4000 AND start_ms <= 12000"),
    "transcript_text": (transcript_text, TRANSCRIPT_SQL),
    "fusion_reconcile": (fusion_reconcile, FUSION_SQL),
    "evidence_fanout": (evidence_fanout, FANOUT_SQL),
    "timeline_text": (timeline_text, TIMELINE_SQL),
}
