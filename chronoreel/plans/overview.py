"""Overviews, fallback scenes, confirmed boundaries, validity, entity constraints and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoreel import schema
from chronoreel.functions import text as TX
from chronoreel.operators import align, overview, search
from chronoreel.operators import entities as E
from chronoreel.plans.index import REFERENCES as _CUES
from chronoreel.sources import fixtures as X


#: A reference to the beginning, one to the ending, one by looks.
REFERENCES = _CUES[1:]


def _scenes(spark, sf_dir):
    s = X.segments(spark, sf_dir)
    return s.select("video_id", F.col("seg_idx").alias("scene_id"), "start_ms", "end_ms", F.col("start_ms").alias("keyframe_ms"), F.col("text").alias("description"))


_SCENES = f"{X.SEGMENTS}, sc AS (SELECT video_id, seg_idx AS scene_id, start_ms, end_ms, start_ms AS keyframe_ms, text AS description FROM segments)"


def scene_overview(spark, sf_dir):
    return overview.overview(_scenes(spark, sf_dir), most=3)


OVERVIEW_SQL = f"""WITH {_SCENES}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_id) AS place, count(*) OVER (PARTITION BY video_id) AS n_scenes FROM sc)
SELECT video_id, place, scene_id, start_ms, end_ms, left(coalesce(description, ''), 60) AS description, n_scenes, n_scenes > 3 AS more FROM p WHERE place <= 3"""


def boundary_confirmed(spark, sf_dir):
    frames = X.frames(spark, sf_dir).withColumn("probability", (F.col("event_id") % 100) / 100)
    return overview.confirmed_boundaries(frames)


CONFIRMED_SQL = f"""WITH {X.FRAMES}, f AS (SELECT *, (event_id % 100) / 100 AS probability, lead(1) OVER (PARTITION BY video_id ORDER BY ts_ms, event_id) AS following FROM frames)
SELECT video_id, ts_ms, event_id, probability FROM f WHERE following IS NOT NULL AND probability > 0.3"""


def fallback_scenes(spark, sf_dir):
    s = X.segments(spark, sf_dir)
    first = F.when(F.col("video_id") % 2 == 0, F.min("start_ms") + 40)
    videos = s.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"), first.alias("first_sample_ms"))
    return overview.with_fallback(_scenes(spark, sf_dir).where("video_id % 3 > 0").drop("description"), videos)


FALLBACK_SQL = f"""WITH {_SCENES}, v AS (SELECT video_id, max(end_ms) AS d, CASE WHEN video_id % 2 = 0 THEN min(start_ms) + 40 END AS f FROM segments GROUP BY 1)
SELECT video_id, scene_id, start_ms, end_ms, keyframe_ms FROM sc WHERE video_id % 3 > 0
UNION ALL SELECT video_id, 0, 0, d, coalesce(f, d // 2) FROM v WHERE video_id NOT IN (SELECT video_id FROM sc WHERE video_id % 3 > 0)"""


def timeline_bars(spark, sf_dir):
    s = _scenes(spark, sf_dir)
    ends = s.groupBy("video_id").agg(F.max("end_ms").alias("d"))
    left, width, right = overview.timeline_bar(F.col("start_ms"), F.col("end_ms"), F.col("d"))
    return s.join(ends, "video_id").select("video_id", "scene_id", left.alias("left_pct"), width.alias("width_pct"), right.alias("right_pct"))


BARS_SQL = f"""WITH {_SCENES}, e AS (SELECT video_id, max(end_ms) AS d FROM sc GROUP BY 1),
b AS (SELECT video_id, scene_id, CAST(round(start_ms / d * 100) AS BIGINT) AS l, CAST(greatest(2, round((end_ms / d - start_ms / d) * 100)) AS BIGINT) AS w FROM sc JOIN e USING (video_id) WHERE d > 0)
SELECT video_id, scene_id, l AS left_pct, w AS width_pct, greatest(0, 100 - l - w) AS right_pct FROM b"""


def frame_sizes(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("YUV420P", "NV12", "RGBA", "BGRA", "GRAY"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select("p_partkey", overview.frame_bytes(kind, F.col("p_size") * 2, F.col("p_size") + 1).alias("frame_bytes"))


FRAME_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN CAST(p_size AS BIGINT) * 2 * (p_size + 1) * 3 // 2
  WHEN p_partkey % 5 < 4 THEN CAST(p_size AS BIGINT) * 2 * (p_size + 1) * 4 END AS frame_bytes FROM part"""


def recent_files(spark, sf_dir):
    opened = X.table(spark, sf_dir, "events").select(F.concat(F.lit("/v/"), F.col("event_id"), F.lit(".mp4")).alias("path"), X.ts_ms(F.col("ts")).alias("opened_ms"))
    existing = X.table(spark, sf_dir, "events").where("event_id % 3 > 0").select(F.concat(F.lit("/v/"), F.col("event_id"), F.lit(".mp4")).alias("path"))
    return overview.recent_existing(opened, existing, 20)


RECENT_SQL = """WITH f AS (SELECT '/v/' || event_id || '.mp4' AS path, epoch_us(ts) // 1000 AS opened_ms, event_id FROM events),
n AS (SELECT * FROM f ORDER BY opened_ms DESC NULLS LAST, path LIMIT 20) SELECT path, opened_ms FROM n WHERE event_id % 3 > 0"""


def entity_constraint(spark, sf_dir):
    v = F.col("chunk_id")
    tagged = X.chunks(spark, sf_dir).withColumn("entity_ids", F.when(v % 10 > 0, F.array(v % 5, v % 7 + 10)))
    return search.search_filter(tagged, entity_ids=[1, 12]).select("chunk_id", "video_id")


ENTITY_SQL = f"WITH {X.CHUNKS} SELECT chunk_id, video_id FROM chunks WHERE chunk_id % 10 > 0 AND (chunk_id % 5 = 1 OR chunk_id % 7 = 2)"


def validity(spark, sf_dir):
    n = F.col("vec_id")
    start, end = (n % 9) * 10, (n % 11) * 10
    rows = X.table(spark, sf_dir, "embeddings").select(n, F.when(n % 4 > 0, n.cast("string")).otherwise("").alias("name"), start.alias("s"), F.when(n % 13 > 0, end).alias("e"))
    return rows.select("vec_id", schema.valid_chunk(F.col("name"), F.col("s"), F.col("e")).alias("chunk"), schema.valid_scene(n - 3, F.col("s"), F.col("e")).alias("scene"), schema.valid_segment(F.col("s"), F.col("e")).alias("segment"))


VALID_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN CAST(vec_id AS VARCHAR) ELSE '' END AS name, (vec_id % 9) * 10 AS s, CASE WHEN vec_id % 13 > 0 THEN (vec_id % 11) * 10 END AS e FROM embeddings)
SELECT vec_id, coalesce(name <> '' AND e >= s, false) AS chunk, coalesce(vec_id - 3 >= 0 AND e > s, false) AS scene, coalesce(e > s, false) AS segment FROM r"""


def replies_and_links(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    reply = F.concat(F.lit('{"id": 1, "summary" : "'), F.col("text"), F.lit('", "x": "summary"}'))
    link = F.concat(F.when(F.col("turn") % 3 == 0, "ts://x").otherwise("ts://"), F.col("conv_id") * 1000 + F.col("turn"))
    return c.select("conv_id", "turn", TX.summary_field(reply).alias("summary"), TX.deep_link_ms(link).alias("at_ms"))


LINKS_SQL = r"""WITH c AS (SELECT conv_id, turn, '{"id": 1, "summary" : "' || text || '", "x": "summary"}' AS reply, CASE WHEN turn % 3 = 0 THEN 'ts://x' ELSE 'ts://' END || (conv_id * 1000 + turn) AS link FROM conversations)
SELECT conv_id, turn, regexp_extract(reply, '"summary"\s*:\s*"([^"]*)"', 1) AS summary, TRY_CAST(nullif(regexp_extract(link, '^ts://(\d+)$', 1), '') AS BIGINT) AS at_ms FROM c"""


def reference_similar(spark, sf_dir):
    """References (the stated query vectors) to entities of their video, all other vectors there: by the beginning or the
    ending, else the most similar one at 0.6 or more."""
    chunks = X.chunks(spark, sf_dir)
    rows = chunks.where("chunk_id % 20 > 0")
    ents = rows.select("video_id", F.col("chunk_id").alias("entity_id"), F.col("start_ms").alias("first_ms"), F.col("end_ms").alias("last_ms"))
    asked = X.query_vectors(spark, sf_dir)
    best = E.best_entity(search.vector_topk(rows, asked, 1, E.RESOLVE, same_video=True).drop("rank"), E.RESOLVE, key="chunk_id")
    refs = F.array(*map(F.lit, REFERENCES))
    known = asked.select("query_id", F.col("query_video").alias("video_id")).join(E.extremes(ents), "video_id").join(best, "query_id", "left")
    reference = F.get(refs, (F.col("query_id") / 20 % 3).cast("int"))
    found = E.resolve(reference, F.lit(0), F.lit(None).cast("long"), F.col("earliest"), F.col("latest"), F.col("chunk_id"))
    return known.select("query_id", found.alias("resolved"), F.round("score", 5).alias("score"))


REFERENCE_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS}, e AS (SELECT * FROM chunks WHERE chunk_id % 20 > 0),
x AS (SELECT video_id, arg_min(chunk_id, (start_ms, chunk_id)) AS earliest, arg_min(chunk_id, (-end_ms, chunk_id)) AS latest FROM e GROUP BY 1),
p AS (SELECT query_id, chunk_id, round(list_cosine_similarity(query, embedding), 6) AS score FROM query_vectors JOIN e ON e.video_id = query_video),
b AS (SELECT query_id, chunk_id, score FROM p WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1)
SELECT q.query_id, CASE q.query_id // 20 % 3 WHEN 0 THEN earliest WHEN 1 THEN latest ELSE b.chunk_id END AS resolved, round(b.score, 5) AS score
FROM query_vectors q JOIN x ON x.video_id = q.query_video LEFT JOIN b USING (query_id)"""


#: What a reference by looks has of its entity's vector; the first is found at 0.6 and not at 0.75, the second not at all.
MIXED = (0.68, 0.5, 0.9)


def reference_resolution(spark, sf_dir):
    """References with all four cues to entities of their video.  Those by looks are mixed of their own vector and of the
    video's first entity's, so that their scores lie below, between and above the two thresholds."""
    chunks = X.chunks(spark, sf_dir)
    rows = chunks.where("chunk_id % 20 > 0")
    ents = rows.select("video_id", F.col("chunk_id").alias("entity_id"), F.col("start_ms").alias("first_ms"), F.col("end_ms").alias("last_ms"))
    refs = F.array(*map(F.lit, _CUES))
    asked = chunks.where("chunk_id % 20 = 0").select("video_id", F.col("chunk_id").alias("anchor_id"), F.col("start_ms").alias("anchor_ms"), "embedding")
    asked = asked.withColumn("reference", F.get(refs, (F.col("anchor_id") / 20 % 4).cast("int")))
    first = rows.groupBy("video_id").agg(F.min_by("embedding", "chunk_id").alias("target"))
    share = F.get(F.array(*map(F.lit, MIXED)), (F.col("anchor_id") / 80 % 3).cast("int"))
    mixed = F.transform(F.arrays_zip(F.col("target").alias("t"), F.col("embedding").alias("e")), lambda x: share * x["t"].cast("double") + F.sqrt(1 - share * share) * x["e"].cast("double"))
    looks = asked.join(first, "video_id").select(F.col("anchor_id").alias("query_id"), F.col("video_id").alias("query_video"), mixed.alias("query"))
    similar = E.best_entity(search.vector_topk(rows, looks, 1, E.RESOLVE, same_video=True).drop("rank"), E.RESOLVE, key="chunk_id").withColumnRenamed("query_id", "anchor_id")
    recent = E.entity_asof(asked, ents).select("anchor_id", F.col("entity_id").alias("recent"))
    known = asked.join(E.extremes(ents), "video_id").join(recent, "anchor_id", "left").join(similar, "anchor_id", "left")
    found = E.resolve(F.col("reference"), F.col("anchor_ms"), F.col("recent"), F.col("earliest"), F.col("latest"), F.col("chunk_id"))
    return known.select("anchor_id", "video_id", "reference", found.alias("resolved"), F.round("score", 5).alias("score"))


RESOLUTION_SQL = f"""WITH {X.CHUNKS}, e AS (SELECT * FROM chunks WHERE chunk_id % 20 > 0), a AS (SELECT * FROM chunks WHERE chunk_id % 20 = 0),
x AS (SELECT video_id, arg_min(chunk_id, (start_ms, chunk_id)) AS earliest, arg_min(chunk_id, (-end_ms, chunk_id)) AS latest, arg_min(embedding, chunk_id) AS target FROM e GROUP BY 1),
w AS (SELECT a.chunk_id, a.video_id, a.start_ms, x.earliest, x.latest, x.target, a.embedding, {list(MIXED)}[a.chunk_id // 80 % 3 + 1]::DOUBLE AS w FROM a JOIN x USING (video_id)),
m AS (SELECT *, list_transform(range(1, len(target) + 1), lambda i: w * target[i] + sqrt(1 - w * w) * embedding[i]) AS q FROM w),
p AS (SELECT m.chunk_id AS anchor_id, e.chunk_id, round(list_cosine_similarity(m.q, e.embedding), 6) AS score FROM m JOIN e USING (video_id)),
b AS (SELECT * FROM p WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, chunk_id) = 1),
l AS (SELECT video_id, end_ms, min(chunk_id) AS entity_id FROM e GROUP BY ALL),
r AS (SELECT m.*, l.entity_id AS recent FROM m ASOF LEFT JOIN l ON m.video_id = l.video_id AND m.start_ms >= l.end_ms)
SELECT r.chunk_id AS anchor_id, r.video_id, ['{"', '".join(_CUES)}'][r.chunk_id // 20 % 4 + 1] AS reference,
  coalesce(CASE r.chunk_id // 20 % 4 WHEN 0 THEN CASE WHEN r.start_ms > 0 THEN recent END WHEN 1 THEN earliest WHEN 2 THEN latest END, b.chunk_id) AS resolved, round(b.score, 5) AS score
FROM r LEFT JOIN b ON b.anchor_id = r.chunk_id"""


def gate_similarity(spark, sf_dir):
    """The gate's verdict on given signals, with and without a similarity and speech."""
    n = F.col("l_linenumber")
    rows = X.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", n, F.when(n % 3 > 0, F.col("l_discount").cast("double") * 10).alias("sim"), (F.col("l_tax").cast("double") * 5).alias("key"),
        (F.col("l_quantity").cast("double") / 50).alias("cover"), (n / 7).alias("span"), F.when(n != 5, F.col("l_partkey") % 60).alias("chars"),
    )
    r, relation, confidence = align.gate(*(F.col(c) for c in ("sim", "key", "cover", "span", "chars")))
    return rows.select("l_orderkey", "l_linenumber", "sim", F.round(r, 9).alias("relevance"), relation.alias("relation"), F.round(confidence, 9).alias("confidence"))


_unit = lambda x: f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"
_S, _K, _C = _unit(f"(sim - {align.SIM_FLOOR}) / {align.SIM_SPAN}"), _unit(f"key / {align.KEY_FULL}"), _unit(f"cover / {align.COVER_FULL}")
SIGNALS_SQL = f"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_discount::DOUBLE * 10 END AS sim, l_tax::DOUBLE * 5 AS key, l_quantity::DOUBLE / 50 AS cover,
  l_linenumber::DOUBLE / 7 AS span, CASE WHEN l_linenumber <> 5 THEN l_partkey % 60 END AS chars FROM lineitem),
g AS (SELECT *, (CASE WHEN sim IS NOT NULL THEN 0.45::DOUBLE * {_S} + 0.30::DOUBLE * {_K} + 0.25::DOUBLE * {_C} ELSE 0.55::DOUBLE * {_K} + 0.45::DOUBLE * {_C} END) * (1 - 0.35::DOUBLE * {_unit(f"span / {align.SPAN_FULL}")}) AS r FROM t)
SELECT l_orderkey, l_linenumber, sim, round(r, 9) AS relevance,
  CASE WHEN chars IS NULL OR chars < {align.LEAST_CHARS} THEN 'unknown' WHEN r >= {align.STRONG} THEN 'strong' WHEN r >= {align.CONTEXTUAL} THEN 'contextual' WHEN r >= {align.UNSURE} THEN 'unknown' ELSE 'independent' END AS relation,
  round(least(0.95::DOUBLE, CASE WHEN chars IS NULL THEN 0.0 WHEN chars < {align.LEAST_CHARS} THEN 0.3 WHEN r >= {align.STRONG} THEN 0.55 + 0.4 * (r - {align.STRONG}) / (1 - {align.STRONG})
    WHEN r >= {align.CONTEXTUAL} THEN 0.45 + 0.25 * (r - {align.CONTEXTUAL}) / ({align.STRONG} - {align.CONTEXTUAL}) WHEN r >= {align.UNSURE} THEN 0.35 ELSE 0.5 + 0.3 * ({align.UNSURE} - r) / {align.UNSURE} END), 9) AS confidence FROM g"""


QUERIES = {
    "scene_overview": (scene_overview, OVERVIEW_SQL),
    "boundary_confirmed": (boundary_confirmed, CONFIRMED_SQL),
    "fallback_scenes": (fallback_scenes, FALLBACK_SQL),
    "timeline_bars": (timeline_bars, BARS_SQL),
    "frame_sizes": (frame_sizes, FRAME_SQL),
    "recent_files": (recent_files, RECENT_SQL),
    "entity_constraint": (entity_constraint, ENTITY_SQL),
    "validity": (validity, VALID_SQL),
    "replies_and_links": (replies_and_links, LINKS_SQL),
    "reference_similar": (reference_similar, REFERENCE_SQL),
    "reference_resolution": (reference_resolution, RESOLUTION_SQL),
    "gate_similarity": (gate_similarity, SIGNALS_SQL),
}
