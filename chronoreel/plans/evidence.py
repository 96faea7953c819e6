"""Entity profiles, cached answers, retrieval by more paths, merged evidence, alike frames, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoreel.functions import questions as Q
from chronoreel.operators import evidence as V
from chronoreel.operators import search
from chronoreel.sources import fixtures as X


def _profiles(spark, sf_dir):
    """An entity for each (user, event type), with an appearance for each event."""
    e = F.col("event_id")
    box = F.struct(*((e % n).cast("double").alias(c) for c, n in (("x", 7), ("y", 5), ("w", 3), ("h", 4))))
    seen = F.struct(X.ts_ms(F.col("ts")).alias("timestamp_ms"), e.alias("event_id"), (e % 50).alias("scene_id"), F.concat(F.lit("seen "), e.cast("string")).alias("description"), box.alias("bbox"))
    rows = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id"), F.col("event_type").alias("entity_id")).agg(F.array_sort(F.collect_list(seen)).alias("appearances"))
    named = rows.withColumn("description", F.concat(F.lit("a "), "entity_id")).withColumn("aliases", F.array(F.lit("it"), F.upper("entity_id")))
    return named.withColumn("entity_type", F.when(F.col("video_id") % 3 == 0, "person").when(F.col("video_id") % 3 == 1, "object").otherwise("alien"))


def entity_store(spark, sf_dir):
    """Entities written as JSON rows and read back."""
    written = V.encode_entities(_profiles(spark, sf_dir))
    back = V.decode_entities(written.withColumn("json_md5", F.md5("appearances_json")))
    boxed = F.size(F.filter("appearances", lambda a: a["bbox"].isNotNull()))
    return back.select("video_id", "entity_id", "entity_type", "json_md5", F.size("appearances").alias("n"), boxed.alias("n_boxed"), F.element_at("appearances", 1)["scene_id"].alias("first_scene"), F.element_at("aliases", 2).alias("other_name"))


_ONE = """'{"scene_id":' || event_id % 50 || ',"timestamp_ms":' || epoch_us(ts) // 1000 || ',"description":"seen ' || event_id || '"' || CASE WHEN event_id % 3 > 0 AND event_id % 4 > 0
  THEN ',"bbox":{"x":' || (event_id % 7) || '.0,"y":' || (event_id % 5) || '.0,"w":' || (event_id % 3) || '.0,"h":' || (event_id % 4) || '.0}' ELSE '' END || '}'"""
STORE_SQL = f"""SELECT user_id AS video_id, event_type AS entity_id, CASE user_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'object' ELSE 'unknown' END AS entity_type,
  md5('[' || string_agg({_ONE}, ',' ORDER BY epoch_us(ts) // 1000, event_id) || ']') AS json_md5, count(*)::INT AS n, count(*) FILTER (event_id % 3 > 0 AND event_id % 4 > 0)::INT AS n_boxed,
  arg_min(event_id % 50, (epoch_us(ts) // 1000, event_id)) AS first_scene, upper(event_type) AS other_name FROM events GROUP BY user_id, event_type"""


def entity_profile_chunks(spark, sf_dir):
    return V.entity_chunks(_profiles(spark, sf_dir))


PROFILE_SQL = """SELECT md5('entity_profiles|' || user_id || '|' || event_type) AS chunk_id, user_id AS video_id, event_type AS entity_id, 'entity_profiles' AS collection,
  min(epoch_us(ts) // 1000) AS start_ms, max(epoch_us(ts) // 1000) AS end_ms, 'a ' || event_type || ' it ' || upper(event_type) AS text FROM events GROUP BY user_id, event_type"""


def qa_cache_chunks(spark, sf_dir):
    """Question and answer turns as chunks, with the vector of the conversation's number, if there is one."""
    rows = X.messages(spark, sf_dir)
    answer = F.lead("content").over(Window.partitionBy("conversation_id").orderBy("seq"))
    both = rows.withColumn("answer", answer).where("role = 'user' and answer is not null and content is not null")
    asked = F.when(F.col("seq") % 3 == 0, F.concat("content", F.lit(" Go  to 0:30"))).otherwise(F.col("content"))
    vectors = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conversation_id"), "embedding")
    said = both.join(vectors, "conversation_id", "left").select(
        F.col("conversation_id").alias("video_id"), "seq", asked.alias("question"), "answer", ((F.col("conversation_id") % 10) / 10.0).alias("confidence"),
        F.array(F.col("seq"), F.col("seq") + 1).alias("evidence_scene_ids"), F.lit(1000).cast("long").alias("cached_ms"), "embedding",
    )
    meta = F.from_json("metadata_json", "question string, confidence double, evidence_scene_ids array<long>")
    out = V.answers_to_chunks(said).withColumn("m", meta)
    return out.select("video_id", "seq", "chunk_type", "start_ms", "end_ms", F.md5("text").alias("text_md5"), F.md5("m.question").alias("question_md5"), F.col("m.confidence").alias("confidence"), F.element_at("m.evidence_scene_ids", 2).alias("last_scene"), F.size("embedding").alias("dims"))


CACHE_CHUNKS_SQL = rf"""WITH {X.MESSAGES}, b AS (SELECT *, lead(content) OVER (PARTITION BY conversation_id ORDER BY seq) AS answer FROM messages),
q AS (SELECT b.*, content || CASE WHEN seq % 3 = 0 THEN ' Go  to 0:30' ELSE '' END AS question, len(embedding)::INT AS dims FROM b JOIN embeddings ON vec_id = conversation_id)
SELECT conversation_id AS video_id, seq, 'QAcache' AS chunk_type, 0::BIGINT AS start_ms, 0::BIGINT AS end_ms, md5('Q: ' || question || chr(10) || 'A: ' || answer) AS text_md5, md5(question) AS question_md5,
  ((conversation_id % 10) / 10.0)::DOUBLE AS confidence, (seq + 1)::BIGINT AS last_scene, dims FROM q
WHERE role = 'user' AND answer IS NOT NULL AND content IS NOT NULL AND (conversation_id % 10) / 10.0 >= 0.6 AND NOT regexp_matches(question, '(?i)\b{Q.PLAYER_WORDS}\b')"""

#: Two questions that stand alone and one that points back.
ASKED = ("刚才那个人是谁", "穿红衣服的人", "what is shown")


def qa_cache_strict(spark, sf_dir):
    """The nearest cached answer of the query's video, and whether the strict rules serve it."""
    asked = X.query_vectors(spark, sf_dir)
    best = search.vector_topk(search.search_filter(X.chunks(spark, sf_dir), collection=0), asked, 1, same_video=True).drop("rank")
    question = F.get(F.array(*map(F.lit, ASKED)), (F.col("query_id") % 3).cast("int"))
    served = V.may_serve(question, F.col("score"), (F.col("chunk_id") % 200) / 200, F.array(F.col("chunk_id") % 7, F.lit(1).cast("long")), F.array(F.floor(F.col("query_id") / 20) % 3))
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", "chunk_id", "score", served.alias("served"))


STRICT_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS},
scored AS (SELECT query_id, chunk_id, round(list_cosine_similarity(embedding, query), 6) AS score FROM query_vectors, chunks WHERE collection = 0 AND video_id = query_video),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored WHERE score >= 0)
SELECT q.query_id, b.chunk_id, b.score, coalesce(q.query_id % 3 > 0 AND score >= 0.95 AND (chunk_id % 200) / 200 >= 0.8 AND list_has_any([chunk_id % 7, 1], [(q.query_id // 20) % 3]), false) AS served
FROM query_vectors q LEFT JOIN best b ON b.query_id = q.query_id AND b.r = 1"""


def evidence_merged(spark, sf_dir):
    """Text, cached-answer and time-window paths fused by rank; hits that share time become one with a higher score."""
    chunks, asked = X.chunks(spark, sf_dir), X.query_vectors(spark, sf_dir)
    about = ("video_id", "start_ms", "end_ms")
    start = F.col("query_id") % 97 * 1000
    windows = asked.select("query_id", F.col("query_video").alias("video_id"), start.alias("from_ms"), (start + 6000).alias("to_ms"))
    lists = (
        (0.5, search.vector_topk(search.search_filter(chunks, collection=1), asked, 10, carry=about)),
        (0.3, V.qa_path(search.search_filter(chunks, collection=0), asked, carry=about)),
        (0.2, V.window_path(chunks, windows, 10)),
    )
    first, *others = (hits.select("query_id", "chunk_id", *about, F.lit(w).alias("weight"), "rank") for w, hits in lists)
    for hits in others:
        first = first.unionByName(hits)
    return V.merge_evidence(search.rrf(first, "query_id", "chunk_id", *about))


_WITHIN = "PARTITION BY query_id, video_id ORDER BY start_ms, end_ms, chunk_id"
MERGED_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS},
scored AS (SELECT query_id, chunk_id, video_id, start_ms, end_ms, collection, query_video, round(list_cosine_similarity(embedding, query), 6) AS score FROM query_vectors, chunks WHERE collection <= 1),
tx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE collection = 1 AND score >= 0),
qa AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE collection = 0 AND video_id = query_video AND score >= 0.85),
w AS (SELECT *, query_id % 97 * 1000 AS f, query_id % 97 * 1000 + 6000 AS t FROM query_vectors),
tm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (least(end_ms, t) - greatest(start_ms, f)) / least(end_ms - start_ms, t - f) DESC, start_ms, chunk_id) AS rank
  FROM w JOIN chunks ON video_id = query_video WHERE least(end_ms, t) > greatest(start_ms, f)),
hits AS (SELECT query_id, chunk_id, video_id, start_ms, end_ms, 0.5::DOUBLE AS weight, rank FROM tx WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, video_id, start_ms, end_ms, 0.3, rank FROM qa WHERE rank <= 3
  UNION ALL SELECT query_id, chunk_id, video_id, start_ms, end_ms, 0.2, rank FROM tm WHERE rank <= 10),
fused AS (SELECT query_id, chunk_id, video_id, start_ms, end_ms, round(sum(weight / (60 + rank)), 9) AS score FROM hits GROUP BY ALL),
m AS (SELECT *, coalesce(start_ms >= max(end_ms) OVER ({_WITHIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM fused),
g AS (SELECT *, sum(fresh) OVER ({_WITHIN} ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT query_id, video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(chunk_id, (-score, chunk_id)) AS chunk_id, round(sum(score), 9) AS score, count(*) AS n FROM g GROUP BY query_id, video_id, run"""


def alike_frames(spark, sf_dir):
    """Runs of alike vectors of each label; the bound is low, as the table's vectors are far apart."""
    rows = X.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("frame_id"), "embedding")
    return V.alike_runs(rows, 0.1)


ALIKE_SQL = """WITH e AS (SELECT CAST(label AS BIGINT) AS video_id, vec_id AS frame_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT *, coalesce(list_cosine_similarity(lag(v) OVER (PARTITION BY video_id ORDER BY frame_id), v) <= 0.1, true)::INT AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m)
SELECT video_id, run, min(frame_id) AS first_id, max(frame_id) AS last_id, count(*) AS n FROM g GROUP BY video_id, run"""


def adaptive_points(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, V.POINT_KINDS)), (F.col("event_id") % 4).cast("int"))
    return V.sample_points(X.frames(spark, sf_dir).select("video_id", (F.floor(F.col("ts_ms") / 86_400_000) * 86_400_000).alias("ts_ms"), kind.alias("kind"), F.col("signal").alias("score")), 8)


POINTS_SQL = f"""WITH {X.FRAMES}, p AS (SELECT video_id, ts_ms // 86400000 * 86400000 AS ts_ms, event_id % 4 AS k, signal AS score FROM frames),
s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY k, score DESC) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k, score DESC, ts_ms)::INT AS place FROM s)
SELECT video_id, ts_ms, ['scene', 'motion', 'audio', 'entropy'][k + 1] AS kind, score, place FROM o WHERE place <= 8"""

CLASSES = ("GlobalSummary", "TemporalLocalization", "EntityQuery", "ActionRecognition", "CausalReasoning", "CurrentFrame", "Counting", "Comparison", "Unknown")


def sampling_ranges(spark, sf_dir):
    """Ranges around the five best hits of each stated query; every seventh is known well enough."""
    asked, q = X.query_vectors(spark, sf_dir), F.col("query_id")
    hits = search.vector_topk(X.chunks(spark, sf_dir), asked, 5, min_score=0.3, same_video=True, carry=("start_ms", "end_ms"))
    named = F.get(F.array(*map(F.lit, CLASSES)), (F.floor(q / 20) % 9).cast("int"))
    rows = asked.select("query_id", named.alias("question_class"), F.lit(60_000).cast("long").alias("duration_ms"), F.when(q % 40 == 0, 1000).otherwise(-1).cast("long").alias("position_ms"), (q % 140 == 0).alias("enough"))
    return V.sampling_ranges(rows, hits)


RANGES_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS},
q AS (SELECT *, (query_id // 20) % 9 AS c, query_id % 140 = 0 AS enough FROM query_vectors),
scored AS (SELECT query_id, chunk_id, start_ms, end_ms, round(list_cosine_similarity(embedding, query), 6) AS score FROM query_vectors, chunks WHERE video_id = query_video),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score >= 0.3),
r AS (SELECT q.query_id, c, enough, rank, start_ms AS s, end_ms AS e FROM q LEFT JOIN h ON h.query_id = q.query_id AND NOT enough AND ((c BETWEEN 1 AND 3 AND rank <= 5) OR (c = 4 AND rank = 1)))
SELECT query_id, NOT enough AS need_new, coalesce(rank, 1)::INT AS place,
  CASE WHEN enough THEN NULL WHEN c IN (0, 5) OR (c = 1 AND s IS NULL) THEN 'sparse' WHEN c = 8 THEN 'medium' ELSE 'dense' END AS density,
  CASE WHEN enough THEN NULL WHEN c IN (0, 8) THEN 8 WHEN c IN (1, 4) THEN 10 WHEN c IN (2, 3) THEN 12 WHEN c = 5 THEN 3 ELSE 20 END::INT AS budget,
  CASE WHEN enough THEN NULL WHEN c = 5 THEN CASE WHEN query_id % 40 = 0 THEN 0 END WHEN s IS NULL THEN 0 ELSE greatest(0, s - CASE c WHEN 4 THEN 10000 ELSE 2000 END) END::BIGINT AS start_ms,
  CASE WHEN enough THEN NULL WHEN c = 5 THEN CASE WHEN query_id % 40 = 0 THEN 4000 END WHEN s IS NULL THEN 60000 ELSE least(60000, e + CASE c WHEN 4 THEN 5000 ELSE 2000 END) END::BIGINT AS end_ms FROM r"""

QUERIES = {
    "entity_store": (entity_store, STORE_SQL),
    "entity_profile_chunks": (entity_profile_chunks, PROFILE_SQL),
    "qa_cache_chunks": (qa_cache_chunks, CACHE_CHUNKS_SQL),
    "qa_cache_strict": (qa_cache_strict, STRICT_SQL),
    "evidence_merged": (evidence_merged, MERGED_SQL),
    "alike_frames": (alike_frames, ALIKE_SQL),
    "adaptive_points": (adaptive_points, POINTS_SQL),
    "sampling_ranges": (sampling_ranges, RANGES_SQL),
}
