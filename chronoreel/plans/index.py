"""Index lifecycle, summaries, entities and conversation tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoreel.functions import vectors
from chronoreel.operators import entities as E
from chronoreel.operators import index as I  # noqa: E741
from chronoreel.operators import search
from chronoreel.schema import chunk_type_name
from chronoreel.sources import fixtures as X

NOW_MS = 1_706_000_000_000  # 2024-01-23 08:53:20 UTC


def _indexed(spark, sf_dir):
    """Chunks with times of indexing and a file path for some."""
    c = X.chunks(spark, sf_dir).drop("embedding")
    created = F.lit(NOW_MS) - F.col("chunk_id") * 7_000_000
    path = F.when(F.col("chunk_id") % 11 == 3, F.concat(F.lit("/videos/v"), F.col("video_id").cast("string"), F.lit("_"), F.col("chunk_id").cast("string"), F.lit(".mp4")))
    return c.withColumn("chunk_type", chunk_type_name(F.col("chunk_type"))).withColumn("created_ms", created).withColumn("file_path", path)


_INDEXED = f"""{X.CHUNKS}, indexed AS (SELECT chunk_id, video_id, collection, start_ms, end_ms,
  ['SceneSummary', 'SpeechSegment', 'Event', 'FrameDesc', 'QAcache', 'SceneAudio', 'SceneFused'][chunk_type + 1] AS chunk_type, {NOW_MS} - chunk_id * 7000000 AS created_ms,
  CASE WHEN chunk_id % 11 = 3 THEN '/videos/v' || video_id || '_' || chunk_id || '.mp4' END AS file_path FROM chunks)"""


def video_summary_rollup(spark, sf_dir):
    return I.video_summary(_indexed(spark, sf_dir))


SUMMARY_SQL = f"""WITH {_INDEXED}, g AS (SELECT video_id, count(*) FILTER (collection = 0) AS n_visual, count(*) FILTER (collection = 1) AS n_text, count(*) FILTER (collection = 3) AS n_qa,
  max(created_ms) AS last_indexed, bool_or(collection = 1 AND chunk_type = 'SceneSummary') AS described FROM indexed GROUP BY 1),
p AS (SELECT video_id, file_path FROM indexed WHERE collection <> 2 AND file_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY CASE collection WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, chunk_id) = 1)
SELECT video_id, n_visual, n_text, n_qa, n_visual + n_text + n_qa AS total, CASE WHEN described THEN 2 WHEN n_text > 0 THEN 1 WHEN n_visual > 0 THEN 0 ELSE -1 END AS level, last_indexed,
  coalesce(string_split(file_path, '/')[-1], left(video_id::VARCHAR, 16) || '...') AS file_name FROM g LEFT JOIN p USING (video_id)"""


def collection_counts(spark, sf_dir):
    return I.collection_counts(_indexed(spark, sf_dir))


def videos_by_recency(spark, sf_dir):
    return I.by_recency(X.frames(spark, sf_dir), "video_id", "ts_ms")


def collection_browser(spark, sf_dir):
    """The cached answers, in time order."""
    rows = search.search_filter(_indexed(spark, sf_dir), collection=3)
    return rows.orderBy("start_ms", "chunk_id").select("chunk_id", "video_id", "chunk_type", "start_ms", "end_ms")


def latest_upsert(spark, sf_dir):
    """Events replace each other on (user, type): the latest stays whole."""
    rows = X.table(spark, sf_dir, "events").select("user_id", "event_type", X.ts_ms(F.col("ts")).alias("ts_ms"), "event_id", "value")
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return I.upsert(old, new, ["user_id", "event_type"], "ts_ms", "event_id")


UPSERT_SQL = """SELECT user_id, event_type, epoch_us(ts) // 1000 AS ts_ms, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) = 1"""


def recent_files_merge(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events")
    opened = rows.select(F.col("user_id").alias("path"), X.ts_ms(F.col("ts")).alias("opened_at"), F.floor(F.col("value") - 200).cast("long").alias("duration_ms"))
    return I.merge_recent(opened)


RECENT_SQL = """WITH o AS (SELECT user_id AS path, epoch_us(ts) // 1000 AS opened_at, floor(value - 200)::BIGINT AS d FROM events),
p AS (SELECT path, d FROM o WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY opened_at DESC, d DESC) = 1)
SELECT path, max(opened_at) AS last_opened, coalesce(any_value(p.d), 0) AS duration_ms FROM o LEFT JOIN p USING (path) GROUP BY path"""


def recent_n(spark, sf_dir):
    return I.recent(recent_files_merge(spark, sf_dir), 60).select("path", "last_opened")


RECENT_N_SQL = "SELECT user_id AS path, max(epoch_us(ts) // 1000) AS last_opened FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60"


def stale_cleanup(spark, sf_dir):
    """What is left of each collection, and how much went."""
    rows = _indexed(spark, sf_dir)
    left = I.drop_stale(rows, NOW_MS, 30, "created_ms").groupBy("collection").agg(F.count(F.lit(1)).alias("kept"))
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).join(left, "collection", "left").select("collection", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"))


STALE_SQL = f"""WITH {_INDEXED} SELECT collection, count(*) FILTER (created_ms >= {NOW_MS - 30 * 86_400_000}) AS kept, count(*) FILTER (created_ms < {NOW_MS - 30 * 86_400_000}) AS removed FROM indexed GROUP BY 1"""


def invalidate_video(spark, sf_dir):
    rows = I.delete_collection(I.delete_video(_indexed(spark, sf_dir), 3), 4, 0)
    return rows.select("chunk_id", "video_id", "collection")


def cascade_delete(spark, sf_dir):
    """Messages left after conversations that hold a system message are deleted."""
    rows = X.messages(spark, sf_dir)
    gone = rows.where("role = 'system'").select("conversation_id").distinct()
    parents = rows.select("conversation_id").distinct()
    return I.cascade_delete(parents, rows, gone, "conversation_id")[1].select("conversation_id", "seq")


CASCADE_SQL = f"WITH {X.MESSAGES} SELECT conversation_id, seq FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages s WHERE s.conversation_id = m.conversation_id AND s.role = 'system')"


def history_last4_whole(spark, sf_dir):
    """The last four messages with their whole content."""
    rows = X.messages(spark, sf_dir).where("role <> 'system'")
    return I.last_per_key(rows, "conversation_id", "seq", 4).select("conversation_id", "seq", "role", "content")


HISTORY_WHOLE_SQL = f"WITH {X.MESSAGES} SELECT conversation_id, seq, role, content FROM messages WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 4"


def history_seed(spark, sf_dir):
    """Each conversation's history without system messages, as one ordered text."""
    rows = X.messages(spark, sf_dir).where("role <> 'system'")
    line = F.concat("role", F.lit(": "), "content")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(parts, "\n")).alias("history_md5"))


SEED_SQL = f"WITH {X.MESSAGES} SELECT conversation_id, count(*) AS n, md5(string_agg(role || ': ' || content, chr(10) ORDER BY seq)) AS history_md5 FROM messages WHERE role <> 'system' GROUP BY 1"


def anti_append(spark, sf_dir):
    """Parts already listed, and those found in line items that aren't."""
    listed = X.table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("path"), F.lit("listed").alias("origin"))
    found = X.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path")).distinct().withColumn("origin", F.lit("found"))
    return I.append_missing(listed, found, "path")


ANTI_SQL = """SELECT p_partkey AS path, 'listed' AS origin FROM part WHERE p_size < 20
UNION ALL SELECT DISTINCT l_partkey, 'found' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size < 20 AND p_partkey = l_partkey)"""


def search_box(spark, sf_dir):
    rows = X.table(spark, sf_dir, "customer")
    return I.search_box(rows, "Ing", "c_name", "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment")


SEARCH_SQL = "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_name), 'ing') OR contains(lower(c_mktsegment), 'ing') OR contains(c_custkey::VARCHAR, 'ing')"


def current_generation(spark, sf_dir):
    """Orders of each customer's last year only, as of superseded tasks."""
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("generation"))
    return I.current_generation(rows, "o_custkey", "generation")


GENERATION_SQL = """WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS generation FROM orders)
SELECT o.* FROM o JOIN (SELECT o_custkey, max(generation) AS g FROM o GROUP BY 1) t ON t.o_custkey = o.o_custkey AND t.g = o.generation"""


def first_frame(spark, sf_dir):
    """The first frame of each video, the one that is shown."""
    first = F.min_by(F.struct("event_id", "signal"), F.struct("ts_ms", "event_id")).alias("f")
    return X.frames(spark, sf_dir).groupBy("video_id").agg(F.min("ts_ms").alias("ts_ms"), first).select("video_id", "ts_ms", "f.event_id", "f.signal")


FIRST_SQL = f"WITH {X.FRAMES} SELECT video_id, ts_ms, event_id, signal FROM frames QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ts_ms, event_id) = 1"


def source_fallback(spark, sf_dir):
    """The first file path of text, visual and cached chunks of each video."""
    return video_summary_rollup(spark, sf_dir).select("video_id", "file_name")


def entity_best_match(spark, sf_dir):
    """The entity (one a label: its first vector) most like each stated query, over all videos."""
    firsts = X.chunks(spark, sf_dir).groupBy("video_id").agg(F.min_by("embedding", "chunk_id").alias("embedding")).withColumnRenamed("video_id", "entity_id")
    asked = X.query_vectors(spark, sf_dir)
    scored = search.vector_topk(firsts, asked, 1, min_score=-1.0, key="entity_id")
    return E.best_entity(scored.drop("rank"), least=0.1).select("query_id", "entity_id", "score")


BEST_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS}, firsts AS (SELECT video_id AS entity_id, arg_min(embedding, chunk_id) AS v FROM chunks GROUP BY 1),
s AS (SELECT query_id, entity_id, round(list_cosine_similarity(v, query), 6) AS score FROM query_vectors, firsts)
SELECT query_id, entity_id, score FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) = 1) WHERE score >= 0.1"""


def _entities(spark, sf_dir):
    """An entity for each (user, event type): first and last time."""
    rows = X.table(spark, sf_dir, "events")
    return rows.groupBy(F.col("user_id").alias("video_id"), F.col("event_type").alias("entity_id")).agg(F.min(X.ts_ms(F.col("ts"))).alias("first_ms"), F.max(X.ts_ms(F.col("ts"))).alias("last_ms"))


_ENTITIES = "entities AS (SELECT user_id AS video_id, event_type AS entity_id, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY ALL)"


def entity_asof(spark, sf_dir):
    anchors = X.frames(spark, sf_dir).select("video_id", F.col("event_id").alias("anchor_id"), F.col("ts_ms").alias("anchor_ms"))
    return E.entity_asof(anchors, _entities(spark, sf_dir))


ASOF_SQL = f"""WITH {_ENTITIES}, {X.FRAMES},
e AS (SELECT video_id, last_ms, min(entity_id) AS entity_id FROM entities GROUP BY ALL)
SELECT a.video_id, a.event_id AS anchor_id, e.entity_id, e.last_ms FROM frames a ASOF LEFT JOIN e ON a.video_id = e.video_id AND a.ts_ms >= e.last_ms"""

# Literal references.
REFERENCES = ("刚才的那个人", "开头的人", "最后的那辆车", "穿红衣服的人")


def entity_resolve(spark, sf_dir):
    """Every event's time as an anchor of one of four literal references."""
    refs = F.array(*map(F.lit, REFERENCES))
    anchors = X.frames(spark, sf_dir).select("video_id", F.col("event_id").alias("anchor_id"), F.col("ts_ms").alias("anchor_ms"))
    anchors = anchors.withColumn("reference", F.get(refs, (F.col("anchor_id") % 4).cast("int")))
    ents = _entities(spark, sf_dir)
    rows = anchors.join(E.entity_asof(anchors, ents).drop("video_id", "last_ms"), "anchor_id").join(E.extremes(ents), "video_id")
    found = E.resolve(F.col("reference"), F.col("anchor_ms"), F.col("entity_id"), F.col("earliest"), F.col("latest"), F.lit("similar"))
    return rows.select("video_id", "anchor_id", found.alias("resolved"))


RESOLVE_SQL = f"""WITH {_ENTITIES}, {X.FRAMES}, e AS (SELECT video_id, last_ms, min(entity_id) AS entity_id FROM entities GROUP BY ALL),
x AS (SELECT video_id, arg_min(entity_id, (first_ms, entity_id)) AS earliest, arg_min(entity_id, (-last_ms, entity_id)) AS latest FROM entities GROUP BY 1),
a AS (SELECT a.video_id, a.event_id AS anchor_id, e.entity_id AS recent FROM frames a ASOF LEFT JOIN e ON a.video_id = e.video_id AND a.ts_ms >= e.last_ms)
SELECT video_id, anchor_id, CASE anchor_id % 4 WHEN 0 THEN coalesce(recent, 'similar') WHEN 1 THEN earliest WHEN 2 THEN latest ELSE 'similar' END AS resolved FROM a JOIN x USING (video_id)"""


def entity_next_id(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.lit("_"), (F.col("event_id") % 997).cast("string")).alias("entity_id"))
    return rows.groupBy("user_id").agg(E.next_suffix(F.col("entity_id")).cast("long").alias("next_id"))


NEXT_SQL = "SELECT user_id, max(event_id % 997) + 1 AS next_id FROM events GROUP BY 1"


def entity_cluster(spark, sf_dir):
    """Online clustering of each label's vectors in id order, and every entity's appearances."""
    rows = X.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("desc_id"), (F.col("vec_id") * 1000).alias("ts_ms"), F.lit("person").alias("entity_type"), "embedding")
    return E.appearances(E.cluster(rows, 0.3))


def qa_cache_insert(spark, sf_dir):
    """Answers worth caching among question-and-answer turns."""
    rows = X.messages(spark, sf_dir)
    answer = F.lead("content").over(Window.partitionBy("conversation_id").orderBy("seq"))
    both = rows.withColumn("answer", answer).where("role = 'user' and answer is not null")
    confidence = (F.col("conversation_id") % 10) / 10.0
    kept = both.where(I.cacheable(F.col("content").rlike("(?i)play"), confidence, F.array(F.lit(1.0))))
    return kept.select("conversation_id", "seq", F.md5(I.qa_chunk(F.col("content"), F.col("answer"))).alias("text_md5"))


INSERT_SQL = f"""WITH {X.MESSAGES}, b AS (SELECT *, lead(content) OVER (PARTITION BY conversation_id ORDER BY seq) AS answer FROM messages)
SELECT conversation_id, seq, md5('Q: ' || content || chr(10) || 'A: ' || answer) AS text_md5 FROM b WHERE role = 'user' AND answer IS NOT NULL AND NOT regexp_matches(content, '(?i)play') AND (conversation_id % 10) / 10.0 >= 0.6"""


def vector_badges(spark, sf_dir):
    rows = X.table(spark, sf_dir, "embeddings")
    held = lambda m: F.when(F.col("vec_id") % m == 0, F.col("embedding"))
    from chronoreel.functions.text import vector_badge

    unit = F.round(vectors.norm(F.col("embedding")), 6)
    return rows.select("vec_id", vector_badge(held(2), held(3)).alias("badge"), unit.alias("length"))


BADGE_SQL = """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'T' ELSE '' END || CASE WHEN vec_id % 3 = 0 THEN 'V' ELSE '' END AS badge,
round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length FROM embeddings"""

QUERIES = {
    "video_summary_rollup": (video_summary_rollup, SUMMARY_SQL),
    "collection_counts": (collection_counts, f"WITH {_INDEXED} SELECT video_id, collection, count(*) AS n FROM indexed GROUP BY ALL"),
    "videos_by_recency": (videos_by_recency, f"WITH {X.FRAMES} SELECT video_id, max(ts_ms) AS ts_ms FROM frames GROUP BY 1 ORDER BY 2 DESC, 1"),
    "collection_browser": (collection_browser, f"WITH {_INDEXED} SELECT chunk_id, video_id, chunk_type, start_ms, end_ms FROM indexed WHERE collection = 3 ORDER BY start_ms, chunk_id"),
    "latest_upsert": (latest_upsert, UPSERT_SQL),
    "recent_files_merge": (recent_files_merge, RECENT_SQL),
    "recent_n": (recent_n, RECENT_N_SQL),
    "stale_cleanup": (stale_cleanup, STALE_SQL),
    "invalidate_video": (invalidate_video, f"WITH {_INDEXED} SELECT chunk_id, video_id, collection FROM indexed WHERE video_id <> 3 AND NOT (video_id = 4 AND collection = 0)"),
    "cascade_delete": (cascade_delete, CASCADE_SQL),
    "history_last4_whole": (history_last4_whole, HISTORY_WHOLE_SQL),
    "history_seed": (history_seed, SEED_SQL),
    "anti_append": (anti_append, ANTI_SQL),
    "search_box": (search_box, SEARCH_SQL),
    "current_generation": (current_generation, GENERATION_SQL),
    "first_frame": (first_frame, FIRST_SQL),
    "source_fallback": (source_fallback, f"WITH s AS ({SUMMARY_SQL}) SELECT video_id, file_name FROM s"),
    "entity_best_match": (entity_best_match, BEST_SQL),
    "entity_asof": (entity_asof, ASOF_SQL),
    "entity_resolve": (entity_resolve, RESOLVE_SQL),
    "entity_next_id": (entity_next_id, NEXT_SQL),
    "entity_cluster": (entity_cluster, None),
    "qa_cache_insert": (qa_cache_insert, INSERT_SQL),
    "vector_badges": (vector_badges, BADGE_SQL),
}
