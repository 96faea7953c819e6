"""Search, fusion and overlap removal over the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoreel.functions import questions as Q
from chronoreel.functions import vectors
from chronoreel.operators import search
from chronoreel.schema import chunk_type_name
from chronoreel.sources import fixtures as X

_NAMES = "['SceneSummary', 'SpeechSegment', 'Event', 'FrameDesc', 'QAcache', 'SceneAudio', 'SceneFused']"


def _chunks(spark, sf_dir):
    return X.chunks(spark, sf_dir)


def vector_topk(spark, sf_dir):
    """Filtered cosine top-5 in the text collection for each stated query."""
    found = search.vector_topk(search.search_filter(_chunks(spark, sf_dir), collection=1), X.query_vectors(spark, sf_dir), 5)
    return found.select("query_id", "chunk_id", "score", "rank")


def vector_topk_time_filter(spark, sf_dir):
    """The same in a time window, one chunk type, with a score floor."""
    inside = search.search_filter(_chunks(spark, sf_dir), start_gte=10_000, end_lte=80_000, chunk_type=3)
    return search.vector_topk(inside, X.query_vectors(spark, sf_dir), 5, min_score=0.05).select("query_id", "chunk_id", "score", "rank")


def vector_topk_same_video(spark, sf_dir):
    """Top-3 within the query's own video, over all collections."""
    found = search.vector_topk(_chunks(spark, sf_dir), X.query_vectors(spark, sf_dir), 3, same_video=True)
    return found.select("query_id", "chunk_id", "score", "rank")


def _topk_sql(where: str, k: int, least: float) -> str:
    return f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS},
scored AS (SELECT query_id, chunk_id, round(list_cosine_similarity(embedding, query), 6) AS score
           FROM query_vectors, chunks WHERE {where}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
           FROM scored WHERE score >= {least})
SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= {k}"""


def qa_cache_lookup(spark, sf_dir):
    """The best cached answer of the query's video, and whether it is close enough to serve."""
    cached = search.search_filter(_chunks(spark, sf_dir), collection=3)
    asked = X.query_vectors(spark, sf_dir)
    best = search.vector_topk(cached, asked, 1, same_video=True)
    out = asked.join(best, "query_id", "left")
    return out.select("query_id", "chunk_id", "score", F.coalesce(F.col("score") >= 0.88, F.lit(False)).alias("hit"))


QA_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS},
scored AS (SELECT query_id, chunk_id, round(list_cosine_similarity(embedding, query), 6) AS score
           FROM query_vectors, chunks WHERE collection = 3 AND video_id = query_video),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored WHERE score >= 0)
SELECT q.query_id, b.chunk_id, b.score, coalesce(b.score >= 0.88, false) AS hit
FROM query_vectors q LEFT JOIN best b ON b.query_id = q.query_id AND b.r = 1"""


def l2_normalize(spark, sf_dir):
    unit = vectors.l2_normalize(F.col("embedding"))
    rows = X.table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u"))
    return rows.select("vec_id", F.round(vectors.norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"), F.size("u").cast("long").alias("dims"))


L2_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM e),
u AS (SELECT vec_id, CASE WHEN len > 1e-8 THEN list_transform(v, lambda x: x / len) ELSE v END AS u FROM n)
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length, round(u[1], 6) AS first, CAST(len(u) AS BIGINT) AS dims FROM u"""


def _two_paths(spark, sf_dir):
    asked = X.query_vectors(spark, sf_dir)
    out = None
    for path, number, weight in (("text", 1, 0.4), ("visual", 3, 0.4), ("entity", 2, 0.2)):
        hits = search.vector_topk(_chunks(spark, sf_dir).where(F.col("collection") >= (1 if path == "text" else number)), asked, 10)
        part = hits.select("query_id", "chunk_id", "score", "rank", F.lit(weight).alias("weight"), F.lit(path).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


_PATHS_SQL = f"""{X.CHUNKS}, {X.QUERY_VECTORS},
paths AS (SELECT * FROM (VALUES ('text', 1, 0.4::DOUBLE), ('visual', 3, 0.4::DOUBLE), ('entity', 2, 0.2::DOUBLE)) t(path, least, weight)),
scored AS (SELECT query_id, chunk_id, path, weight, round(list_cosine_similarity(embedding, query), 6) AS score
           FROM query_vectors, paths, chunks WHERE collection >= least),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score >= 0),
hits AS (SELECT * FROM ranked WHERE rank <= 10)"""


def rrf_fusion(spark, sf_dir):
    return search.rrf(_two_paths(spark, sf_dir), "query_id", "chunk_id").select("query_id", "chunk_id", "score")


RRF_SQL = f"WITH {_PATHS_SQL} SELECT query_id, chunk_id, round(sum(weight / (60 + rank)), 9) AS score FROM hits GROUP BY ALL"


def rrf_hit_path(spark, sf_dir):
    """The same hits with scores weighted by path, so that paths differ."""
    rows = _two_paths(spark, sf_dir).withColumn("score", F.round(F.col("score") * F.when(F.col("path") == "entity", (F.col("chunk_id") % 3).cast("double")).otherwise(F.lit(1.0)), 6))
    return search.hit_path(rows, "query_id", "chunk_id").select("query_id", "chunk_id", "hit_path")


HIT_PATH_SQL = f"""WITH {_PATHS_SQL},
w AS (SELECT query_id, chunk_id, path, round(score * CASE WHEN path = 'entity' THEN (chunk_id % 3)::DOUBLE ELSE 1.0 END, 6) AS s FROM hits),
p AS (SELECT query_id, chunk_id, max(s) FILTER (path = 'entity') AS e, max(s) FILTER (path = 'text') AS t, max(s) FILTER (path = 'visual') AS v FROM w GROUP BY ALL)
SELECT query_id, chunk_id,
  CASE WHEN e IS NOT NULL THEN CASE WHEN v > e THEN 'visual' WHEN t > e THEN 'text' ELSE 'entity' END
       WHEN t IS NOT NULL THEN CASE WHEN v > t THEN 'visual' ELSE 'text' END
       ELSE 'visual' END AS hit_path FROM p"""


def evidence_reweight(spark, sf_dir):
    hits = search.vector_topk(search.search_filter(_chunks(spark, sf_dir), collection=1), X.query_vectors(spark, sf_dir), 10)
    named = hits.join(_chunks(spark, sf_dir).select("chunk_id", chunk_type_name(F.col("chunk_type")).alias("chunk_type")), "chunk_id")
    q = F.col("query_id")
    asked = named.withColumns({"prefers_visual": q % 60 == 0, "prefers_audio": q % 60 == 20, "prefers_fused": q % 60 == 40})
    return search.prefer_evidence(asked).select("query_id", "chunk_id", "chunk_type", "score", "rank")


_WEIGHT_SQL = """CASE chunk_type
  WHEN 'SceneSummary' THEN CASE WHEN pv THEN 1.15 WHEN pa THEN 0.75 ELSE 1.0 END
  WHEN 'SceneAudio' THEN CASE WHEN pa THEN 1.15 WHEN pv THEN 0.70 ELSE 0.95 END
  WHEN 'SpeechSegment' THEN CASE WHEN pa THEN 1.20 WHEN pv THEN 0.70 ELSE 1.0 END
  WHEN 'SceneFused' THEN CASE WHEN pf THEN 1.10 ELSE 1.0 END ELSE 1.0 END::DOUBLE"""
REWEIGHT_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS},
scored AS (SELECT query_id, chunk_id, {_NAMES}[chunk_type + 1] AS chunk_type, round(list_cosine_similarity(embedding, query), 6) AS s
           FROM query_vectors, chunks WHERE collection = 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM scored WHERE s >= 0),
asked AS (SELECT *, query_id % 60 = 0 AS pv, query_id % 60 = 20 AS pa, query_id % 60 = 40 AS pf FROM hits WHERE r <= 10),
w AS (SELECT query_id, chunk_id, chunk_type, round(s * {_WEIGHT_SQL}, 9) AS score FROM asked)
SELECT query_id, chunk_id, chunk_type, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM w"""


def overlap_dedup(spark, sf_dir):
    kept = search.remove_overlaps(X.dedup_candidates(spark, sf_dir))
    return kept.select("query_id", "chunk_id", "chunk_type", "rank")


_FOLD_SQL = """fold(query_id, n, kept) AS (
  SELECT query_id, CAST(1 AS BIGINT), [{k: chunk_id, t: chunk_type, s: start_ms, e: end_ms}] FROM cand WHERE rank = 1
  UNION ALL
  SELECT f.query_id, f.n + 1, CASE WHEN len(list_filter(f.kept, lambda y: y.t = c.chunk_type AND least(c.end_ms - c.start_ms, y.e - y.s) > 0 AND
      greatest(0, least(c.end_ms, y.e) - greatest(c.start_ms, y.s))::DOUBLE / greatest(1, least(c.end_ms - c.start_ms, y.e - y.s)) > 0.7)) > 0
    THEN f.kept ELSE list_append(f.kept, {k: c.chunk_id, t: c.chunk_type, s: c.start_ms, e: c.end_ms}) END
  FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.rank = f.n + 1),
final AS (SELECT query_id, kept FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1)"""
DEDUP_SQL = f"""WITH RECURSIVE {X.DEDUP_CANDIDATES}, cand AS (SELECT query_id, chunk_id, chunk_type, start_ms, end_ms, rank FROM dedup_candidates),
{_FOLD_SQL}
SELECT query_id, kept[i].k AS chunk_id, kept[i].t AS chunk_type, CAST(i AS INTEGER) AS rank FROM (SELECT query_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM final)"""


def _asked(spark, sf_dir):
    """Each stated query with one of the literal questions' intents."""
    texts = F.array(*map(F.lit, QUESTIONS))
    asked = X.query_vectors(spark, sf_dir).withColumn("question", F.get(texts, (F.col("query_id") / 20 % len(QUESTIONS)).cast("int")))
    return asked.withColumns({k: v for k, v in Q.intent(F.col("question")).items()})


def multi_path_retrieve(spark, sf_dir):
    """Intent, paths, re-weighting, fusion and overlap removal, best five."""
    named = _chunks(spark, sf_dir).withColumn("chunk_type", chunk_type_name(F.col("chunk_type")))
    return search.retrieve(named, _asked(spark, sf_dir)).select("query_id", "chunk_id", "chunk_type", "score", "rank")


# The literal questions.
QUESTIONS = (
    "这个视频讲了什么",
    "什么时候出现红色汽车",
    "现在画面里有什么",
    "那个穿红衣服的人是谁",
    "他为什么离开",
    "出现了几次",
    "他说了什么",
    "视频后半部分发生了什么",
    "左上角是什么",
    "持续了多久",
    "如果他没走会怎样",
    "他在做什么",
    "有几个人",
    "hello",
    "画面里的人说了什么",
)


def _questions_sql() -> str:
    rows = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))
    return f"questions AS (SELECT * FROM (VALUES {rows}) t(qno, question))"


def _intent_sql() -> str:
    m = lambda p: f"regexp_matches(question, '{p}')"
    return f"""{_questions_sql()},
flags AS (SELECT *, {m(Q.VISUAL_CUES)} AS needs_visual, {m(Q.TEXT_CUES)} OR NOT {m(Q.VISUAL_CUES)} AS needs_text, {m(Q.ENTITY_CUES)} AS has_entity,
  {m(Q.VISUAL_ONLY)} AS sees, {m(Q.AUDIO_ONLY)} AS hears, {m(Q.NARRATIVE)} AS tells FROM questions),
intents AS (SELECT qno, question, needs_text, needs_visual, has_entity,
  CASE WHEN needs_visual AND NOT needs_text THEN 0.2 WHEN NOT needs_visual AND needs_text THEN 0.7 ELSE 0.4 END::DOUBLE AS w_text,
  CASE WHEN needs_visual AND NOT needs_text THEN 0.7 WHEN NOT needs_visual AND needs_text THEN 0.2 ELSE 0.4 END::DOUBLE AS w_visual,
  CASE WHEN needs_visual AND needs_text THEN 0.2 ELSE 0.1 END::DOUBLE AS w_entity,
  sees AND NOT hears AS prefers_visual, hears AND NOT sees AS prefers_audio,
  tells OR (sees = hears) AS prefers_fused FROM flags)"""


RETRIEVE_SQL = f"""WITH RECURSIVE {X.CHUNKS}, {X.QUERY_VECTORS}, {_intent_sql()},
asked AS (SELECT q.*, i.* FROM query_vectors q JOIN intents i ON i.qno = (q.query_id // 20) % {len(QUESTIONS)}),
raw AS (SELECT query_id, chunk_id, {_NAMES}[chunk_type + 1] AS chunk_type, collection, round(list_cosine_similarity(embedding, query), 6) AS s,
    needs_text, needs_visual, has_entity, w_text, w_visual, w_entity, prefers_visual AS pv, prefers_audio AS pa, prefers_fused AS pf
  FROM asked, chunks WHERE (collection = 1 AND needs_text) OR (collection = 0 AND needs_visual) OR (collection = 2 AND has_entity)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY s DESC, chunk_id) AS r FROM raw WHERE s >= 0),
cut AS (SELECT *, CASE WHEN collection = 1 THEN round(s * {_WEIGHT_SQL}, 9) ELSE s END AS s2 FROM top WHERE r <= CASE collection WHEN 2 THEN 5 ELSE 10 END),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY s2 DESC, chunk_id) AS r2 FROM cut),
fused AS (SELECT query_id, chunk_id, round(sum(CASE collection WHEN 1 THEN w_text WHEN 0 THEN w_visual ELSE w_entity END / (60 + r2)), 9) AS score FROM again GROUP BY ALL),
cand AS (SELECT f.query_id, f.chunk_id, f.score, {_NAMES}[c.chunk_type + 1] AS chunk_type, c.start_ms, c.end_ms,
    row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.chunk_id) AS rank FROM fused f JOIN chunks c USING (chunk_id)),
{_FOLD_SQL},
kept AS (SELECT query_id, kept[i].k AS chunk_id, CAST(i AS INTEGER) AS rank FROM (SELECT query_id, kept, unnest(range(1, least(5, len(kept)) + 1)) AS i FROM final))
SELECT k.query_id, k.chunk_id, c.chunk_type, c.score, k.rank FROM kept k JOIN cand c USING (query_id, chunk_id)"""


def _asked_messages(spark, sf_dir):
    """Every message as a question; all but each sixteenth end in one of the stated ones, as no cue occurs in the texts."""
    rows = X.messages(spark, sf_dir)
    n = (F.col("conversation_id") * 7 + F.col("seq")) % (len(QUESTIONS) + 1)
    return rows.select("conversation_id", "seq", F.concat_ws(" ", "content", F.get(F.array(*map(F.lit, QUESTIONS)), n.cast("int"))).alias("question"))


_ASKED_MESSAGES_SQL = f"""{X.MESSAGES}, stated AS (SELECT [{", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS)}] AS q),
asked AS (SELECT conversation_id, seq, concat_ws(' ', content, q[(conversation_id * 7 + seq) % {len(QUESTIONS) + 1} + 1]) AS question FROM messages, stated)"""


def message_class(spark, sf_dir):
    return _asked_messages(spark, sf_dir).select("conversation_id", "seq", Q.question_class(F.col("question")).alias("question_class"))


MESSAGE_CLASS_SQL = f"WITH {_ASKED_MESSAGES_SQL} SELECT conversation_id, seq, CASE " + " ".join(f"WHEN regexp_matches(question, '{p}') THEN '{n}'" for n, p in Q.QUESTION_RULES) + " ELSE 'Unknown' END AS question_class FROM asked"


def message_intent(spark, sf_dir):
    return _asked_messages(spark, sf_dir).select("conversation_id", "seq", *(c.alias(n) for n, c in Q.intent(F.col("question")).items()))


MESSAGE_INTENT_SQL = f"""WITH {_ASKED_MESSAGES_SQL}, questions AS (SELECT conversation_id * 1000 + seq AS qno, question FROM asked),
{_intent_sql().removeprefix(_questions_sql()).lstrip(", ")}
SELECT qno // 1000 AS conversation_id, qno % 1000 AS seq, needs_text, needs_visual, has_entity, w_text, w_visual, w_entity, prefers_visual, prefers_audio, prefers_fused FROM intents"""


def player_command(spark, sf_dir):
    """Messages that would drive the player rather than ask about the video."""
    rows = X.messages(spark, sf_dir)
    # every third message carries a command, as none occurs in the texts
    said = F.when(F.col("seq") % 3 == 0, F.concat(F.col("content"), F.lit(" Go  to 0:30"))).when(F.col("seq") % 3 == 1, F.concat(F.col("content"), F.lit("replay 跳转")))
    return rows.select("conversation_id", "seq", Q.is_player_command(F.coalesce(said, F.col("content"))).alias("is_command"))


COMMAND_SQL = rf"""WITH {X.MESSAGES} SELECT conversation_id, seq, regexp_matches(content || CASE seq % 3 WHEN 0 THEN ' Go  to 0:30' WHEN 1 THEN 'replay 跳转' ELSE '' END,
  '(?i)\b{Q.PLAYER_WORDS}\b') AS is_command FROM messages"""

QUERIES = {
    "vector_topk": (vector_topk, _topk_sql("collection = 1", 5, 0)),
    "vector_topk_time_filter": (vector_topk_time_filter, _topk_sql("start_ms >= 10000 AND end_ms <= 80000 AND chunk_type = 3", 5, 0.05)),
    "vector_topk_same_video": (vector_topk_same_video, _topk_sql("video_id = query_video", 3, 0)),
    "qa_cache_lookup": (qa_cache_lookup, QA_SQL),
    "l2_normalize": (l2_normalize, L2_SQL),
    "rrf_fusion": (rrf_fusion, RRF_SQL),
    "rrf_hit_path": (rrf_hit_path, HIT_PATH_SQL),
    "evidence_reweight": (evidence_reweight, REWEIGHT_SQL),
    "overlap_dedup": (overlap_dedup, DEDUP_SQL),
    "multi_path_retrieve": (multi_path_retrieve, RETRIEVE_SQL),
    "message_class": (message_class, MESSAGE_CLASS_SQL),
    "message_intent": (message_intent, MESSAGE_INTENT_SQL),
    "player_command": (player_command, COMMAND_SQL),
}
