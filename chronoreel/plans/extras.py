"""Merging, budgets, timelines, keyword ranking, evaluation and tool-call assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoreel.operators import extras as X2
from chronoreel.operators import search
from chronoreel.plans.scenes import keywords_sql
from chronoreel.sources import fixtures as X


def merge_adjacent(spark, sf_dir):
    rows = X.frames(spark, sf_dir).select("video_id", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 7_200_000).alias("end_ms"), "event_id")
    return X2.merge_adjacent(rows, ["video_id"], 3_600_000, "event_id")


MERGE_SQL = f"""WITH {X.FRAMES}, r AS (SELECT video_id, ts_ms AS s, ts_ms + 7200000 AS e, event_id FROM frames),
m AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT video_id, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n FROM n GROUP BY video_id, run"""


def token_budget(spark, sf_dir):
    rows = X.table(spark, sf_dir, "documents").select("lang", "doc_id", F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"))
    return X2.within_budget(rows, "lang", F.col("tokens"), 15_000, F.col("tokens"), F.col("doc_id")).select("lang", "doc_id", "spent")


TOKEN_SQL = """SELECT lang, doc_id, spent FROM (SELECT lang, doc_id, CAST(sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) OVER (PARTITION BY lang ORDER BY ceil(n_chars / 4.0), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM documents) WHERE spent <= 15000"""


def interleaved_timeline_whole(spark, sf_dir):
    """Speech and scenes by time, with whole texts."""
    said = X.segments(spark, sf_dir).select("video_id", "start_ms", F.col("seg_idx").alias("seq"), "text")
    seen = X.seg_scenes(spark, sf_dir).select("video_id", "start_ms", F.col("scene_id").alias("seq"), F.concat(F.lit("scene "), F.col("scene_id").cast("string")).alias("text"))
    return X2.timeline(("speech", said), ("scene", seen))


TIMELINE_WHOLE_SQL = f"""WITH {X.SEGMENTS}, {X.SEG_SCENES} SELECT video_id, start_ms, 'speech' AS kind, seg_idx AS seq, text FROM segments
UNION ALL SELECT video_id, start_ms, 'scene', scene_id, 'scene ' || scene_id FROM seg_scenes"""


def keyword_search(spark, sf_dir):
    return X2.keyword_hits(X.table(spark, sf_dir, "documents"), "doc_id", "text", ["thent", "oner", "hahe", "with", "edst", "erere"], 20)


KEYWORD_SQL = f"""WITH k AS (SELECT doc_id, len(list_intersect(list_distinct({keywords_sql("text")}), ['thent', 'oner', 'hahe', 'edst', 'erere']))::INT AS hits FROM documents)
SELECT doc_id, hits FROM k WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 20"""


def bm25_rank(spark, sf_dir):
    """Every benchmark item against every document that shares a keyword: score sums by item."""
    items = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = X2.bm25(X.table(spark, sf_dir, "documents"), items)
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total"), F.round(F.max("score"), 6).alias("best"))


BM25_SQL = f"""WITH k AS (SELECT doc_id, {keywords_sql("text")} AS k FROM documents), l AS (SELECT doc_id, len(k) AS length FROM k),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(k) AS term FROM k) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
n AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
q AS (SELECT item_id AS query_id, unnest(list_distinct({keywords_sql("text")})) AS term FROM benchmark),
s AS (SELECT q.query_id, t.doc_id, sum(ln(1 + (n.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.length / n.mean))) AS score
  FROM q JOIN t USING (term) JOIN d USING (term) JOIN l USING (doc_id), n GROUP BY ALL)
SELECT query_id, count(*) AS n, round(sum(score), 3) AS total, round(max(score), 6) AS best FROM s GROUP BY 1"""


def recall_at_k(spark, sf_dir):
    """Recall at ten with chunks of the query's label as the truth."""
    chunks, asked = X.chunks(spark, sf_dir), X.query_vectors(spark, sf_dir)
    hits = search.vector_topk(chunks, asked, 10)
    truth = asked.join(chunks.select("chunk_id", "video_id"), F.col("query_video") == F.col("video_id")).select("query_id", "chunk_id")
    return X2.recall_at_k(hits, truth).select("query_id", F.round("recall", 9).alias("recall"))


RECALL_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS},
s AS (SELECT query_id, chunk_id, query_video = video_id AS same, round(list_cosine_similarity(embedding, query), 6) AS score FROM query_vectors, chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score >= 0 THEN score ELSE -9 END DESC, chunk_id) AS r FROM s)
SELECT query_id, round(count(*) FILTER (same AND r <= 10 AND score >= 0)::DOUBLE / count(*) FILTER (same), 9) AS recall FROM r GROUP BY 1"""


def time_expression(spark, sf_dir):
    q = F.when(F.col("turn") % 3 == 0, "视频后半部分发生了什么").when(F.col("turn") % 3 == 1, "前半段呢").otherwise(F.col("text"))
    start, end = X2.half_of_video(q, F.col("conv_id") * 1001)
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", start.cast("long").alias("from_ms"), end.cast("long").alias("to_ms"))


TIME_SQL = """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN conv_id * 1001 // 2 ELSE 0 END AS from_ms, CASE WHEN turn % 3 = 1 THEN conv_id * 1001 // 2 ELSE conv_id * 1001 END AS to_ms FROM conversations"""


def speech_pieces(spark, sf_dir):
    rows = X2.semantic_segments(X.segments(spark, sf_dir))
    return rows.select("video_id", "start_ms", "end_ms", "n", F.md5("text").alias("text_md5"))


PIECES_SQL = rf"""WITH RECURSIVE {X.SEGMENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, seg_idx, end_ms, text) AS r FROM segments),
f(video_id, r, piece, s0, e0, txt) AS (
  SELECT video_id, r, 1, start_ms, end_ms, text FROM s WHERE r = 1
  UNION ALL
  SELECT s.video_id, s.r, CASE WHEN cut THEN piece + 1 ELSE piece END, CASE WHEN cut THEN start_ms ELSE s0 END, CASE WHEN cut THEN end_ms ELSE greatest(e0, end_ms) END, CASE WHEN cut THEN text ELSE txt || ' ' || text END
  FROM (SELECT s.*, f.piece, f.s0, f.e0, f.txt, (f.e0 - f.s0 >= 15000 AND (s.start_ms - f.e0 >= 800 OR regexp_matches(f.txt, '[.。!?！？]\s*$'))) OR s.end_ms - f.s0 > 30000 AS cut FROM f JOIN s ON s.video_id = f.video_id AND s.r = f.r + 1) s),
p AS (SELECT video_id, piece, count(*) AS n, max(r) AS r FROM f GROUP BY ALL)
SELECT p.video_id, f.s0 AS start_ms, f.e0 AS end_ms, p.n::INT AS n, md5(f.txt) AS text_md5 FROM p JOIN f USING (video_id, piece, r)"""


def _whole_deltas(spark, sf_dir):
    """Messages as deltas of five slots: whole contents, and more calls than the limit of three."""
    rows = X.messages(spark, sf_dir)
    s = F.col("seq")
    return rows.select(
        F.col("conversation_id").alias("message_id"),
        (s % 5).cast("int").alias("slot"),
        "seq",
        F.when(s < 5, F.concat(F.lit("call_"), s.cast("string"))).alias("id"),
        F.when(s < 5, F.col("role")).alias("name"),
        F.col("content").alias("arguments"),
        F.when(s > 4, F.lit("tool_calls")).otherwise("").alias("finish"),
    )


def tool_call_assembly_whole(spark, sf_dir):
    """The first three calls of each message with whole arguments."""
    calls = X2.limit_calls(X2.assemble_calls(_whole_deltas(spark, sf_dir)), 3)
    return calls.select("message_id", "slot", "id", "name", "arguments", "finish")


ASSEMBLY_WHOLE_SQL = f"""WITH {X.MESSAGES}, d AS (SELECT conversation_id AS message_id, (seq % 5)::INT AS slot, seq, CASE WHEN seq < 5 THEN 'call_' || seq END AS id, CASE WHEN seq < 5 THEN role END AS name, content AS a, CASE WHEN seq > 4 THEN 'tool_calls' END AS f FROM messages),
c AS (SELECT message_id, slot, arg_max(id, seq) FILTER (id IS NOT NULL) AS id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, string_agg(a, '' ORDER BY seq) AS arguments, arg_max(f, seq) FILTER (f IS NOT NULL) AS finish FROM d GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY slot) <= 3"""

QUERIES = {
    "merge_adjacent": (merge_adjacent, MERGE_SQL),
    "token_budget": (token_budget, TOKEN_SQL),
    "interleaved_timeline_whole": (interleaved_timeline_whole, TIMELINE_WHOLE_SQL),
    "keyword_search": (keyword_search, KEYWORD_SQL),
    "bm25_rank": (bm25_rank, BM25_SQL),
    "recall_at_k": (recall_at_k, RECALL_SQL),
    "time_expression": (time_expression, TIME_SQL),
    "speech_pieces": (speech_pieces, PIECES_SQL),
    "tool_call_assembly_whole": (tool_call_assembly_whole, ASSEMBLY_WHOLE_SQL),
}
