"""Queries whose rows take branches that the plain ones don't: near vectors, ideographs, chosen vectors, defaults, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoreel import schema
from chronoreel.functions import questions as Q
from chronoreel.functions import text as TX

from chronoreel.operators import evidence as V
from chronoreel.operators import extras as X2
from chronoreel.operators import index as I
from chronoreel.operators import search
from chronoreel.plans import retrieval as R
from chronoreel.plans.scenes import _STOPS, keywords_sql
from chronoreel.schema import chunk_type_name
from chronoreel.sources import fixtures as X

#: What a mixed vector has of the other one, by turns.
MIXED = (0.95, 0.9, 0.5)


def _mixed(target, own, share):
    pairs = F.arrays_zip(target.alias("t"), own.alias("e"))
    return F.transform(pairs, lambda x: share * x["t"].cast("double") + F.sqrt(1 - share * share) * x["e"].cast("double"))


def _mixed_sql(target, own, share):
    return f"list_transform(range(1, len({target}) + 1), lambda i: {share} * {target}[i] + sqrt(1 - {share} * {share}) * {own}[i])"


def qa_cache_hits(spark, sf_dir):
    """Questions that are near to the first cached answer of their video, by turns nearer and farther than the bound."""
    cached = search.search_filter(X.chunks(spark, sf_dir), collection=3)
    first = cached.groupBy("video_id").agg(F.min_by("embedding", "chunk_id").alias("t"))
    share = F.get(F.array(*map(F.lit, MIXED)), (F.col("query_id") / 20 % 3).cast("int"))
    asked = X.query_vectors(spark, sf_dir).join(first, F.col("query_video") == F.col("video_id"))
    asked = asked.select("query_id", "query_video", _mixed(F.col("t"), F.col("query"), share).alias("query"))
    best = search.vector_topk(cached, asked, 1, same_video=True)
    return asked.join(best, "query_id", "left").select("query_id", "chunk_id", "score", F.coalesce(F.col("score") >= 0.88, F.lit(False)).alias("hit"))


QA_HITS_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS}, c AS (SELECT * FROM chunks WHERE collection = 3), f AS (SELECT video_id, arg_min(embedding, chunk_id) AS t FROM c GROUP BY 1),
w AS (SELECT *, {list(MIXED)}[query_id // 20 % 3 + 1]::DOUBLE AS w FROM query_vectors JOIN f ON video_id = query_video),
a AS (SELECT query_id, query_video, {_mixed_sql("t", "query", "w")} AS query FROM w),
s AS (SELECT query_id, chunk_id, round(list_cosine_similarity(embedding, query), 6) AS score FROM a JOIN c ON c.video_id = query_video),
b AS (SELECT * FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1)
SELECT a.query_id, b.chunk_id, b.score, coalesce(b.score >= 0.88, false) AS hit FROM a LEFT JOIN b USING (query_id)"""


def alike_near(spark, sf_dir):
    """Runs of frames at the real bound: two of three frames are mixed with the video's first one."""
    rows = X.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("frame_id"), "embedding")
    first = rows.groupBy("video_id").agg(F.min_by("embedding", "frame_id").alias("t"))
    near = F.when(F.col("frame_id") % 3 > 0, _mixed(F.col("t"), F.col("embedding"), F.lit(0.99))).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    return V.alike_runs(rows.join(first, "video_id").select("video_id", "frame_id", near.alias("embedding")))


ALIKE_NEAR_SQL = f"""WITH e AS (SELECT CAST(label AS BIGINT) AS video_id, vec_id AS frame_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT video_id, arg_min(v, frame_id) AS t FROM e GROUP BY 1),
n AS (SELECT video_id, frame_id, CASE WHEN frame_id % 3 > 0 THEN {_mixed_sql("t", "v", "0.99::DOUBLE")} ELSE v END AS v FROM e JOIN f USING (video_id)),
m AS (SELECT *, coalesce(list_cosine_similarity(lag(v) OVER (PARTITION BY video_id ORDER BY frame_id), v) <= 0.95, true)::INT AS fresh FROM n),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m)
SELECT video_id, run, min(frame_id) AS first_id, max(frame_id) AS last_id, count(*) AS n FROM g GROUP BY video_id, run"""


#: Put before and behind the documents' texts, which have no ideographs.
SAID = ("红色的汽车停在路边", "的", "画面显示一个人正在跑步", "雨", "ABC汽车2号线x", "时间，地点。人物", "")


def keywords_mixed(spark, sf_dir):
    """Keywords of documents with ideographs around and inside: how many, how many unlike, the first and the last in order."""
    said = lambda n: F.get(F.array(*map(F.lit, SAID)), F.pmod(n, F.lit(len(SAID))).cast("int"))
    d = F.col("doc_id")
    words = X.table(spark, sf_dir, "documents").select(d, TX.keywords(F.concat(said(d), F.coalesce("text", F.lit("")), said(F.floor(d / 7)))).alias("k"))
    return words.select("doc_id", F.size("k").cast("long").alias("n"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"), F.array_min("k").alias("first"), F.array_max("k").alias("last"))


_CJK = r"[\x{4E00}-\x{9FFF}]"


def mixed_keywords_sql(text: str) -> str:
    """Keywords with pairs of ideographs."""
    runs = rf"regexp_extract_all(regexp_replace(coalesce({text}, ''), '({_CJK}+)', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
    pairs = "CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END"
    return f"list_filter(flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^{_CJK}') THEN {pairs} WHEN length(r) >= 2 THEN [lower(r)] ELSE [] END)), lambda w: NOT list_contains({_STOPS}, w))"


_SAID_SQL = "['" + "', '".join(SAID) + "']"
KEYWORDS_MIXED_SQL = f"""WITH t AS (SELECT doc_id, {_SAID_SQL}[doc_id % {len(SAID)} + 1] || coalesce(text, '') || {_SAID_SQL}[doc_id // 7 % {len(SAID)} + 1] AS t FROM documents), k AS (SELECT doc_id, {mixed_keywords_sql("t")} AS k FROM t)
SELECT doc_id, CAST(len(k) AS BIGINT) AS n, CAST(len(list_distinct(k)) AS BIGINT) AS n_distinct, list_min(k) AS first, list_max(k) AS last FROM k"""


def vector_by_collection(spark, sf_dir):
    """The five nearest chunks over all collections, frames by their own vector (here the text's reversed)."""
    chunks = X.chunks(spark, sf_dir)
    chosen = chunks.withColumn("embedding", search.vector_of(F.col("collection"), F.reverse("embedding"), F.col("embedding")))
    return search.vector_topk(chosen, X.query_vectors(spark, sf_dir), 5, carry=("collection",))


BY_COLLECTION_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS}, s AS (SELECT query_id, chunk_id, collection, round(list_cosine_similarity(CASE WHEN collection = 0 THEN list_reverse(embedding) ELSE embedding END, query), 6) AS score FROM query_vectors, chunks),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE score >= 0) SELECT query_id, chunk_id, collection, score, rank FROM r WHERE rank <= 5"""


def numbered_evidence(spark, sf_dir):
    """The three nearest chunks of each question's video as the text that a model is handed."""
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = search.vector_topk(X.chunks(spark, sf_dir), X.query_vectors(spark, sf_dir), 3, same_video=True, carry=("collection", "start_ms", "end_ms")).join(docs, "chunk_id", "left")
    c = F.col("chunk_id")
    path = F.get(F.array(*map(F.lit, ("visual", "text", "entity", "qa_cache"))), F.when(c % 11 > 0, F.col("collection")))
    hits = hits.select(
        "query_id", "rank", F.coalesce(path, F.lit("other")).alias("hit_path"), "score", (F.col("start_ms") * 60).alias("start_ms"), (F.col("end_ms") * 60).alias("end_ms"), F.when(c % 3 > 0, c % 50).alias("scene_id"),
        F.when(c % 4 > 0, "fused").otherwise("").alias("evidence_type"), F.when(c % 5 > 0, "strong").alias("audio_relation"), (c % 8 / 10).alias("relation_confidence"), F.when(c % 6 > 0, F.col("text")).alias("text"),
    )
    return V.evidence_text(hits).select("query_id", "n", F.md5("evidence").alias("evidence_md5"))


_TIME = lambda c: f"CASE WHEN {c} >= 3600000 THEN {c} // 3600000 || ':' || lpad(({c} // 60000 % 60)::VARCHAR, 2, '0') ELSE ({c} // 60000 % 60)::VARCHAR END || ':' || lpad(({c} // 1000 % 60)::VARCHAR, 2, '0')"
EVIDENCE_SQL = f"""WITH {X.CHUNKS}, {X.QUERY_VECTORS}, s AS (SELECT query_id, chunk_id, collection, start_ms * 60 AS a, end_ms * 60 AS z, round(list_cosine_similarity(embedding, query), 6) AS score FROM query_vectors JOIN chunks ON video_id = query_video),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= 0),
l AS (SELECT query_id, rank, '## 证据 ' || rank || chr(10) || '时间范围：' || {_TIME("a")} || ' - ' || {_TIME("z")} || chr(10)
  || '来源：' || CASE WHEN chunk_id % 11 = 0 THEN 'other' ELSE ['视觉检索', '文本/语音', '实体', '历史问答'][collection + 1] END || '（相似度 ' || printf('%.2f', score) || '）' || chr(10)
  || CASE WHEN chunk_id % 3 > 0 THEN '场景 ID：' || chunk_id % 50 || chr(10) ELSE '' END || CASE WHEN chunk_id % 4 > 0 THEN '证据类型：fused' || chr(10) ELSE '' END
  || CASE WHEN chunk_id % 5 > 0 THEN '音画关系：strong（置信度 ' || printf('%.2f', chunk_id % 8 / 10) || '）' || chr(10) ELSE '' END
  || CASE WHEN chunk_id % 6 > 0 AND coalesce(text, '') <> '' THEN '相关内容：' || left(text, 200) || chr(10) || chr(10) ELSE '' END AS line
  FROM h LEFT JOIN documents d ON d.doc_id = h.chunk_id WHERE rank <= 3)
SELECT query_id, count(*) AS n, md5(string_agg(line, '' ORDER BY rank)) AS evidence_md5 FROM l GROUP BY 1"""


LABELS = (" Strong", "CONTEXTUAL\t", "independent", "unknown", "loud", "")
KINDS = ("Person ", "OBJECT", "location", "text", "animal", " ")


def label_codecs(spark, sf_dir):
    """Labels as they are written, taken for what they name; some name nothing."""
    e = F.col("event_id")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), F.when(e % 7 > 0, e % 6).cast("int"))
    relation = schema.from_label(pick(LABELS), ("strong", "contextual", "independent", "unknown"))
    kind = schema.from_label(pick(KINDS), V.ENTITY_TYPES)
    typed = schema.chunk_type_name(schema.chunk_type_ordinal(schema.from_label(F.concat(F.lit(" "), F.upper(chunk_type_name(e % 9))), schema.CHUNK_TYPES, "SceneSummary")))
    return X.table(spark, sf_dir, "events").select("event_id", relation.alias("relation"), kind.alias("kind"), typed.alias("chunk_type"))


CODEC_SQL = f"""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 6 >= 4 THEN 'unknown' ELSE ['strong', 'contextual', 'independent', 'unknown'][event_id % 6 + 1] END AS relation,
  CASE WHEN event_id % 7 = 0 OR event_id % 6 >= 4 THEN 'unknown' ELSE ['person', 'object', 'location', 'text'][event_id % 6 + 1] END AS kind,
  coalesce({R._NAMES}[event_id % 9 + 1], 'SceneSummary') AS chunk_type FROM events"""


def message_json(spark, sf_dir):
    """Messages written as JSON objects with a nested list, and parsed again."""
    c = X.table(spark, sf_dir, "conversations")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("mark").alias("type"), F.when(F.col("turn") % 2 == 0, '"\\ \n').alias("text")))
    written = c.select("conv_id", "turn", F.to_json(F.struct("role", parts.alias("content"), F.when(F.col("turn") % 3 == 0, F.col("turn")).alias("seq"))).alias("j"))
    m = F.from_json("j", "struct<role:string,content:array<struct<type:string,text:string>>,seq:bigint>")
    return written.select("conv_id", "turn", m["role"].alias("role"), F.md5(m["content"][0]["text"]).alias("text_md5"), F.length(m["content"][1]["text"]).alias("n_mark"), m["seq"].alias("seq"))


JSON_SQL = """SELECT conv_id, turn, role, md5(text) AS text_md5, CASE WHEN turn % 2 = 0 THEN 4 END::INT AS n_mark, CASE WHEN turn % 3 = 0 THEN turn END AS seq FROM conversations"""


def chunk_lookup(spark, sf_dir):
    """Points asked by collection and id, of which some don't exist and get the default."""
    wanted = X.table(spark, sf_dir, "events").where("event_id % 3 = 0").select((F.col("event_id") % 4).cast("int").alias("collection"), F.col("event_id").alias("chunk_id")).distinct()
    held = X.chunks(spark, sf_dir).select("collection", "chunk_id", "video_id", "start_ms", "end_ms")
    return search.lookup(held, wanted, start_ms=0, end_ms=0)


LOOKUP_SQL = f"""WITH {X.CHUNKS}, w AS (SELECT DISTINCT CAST(event_id % 4 AS INT) AS collection, event_id AS chunk_id FROM events WHERE event_id % 3 = 0)
SELECT collection, chunk_id, video_id, coalesce(start_ms, 0) AS start_ms, coalesce(end_ms, 0) AS end_ms, video_id IS NOT NULL AS found FROM w LEFT JOIN chunks USING (collection, chunk_id)"""


def conversation_titles(spark, sf_dir):
    """Conversations whose title, and now and then summary, was changed by later turns; every fifth change comes too late."""
    c = X.messages(spark, sf_dir)
    rows = c.groupBy("conversation_id").agg(F.min_by("content", "seq").alias("title"), F.lit("none").alias("summary"), F.lit(100).cast("long").alias("updated_at"))
    at = F.when(F.col("seq") % 5 == 0, F.col("seq")).otherwise(F.col("seq") + 100)
    changes = c.where("seq > 0").select("conversation_id", at.alias("updated_at"), F.when(F.col("seq") % 2 == 0, F.col("content")).alias("title"), F.when(F.col("seq") % 3 == 0, F.col("role")).alias("summary"))
    out = I.update_fields(rows, changes, "conversation_id", "updated_at", "title", "summary")
    return out.select("conversation_id", F.md5("title").alias("title_md5"), "summary", "updated_at")


TITLES_SQL = f"""WITH {X.MESSAGES}, c AS (SELECT *, CASE WHEN seq % 5 = 0 THEN seq ELSE seq + 100 END AS when_ms FROM messages),
r AS (SELECT conversation_id, arg_min(content, seq) AS title FROM c GROUP BY 1),
t AS (SELECT conversation_id, arg_max(content, (when_ms, content)) AS title FROM c WHERE seq > 0 AND seq % 2 = 0 AND when_ms >= 100 GROUP BY 1),
s AS (SELECT conversation_id, arg_max(role, (when_ms, role)) AS summary FROM c WHERE seq > 0 AND seq % 3 = 0 AND when_ms >= 100 GROUP BY 1),
u AS (SELECT conversation_id, max(when_ms) FILTER (seq > 0) AS when_ms FROM c GROUP BY 1)
SELECT conversation_id, md5(coalesce(t.title, r.title)) AS title_md5, coalesce(s.summary, 'none') AS summary, greatest(100, coalesce(u.when_ms, 100)) AS updated_at FROM r LEFT JOIN t USING (conversation_id) LEFT JOIN s USING (conversation_id) LEFT JOIN u USING (conversation_id)"""


def delta_flushes(spark, sf_dir):
    """Each conversation as one answer of which turns are the pieces, 25 ms apart."""
    c = X.messages(spark, sf_dir)
    out = X2.flushes(c.select(F.col("conversation_id").alias("message_id"), "seq", (F.col("seq") * 25).alias("at_ms"), F.col("content").alias("delta")))
    return out.select("message_id", "flush_ms", F.md5("text").alias("text_md5"), "so_far")


FLUSH_SQL = f"""WITH {X.MESSAGES}, f AS (SELECT conversation_id AS message_id, (seq * 25 // 40 + 1) * 40 AS flush_ms, string_agg(content, '' ORDER BY seq, content) AS t FROM messages WHERE coalesce(content, '') <> '' GROUP BY ALL)
SELECT message_id, flush_ms, md5(t) AS text_md5, CAST(sum(length(t)) OVER (PARTITION BY message_id ORDER BY flush_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM f"""


#: Hits that four_path_retrieve returns; a path counts twice as many.
PATHS_K = 5


def _word_path(spark, sf_dir):
    """Benchmark items asked of the texts of the text collection's chunks (the documents of their numbers)."""
    chunks = X.chunks(spark, sf_dir).where("collection = 1").select("chunk_id")
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").join(chunks, "chunk_id", "left_semi")
    items = X.table(spark, sf_dir, "benchmark")
    asked = X.query_vectors(spark, sf_dir).select("query_id").crossJoin(F.broadcast(items.agg((F.max("item_id") + 1).alias("numbers"))))
    asked = asked.join(items, F.col("item_id") == F.floor(F.col("query_id") / 20) % F.col("numbers")).select("query_id", F.col("text").alias("query"))
    return X2.bm25_topk(docs, asked, 2 * PATHS_K, "chunk_id")


def four_path_retrieve(spark, sf_dir):
    """The paths by vectors and one by words; every third question has no vector, as where no encoder runs."""
    chunks = X.chunks(spark, sf_dir).withColumn("chunk_type", chunk_type_name(F.col("chunk_type")))
    number = (F.col("query_id") / 20 % len(R.QUESTIONS)).cast("int")
    asked = X.query_vectors(spark, sf_dir).withColumn("question", F.get(F.array(*map(F.lit, R.QUESTIONS)), number))
    asked = asked.withColumn("query", F.when(F.floor(F.col("query_id") / 20) % 3 > 0, F.col("query")))
    asked = asked.select("query_id", "query", *(c.alias(n) for n, c in Q.intent(F.col("question")).items()))
    return search.retrieve(chunks, asked, PATHS_K, sparse=_word_path(spark, sf_dir))


_FUSED = "fused AS (SELECT query_id, chunk_id, round(sum(CASE collection WHEN 1 THEN w_text WHEN 0 THEN w_visual ELSE w_entity END / (60 + r2)), 9) AS score FROM again GROUP BY ALL)"
_WORDS_SQL = f"""d0 AS (SELECT doc_id, {keywords_sql("text")} AS k FROM documents SEMI JOIN (SELECT chunk_id FROM chunks WHERE collection = 1) c ON c.chunk_id = doc_id), l0 AS (SELECT doc_id, len(k) AS length FROM d0),
t0 AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(k) AS term FROM d0) GROUP BY ALL), f0 AS (SELECT term, count(*) AS df FROM t0 GROUP BY 1), n0 AS (SELECT count(*) AS n, avg(length) AS mean FROM l0),
q0 AS (SELECT query_id, unnest(list_distinct({keywords_sql("b.text")})) AS term FROM query_vectors CROSS JOIN (SELECT max(item_id) + 1 AS numbers FROM benchmark) JOIN benchmark b ON b.item_id = query_id // 20 % numbers),
s0 AS (SELECT q0.query_id, t0.doc_id AS chunk_id, round(sum(ln(1 + (n0.n - f0.df + 0.5::DOUBLE) / (f0.df + 0.5::DOUBLE)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l0.length / n0.mean))), 9) AS score
  FROM q0 JOIN t0 USING (term) JOIN f0 USING (term) JOIN l0 USING (doc_id), n0 GROUP BY ALL),
sparse AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s0 QUALIFY r <= 10)"""
_MORE = f"""{_WORDS_SQL},
fused AS (SELECT query_id, chunk_id, round(sum(w / (60 + r2)), 9) AS score FROM (SELECT query_id, chunk_id, CASE collection WHEN 1 THEN w_text WHEN 0 THEN w_visual ELSE w_entity END AS w, r2 FROM again
  UNION ALL SELECT query_id, chunk_id, {search.SPARSE_WEIGHT}::DOUBLE, r FROM sparse) GROUP BY ALL)"""
FOUR_PATHS_SQL = R.RETRIEVE_SQL.replace(_FUSED, _MORE).replace("FROM asked, chunks WHERE (collection", "FROM asked, chunks WHERE query_id // 20 % 3 > 0 AND ((collection").replace("(collection = 2 AND has_entity))", "(collection = 2 AND has_entity)))")


MANY = 60


def _profile_chunks(spark, sf_dir):
    """Chunks of frames and texts, and one of the profile of each entity: what the third collection has of one type in a
    video.  A profile's vector is that of its first description."""
    chunks = X.chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    name = F.concat(F.lit("thing_"), F.col("chunk_type"))
    seen = F.array_sort(F.collect_list(F.struct(F.col("start_ms").alias("timestamp_ms"), "chunk_id")))
    first = F.min_by("embedding", F.col("chunk_id").cast("long"))
    profiles = chunks.where("collection = 2").groupBy("video_id", name.alias("entity_id")).agg(seen.alias("appearances"), first.alias("embedding"))
    profiles = profiles.withColumn("description", F.concat(F.lit("a "), "entity_id")).withColumn("aliases", F.array().cast("array<string>"))
    made = V.entity_chunks(profiles).drop("collection", "text").join(profiles.select("video_id", "entity_id", "embedding"), ["video_id", "entity_id"])
    made = made.select("chunk_id", "video_id", F.lit(2).alias("collection"), "start_ms", "end_ms", F.lit(2).alias("chunk_type"), "embedding")
    return chunks.where("collection < 2").unionByName(made)


def entity_path_retrieve(spark, sf_dir):
    """The three paths, of which the one by entities finds profiles by their descriptions.  That path weighs least, so its hits
    come behind many others."""
    chunks = _profile_chunks(spark, sf_dir).withColumn("chunk_type", chunk_type_name(F.col("chunk_type")))
    return search.retrieve(chunks, R._asked(spark, sf_dir), MANY)


_PROFILED = f"""{X.CHUNKS.replace("chunks AS (", "plain AS (", 1)},
chunks AS (SELECT CAST(chunk_id AS VARCHAR) AS chunk_id, video_id, collection, start_ms, end_ms, chunk_type, embedding FROM plain WHERE collection < 2
  UNION ALL SELECT md5('entity_profiles|' || video_id || '|thing_' || chunk_type), video_id, 2, min(start_ms), max(start_ms), 2, arg_min(embedding, chunk_id) FROM plain WHERE collection = 2 GROUP BY video_id, chunk_type)"""
ENTITY_PATH_SQL = R.RETRIEVE_SQL.replace(X.CHUNKS, _PROFILED).replace("WHEN 2 THEN 5 ELSE 10 END", f"WHEN 2 THEN 5 ELSE {2 * MANY} END").replace("least(5, len(kept))", f"least({MANY}, len(kept))")


QUERIES = {
    "entity_path_retrieve": (entity_path_retrieve, ENTITY_PATH_SQL),
    "qa_cache_hits": (qa_cache_hits, QA_HITS_SQL),
    "alike_near": (alike_near, ALIKE_NEAR_SQL),
    "keywords_mixed": (keywords_mixed, KEYWORDS_MIXED_SQL),
    "vector_by_collection": (vector_by_collection, BY_COLLECTION_SQL),
    "numbered_evidence": (numbered_evidence, EVIDENCE_SQL),
    "label_codecs": (label_codecs, CODEC_SQL),
    "message_json": (message_json, JSON_SQL),
    "chunk_lookup": (chunk_lookup, LOOKUP_SQL),
    "conversation_titles": (conversation_titles, TITLES_SQL),
    "delta_flushes": (delta_flushes, FLUSH_SQL),
    "four_path_retrieve": (four_path_retrieve, FOUR_PATHS_SQL),
}
