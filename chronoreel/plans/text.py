"""Labels, keywords, ids, sampling and answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoreel.functions import questions as Q
from chronoreel.functions import sampling as S
from chronoreel.functions import text as TX
from chronoreel.operators import reflect
from chronoreel.plans.retrieval import QUESTIONS
from chronoreel.plans.scenes import keywords_sql
from chronoreel.sources import fixtures as X


def keywords(spark, sf_dir):
    """Number of keywords, of distinct ones, and the first in order, of every document."""
    rows = X.table(spark, sf_dir, "documents").select("doc_id", TX.keywords(F.col("text")).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"), F.array_min("k").alias("first"))


KEYWORDS_SQL = f"WITH k AS (SELECT doc_id, {keywords_sql('text')} AS k FROM documents) SELECT doc_id, CAST(len(k) AS BIGINT) AS n, CAST(len(list_distinct(k)) AS BIGINT) AS n_distinct, list_min(k) AS first FROM k"


def keyword_overlap_all(spark, sf_dir):
    """Every document against the benchmark item of its number, over as many numbers as the items have."""
    docs, items = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "benchmark")
    numbers = F.broadcast(items.agg((F.max("item_id") + 1).alias("numbers")))
    held = items.select("item_id", F.array_distinct(TX.keywords(F.col("text"))).alias("b"))
    both = docs.select("doc_id", F.array_distinct(TX.keywords(F.col("text"))).alias("a")).crossJoin(numbers).withColumn("item_id", F.pmod("doc_id", "numbers")).join(held, "item_id", "left")
    # a document without an item has no words in common
    a, b = F.col("a"), F.coalesce("b", F.array().cast("array<string>"))
    return both.select("doc_id", F.round(TX.keyword_overlap(a, b), 6).alias("overlap"), F.array_join(TX.shared_keywords(a, b), ",").alias("shared"))


OVERLAP_ALL_SQL = f"""WITH d AS (SELECT doc_id, text, doc_id % numbers AS item_id FROM documents, (SELECT max(item_id) + 1 AS numbers FROM benchmark)),
k AS (SELECT doc_id, list_distinct({keywords_sql("d.text")}) AS a, list_distinct({keywords_sql("b.text")}) AS b FROM d LEFT JOIN benchmark b USING (item_id))
SELECT doc_id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END, 6) AS overlap,
  array_to_string(list_sort(list_intersect(a, b))[1:12], ',') AS shared FROM k"""


def time_labels(spark, sf_dir):
    ms = (X.ts_ms(F.col("ts")) % 10_000_000).alias("ms")
    rows = X.table(spark, sf_dir, "events").select("event_id", ms)
    m = F.col("ms")
    return rows.select("event_id", TX.time_label(m).alias("a"), TX.transcript_label(m).alias("b"), TX.subtitle_label(m).alias("c"), TX.position_label(m - 5_000_000).alias("d"))


LABELS_SQL = """WITH t AS (SELECT event_id, ((epoch_us(ts) // 1000) % 10000000) // 1000 AS s, greatest(0, (epoch_us(ts) // 1000) % 10000000 - 5000000) // 1000 AS p FROM events)
SELECT event_id,
 CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS a,
 printf('%d:%02d', s // 60, s % 60) AS b,
 CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS c,
 CASE WHEN p >= 3600 THEN printf('%d:%02d:%02d', p // 3600, p % 3600 // 60, p % 60) ELSE printf('%02d:%02d', p // 60, p % 60) END AS d FROM t"""


def chunk_ids(spark, sf_dir):
    rows = X.table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    ident = TX.chunk_id(F.col("lang"), d % 7, d * 1000, d * 1000 + F.col("n_chars"), d)
    return rows.select("doc_id", ident.alias("chunk_id"), TX.thumbnail_name(F.concat_ws("/", "source", d.cast("string"))).alias("thumbnail"), TX.video_id(F.octet_length("text"), F.encode("text", "UTF-8"), F.col("source")).alias("video_id"))


IDS_SQL = """SELECT doc_id, sha1(concat_ws('|', lang, doc_id % 7, doc_id * 1000, doc_id * 1000 + n_chars, doc_id, 'v1')) AS chunk_id, md5(source || '/' || doc_id) || '.jpg' AS thumbnail,
left(sha1(strlen(text)::VARCHAR || text), 16) AS video_id FROM documents"""


def _answers(spark, sf_dir):
    """Messages with times in brackets, some of them late."""
    rows = X.messages(spark, sf_dir)
    t = F.col("conversation_id") % 50
    stamp = F.concat(F.lit(" 见["), F.lpad(t.cast("string"), 2, "0"), F.lit(":07]和["), F.lit("1:"), F.lpad(F.col("seq").cast("string"), 2, "0"), F.lit(":03]"))
    text = F.when(F.col("seq") % 2 == 0, F.concat("content", stamp)).when(F.col("seq") == 3, F.concat(F.col("content"), F.lit(" 没有音频"))).otherwise(F.col("content"))
    return rows.select("conversation_id", "seq", text.alias("answer"))


_ANSWERS_SQL = f"""{X.MESSAGES}, answers AS (SELECT conversation_id, seq, CASE WHEN seq % 2 = 0 THEN content || ' 见[' || lpad((conversation_id % 50)::VARCHAR, 2, '0') || ':07]和[1:' || lpad(seq::VARCHAR, 2, '0') || ':03]'
  WHEN seq = 3 THEN content || ' 没有音频' ELSE content END AS answer FROM messages)"""


def extract_timestamps(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("conversation_id", "seq", TX.timestamps_ms(F.col("answer")).alias("t"))
    return rows.select("conversation_id", "seq", F.size("t").cast("long").alias("n"), F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("times"))


_STAMPS_SQL = r"""list_transform(regexp_extract_all(answer, '\[(?:\d{1,2}:)?\d{1,2}:\d{2}\]'), lambda m:
  (coalesce(try_cast(regexp_extract(m, '\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]', 1) AS BIGINT), 0) * 3600 + CAST(regexp_extract(m, '\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]', 2) AS BIGINT) * 60
   + CAST(regexp_extract(m, '\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]', 3) AS BIGINT)) * 1000)"""
STAMPS_SQL = f"WITH {_ANSWERS_SQL}, t AS (SELECT conversation_id, seq, {_STAMPS_SQL} AS t FROM answers) SELECT conversation_id, seq, CAST(len(t) AS BIGINT) AS n, array_to_string(t, ',') AS times FROM t"


def reflect_answers(spark, sf_dir):
    """Issues and confidence of every message as an answer about a 40-minute video whose known text is the
    conversation's first message."""
    answers = _answers(spark, sf_dir)
    pool = X.messages(spark, sf_dir).where("seq = 0").select("conversation_id", F.col("content").alias("pool"))
    rows = answers.join(pool, "conversation_id", "left")
    duration = F.lit(2_400_000).cast("long")
    late = reflect.late_timestamp(F.col("answer"), duration)
    doubtful = F.size(reflect.unsupported_claims(F.col("answer"), F.col("pool")))
    flags = {
        "inconsistent": reflect.inconsistent(F.col("answer"), duration, F.lit(True)),
        "unsupported": reflect.unsupported_length(F.col("answer"), F.col("conversation_id") % 2),
        "late_ms": late,
        "n_claims": doubtful.cast("long"),
    }
    rows = rows.withColumns(flags)
    issues = F.col("inconsistent").cast("int") + F.col("unsupported").cast("int") + F.col("late_ms").isNotNull().cast("int") + (F.col("n_claims") > 0).cast("int")
    return rows.select("conversation_id", "seq", *flags, F.round(reflect.confidence(issues), 6).alias("confidence"))


REFLECT_SQL = rf"""WITH {_ANSWERS_SQL}, pool AS (SELECT conversation_id, content AS pool FROM messages WHERE seq = 0),
r AS (SELECT a.conversation_id, a.seq, a.answer, p.pool, {_STAMPS_SQL} AS t,
  list_filter(regexp_split_to_array(answer, '[。.!?？；;]'), lambda c: c <> '') AS claims FROM answers a LEFT JOIN pool p USING (conversation_id)),
c AS (SELECT *, CASE WHEN coalesce(length(pool), 0) = 0 THEN [] ELSE list_filter(claims, lambda c: length(c) >= 15
  AND len(list_filter(regexp_split_to_array(c, '[，,。.；;、\s]'), lambda w: length(w) >= 2)) >= 3
  AND len(list_filter(regexp_split_to_array(c, '[，,。.；;、\s]'), lambda w: length(w) >= 2 AND NOT contains(pool, w))) > len(list_filter(regexp_split_to_array(c, '[，,。.；;、\s]'), lambda w: length(w) >= 2)) * 2 // 3) END AS bad FROM r),
f AS (SELECT conversation_id, seq, regexp_matches(answer, '没有音频|无音频|静音视频') AS inconsistent, length(answer) > 200 AND conversation_id % 2 = 0 AS unsupported,
  list_filter(t, lambda x: x > 2400000)[1] AS late_ms, CAST(len(bad) AS BIGINT) AS n_claims FROM c)
SELECT *, round(greatest(0.3, 0.9 - 0.15 * (inconsistent::INT + unsupported::INT + (late_ms IS NOT NULL)::INT + (n_claims > 0)::INT)), 6)::DOUBLE AS confidence FROM f"""


def json_object_extract(spark, sf_dir):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("reply: ```json\n"), F.col("props"), F.lit("\n``` end"))).when(F.col("event_id") % 3 == 1, F.lit("no object {here")).otherwise(F.col("props"))
    rows = X.table(spark, sf_dir, "events").select("event_id", TX.json_object(wrapped).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.col("j").isNotNull().alias("parsed"))


JSON_SQL = "SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN json_extract_string(props, '$.k') END AS k, event_id % 3 <> 1 AS parsed FROM events"


def text_excerpts(spark, sf_dir):
    t = F.col("text")
    rows = X.table(spark, sf_dir, "documents")
    return rows.select(
        "doc_id",
        TX.excerpt(TX.simplified(t), 80).alias("short"),
        TX.human_size(F.octet_length(t) * F.col("doc_id") * F.col("doc_id")).alias("size"),
        TX.level_label((F.col("doc_id") % 5 - 1).cast("int")).alias("level"),
        TX.media_kind(F.concat(F.lit("/a.b/"), F.col("source"), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 5 + 1).cast("int")))).alias("kind"),
    )


_SUFFIXES = (".MP3", ".mkv", "", ".txt", ".ts")
EXCERPT_SQL = r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, (strlen(text) * doc_id * doc_id)::DOUBLE AS b FROM documents)
SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS short,
CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1024**2 THEN printf('%.1f KB', b / 1024) WHEN b < 1024**3 THEN printf('%.1f MB', b / 1024**2) WHEN b < 1024**4 THEN printf('%.1f GB', b / 1024**3) ELSE printf('%.1f TB', b / 1024**4) END AS size,
CASE WHEN doc_id % 5 BETWEEN 1 AND 3 THEN 'L' || (doc_id % 5 - 1) ELSE '—' END AS level,
['AUDIO', 'FILE', 'UNKNOWN', 'UNKNOWN', 'FILE'][doc_id % 5 + 1] AS kind FROM d"""


def frame_budget(spark, sf_dir):
    rows = X.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 500).alias("duration_ms"))
    d = F.col("duration_ms")
    return rows.select("doc_id", *(S.frame_budget(d, F.lit(p)).alias(p) for p in ("initial_overview", "question_targeted", "full_analysis", "other")))


BUDGET_SQL = """WITH d AS (SELECT doc_id, n_chars * 500 / 60000.0 AS m FROM documents)
SELECT doc_id, least(50, greatest(8, trunc(m * 3)))::INT AS initial_overview, 10 AS question_targeted, least(50, greatest(20, trunc(m * 8)))::INT AS full_analysis, 8 AS other FROM d"""


def sample_points(spark, sf_dir):
    """How many sample times each density gives, and the sum, the first and the last of them."""
    out = None
    for name, dense in (("dense", True), ("sparse", False)):
        rows = X.table(spark, sf_dir, "documents").select("doc_id", F.lit(name).alias("density"), (F.col("n_chars") * 100 + 7).alias("d"))
        t = S.sample_times(F.col("d"), S.sample_count(F.col("d"), dense))
        rows = rows.withColumn("t", t)
        rows = rows.select("doc_id", "density", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))
        out = rows if out is None else out.unionByName(rows)
    return out


POINTS_SQL = """WITH d AS (SELECT doc_id, n_chars * 100 + 7 AS d FROM documents),
n AS (SELECT doc_id, d, 'dense' AS density, least(600, greatest(20, d // 1000)) AS n FROM d UNION ALL SELECT doc_id, d, 'sparse', least(200, greatest(20, d // 10000)) FROM d),
t AS (SELECT doc_id, density, n, floor((i + 0.5::DOUBLE) / n * d)::BIGINT AS t FROM (SELECT *, unnest(range(0, n)) AS i FROM n))
SELECT doc_id, density, count(*) AS n, sum(t)::BIGINT AS total, min(t) AS first, max(t) AS last FROM t GROUP BY ALL"""


def range_samples(spark, sf_dir):
    rows = X.segments(spark, sf_dir).select("video_id", "seg_idx", F.posexplode(S.range_times(F.col("start_ms"), F.col("end_ms"), (F.col("seg_idx") % 12).cast("int"))).alias("i", "t_ms"))
    return rows


RANGE_SQL = f"""WITH {X.SEGMENTS}, n AS (SELECT *, least(10, greatest(2, seg_idx % 12)) AS n FROM segments WHERE end_ms > start_ms)
SELECT video_id, seg_idx, i::INT AS i, start_ms + i * ((end_ms - start_ms) // (n - 1)) AS t_ms FROM (SELECT *, unnest(range(0, n)) AS i FROM n)"""


def _planned(spark, sf_dir):
    """Every message as a question of a literal class, with a hit for two in three."""
    texts = F.array(*map(F.lit, QUESTIONS))
    rows = X.segments(spark, sf_dir)
    q = F.get(texts, ((F.col("video_id") + F.col("seg_idx")) % len(QUESTIONS)).cast("int"))
    hit = F.col("seg_idx") % 3 != 2
    return rows.select("video_id", "seg_idx", Q.question_class(q).alias("c"), F.when(hit, F.col("start_ms")).alias("s"), F.when(hit, F.col("end_ms")).alias("e"))


def sampling_plan(spark, sf_dir):
    rows = _planned(spark, sf_dir)
    plan = S.sampling_plan(F.col("c"), F.lit(20_000).cast("long"), F.col("s"), F.col("e"), F.col("seg_idx") * 1500)
    return rows.select("video_id", "seg_idx", F.col("c").alias("question_class"), plan.alias("p")).select("video_id", "seg_idx", "question_class", "p.density", "p.budget", "p.start_ms", "p.end_ms")


def _class_sql(q: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({q}, '{p}') THEN '{n}'" for n, p in Q.QUESTION_RULES) + " ELSE 'Unknown' END"


_QLIST = "['" + "', '".join(QUESTIONS) + "']"
_PLANNED_SQL = f"""{X.SEGMENTS}, asked AS (SELECT video_id, seg_idx, {_QLIST}[(video_id + seg_idx) % {len(QUESTIONS)} + 1] AS q, CASE WHEN seg_idx % 3 <> 2 THEN start_ms END AS s, CASE WHEN seg_idx % 3 <> 2 THEN end_ms END AS e FROM segments),
planned AS (SELECT *, {_class_sql("q")} AS c FROM asked)"""
PLAN_SQL = f"""WITH {_PLANNED_SQL} SELECT video_id, seg_idx, c AS question_class,
CASE WHEN c IN ('GlobalSummary', 'CurrentFrame') OR (c = 'TemporalLocalization' AND s IS NULL) THEN 'sparse' WHEN c IN ('TemporalLocalization', 'EntityQuery', 'ActionRecognition', 'CausalReasoning', 'Counting', 'Comparison') THEN 'dense' ELSE 'medium' END AS density,
CASE c WHEN 'TemporalLocalization' THEN 10 WHEN 'EntityQuery' THEN 12 WHEN 'ActionRecognition' THEN 12 WHEN 'CausalReasoning' THEN 10 WHEN 'CurrentFrame' THEN 3 WHEN 'Counting' THEN 20 WHEN 'Comparison' THEN 20 ELSE 8 END AS budget,
CASE WHEN c = 'CurrentFrame' THEN greatest(0, seg_idx * 1500 - 3000) WHEN s IS NULL THEN 0 WHEN c IN ('TemporalLocalization', 'EntityQuery', 'ActionRecognition') THEN greatest(0, s - 2000) WHEN c = 'CausalReasoning' THEN greatest(0, s - 10000) ELSE 0 END AS start_ms,
CASE WHEN c = 'CurrentFrame' THEN seg_idx * 1500 + 3000 WHEN s IS NULL THEN 20000 WHEN c IN ('TemporalLocalization', 'EntityQuery', 'ActionRecognition') THEN least(20000, e + 2000) WHEN c = 'CausalReasoning' THEN least(20000, e + 5000) ELSE 20000 END AS end_ms FROM planned"""


def sufficiency(spark, sf_dir):
    rows = _planned(spark, sf_dir)
    level = F.when(F.col("seg_idx") % 5 != 4, (F.col("seg_idx") % 3).cast("int"))
    summary = F.when(F.col("video_id") % 2 == 0, "known").otherwise("")
    action = reflect.sufficiency(F.col("c"), level, summary, F.col("s").isNotNull().cast("int"))
    return rows.select("video_id", "seg_idx", action.alias("action"))


SUFFICIENT_SQL = f"""WITH {_PLANNED_SQL} SELECT video_id, seg_idx, CASE WHEN seg_idx % 5 = 4 THEN 'wait_indexing' WHEN c = 'GlobalSummary' THEN CASE WHEN video_id % 2 = 0 THEN 'ready' ELSE 'build_summary' END
WHEN c = 'CurrentFrame' THEN 'seek_and_analyze' WHEN c IN ('TemporalLocalization', 'EntityQuery', 'ActionRecognition') THEN CASE WHEN s IS NOT NULL THEN 'ready' ELSE 'search_and_verify' END
ELSE CASE WHEN seg_idx % 3 >= 2 THEN 'ready' ELSE 'build_summary' END END AS action FROM planned"""

QUERIES = {
    "keywords": (keywords, KEYWORDS_SQL),
    "keyword_overlap_all": (keyword_overlap_all, OVERLAP_ALL_SQL),
    "time_labels": (time_labels, LABELS_SQL),
    "chunk_ids": (chunk_ids, IDS_SQL),
    "extract_timestamps": (extract_timestamps, STAMPS_SQL),
    "reflect_answers": (reflect_answers, REFLECT_SQL),
    "json_object_extract": (json_object_extract, JSON_SQL),
    "text_excerpts": (text_excerpts, EXCERPT_SQL),
    "frame_budget": (frame_budget, BUDGET_SQL),
    "sample_points": (sample_points, POINTS_SQL),
    "range_samples": (range_samples, RANGE_SQL),
    "sampling_plan": (sampling_plan, PLAN_SQL),
    "sufficiency": (sufficiency, SUFFICIENT_SQL),
}
