"""Entity profiles as stored rows, cached answers as chunks, extra retrieval paths, merged evidence, sampling ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions import sampling as S
from chronoreel.functions.questions import is_player_command
from chronoreel.functions.text import fixed, time_label
from chronoreel.functions.vectors import cosine
from chronoreel.operators.align import CELL_MS
from chronoreel.operators.index import cacheable, qa_chunk
from chronoreel.operators.search import overlap_ratio, vector_topk
from chronoreel.operators.segment import cells

# Kinds of entities, words that point back in a talk, and the bounds of cached answers and of alike frames.
ENTITY_TYPES = ("person", "object", "location", "text")
POINTING_BACK = "(他|她|它|那个|这个|刚才|后来|继续|再详细)"
SERVE_SCORE, SERVE_CONFIDENCE = 0.95, 0.8
QA_PATH_HITS, QA_PATH_SCORE = 3, 0.85
ALIKE = 0.95
#: Kinds of sample points in the order in which they get the budget.
POINT_KINDS = ("scene", "motion", "audio", "entropy")

_BBOX = "struct<x:double,y:double,w:double,h:double>"
_APPEARANCES = f"array<struct<scene_id:bigint,timestamp_ms:bigint,description:string,bbox:{_BBOX}>>"


def encode_entities(entities: DataFrame) -> DataFrame:
    """``entities`` with aliases and appearances as JSON text (aliases_json, appearances_json); null lists are empty ones.
    A box is written only if its width and height are above 0."""

    def one(a: Column) -> Column:
        box = F.struct(*(a["bbox"][c].cast("double").alias(c) for c in "xywh"))
        return F.struct(
            a["scene_id"].cast("bigint").alias("scene_id"),
            a["timestamp_ms"].cast("bigint").alias("timestamp_ms"),
            F.coalesce(a["description"], F.lit("")).alias("description"),
            F.when((a["bbox"]["w"] > 0) & (a["bbox"]["h"] > 0), box).alias("bbox"),
        )

    text = lambda c, empty: F.coalesce(F.to_json(c), F.lit(empty))
    written = entities.withColumn("aliases_json", text(F.col("aliases"), "[]")).withColumn("appearances_json", text(F.transform("appearances", one), "[]"))
    return written.drop("aliases", "appearances")


def decode_entities(rows: DataFrame) -> DataFrame:
    """The reverse of ``encode_entities``: kinds that are not known are ``unknown``; a scene without a number is -1, a time
    0, a description empty; text that is no JSON gives empty lists."""
    filled = lambda a: F.struct(
        F.coalesce(a["scene_id"], F.lit(-1)).cast("bigint").alias("scene_id"),
        F.coalesce(a["timestamp_ms"], F.lit(0)).cast("bigint").alias("timestamp_ms"),
        F.coalesce(a["description"], F.lit("")).alias("description"),
        a["bbox"].alias("bbox"),
    )
    some = F.filter(F.from_json("appearances_json", _APPEARANCES), lambda a: a.isNotNull())
    appearances = F.coalesce(F.transform(some, filled), F.array().cast(_APPEARANCES))
    aliases = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    kind = F.when(F.col("entity_type").isin(*ENTITY_TYPES), F.col("entity_type")).otherwise("unknown")
    out = rows.withColumn("entity_type", kind).withColumn("aliases", aliases).withColumn("appearances", appearances)
    return out.drop("aliases_json", "appearances_json")


def entity_chunks(entities: DataFrame) -> DataFrame:
    """(chunk_id, video_id, entity_id, collection, start_ms, end_ms, text): an entity_profiles chunk for each entity, from
    its first to its last appearance (0 to 0 without any); its text is the description and the other names."""
    times = F.transform("appearances", lambda a: a["timestamp_ms"])
    text = F.concat_ws(" ", F.col("description"), F.col("aliases"))
    key = F.md5(F.concat_ws("|", F.lit("entity_profiles"), F.col("video_id").cast("string"), F.col("entity_id")))
    edge = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return entities.select(key.alias("chunk_id"), "video_id", "entity_id", F.lit("entity_profiles").alias("collection"), edge(F.array_min(times)).alias("start_ms"), edge(F.array_max(times)).alias("end_ms"), text.alias("text"))


def answers_to_chunks(answers: DataFrame) -> DataFrame:
    """Chunks of answers worth caching.  ``answers`` has video_id, question, answer, confidence, evidence_scene_ids,
    cached_ms and the question's embedding; player commands, unsure answers and questions without a vector are left out.
    Times are 0; the parts come again as JSON in ``metadata_json``."""
    kept = answers.where(cacheable(is_player_command(F.col("question")), F.col("confidence"), F.col("embedding")))
    parts = F.to_json(F.struct("question", "answer", "confidence", "cached_ms", "evidence_scene_ids"))
    zero = F.lit(0).cast("long")
    return kept.withColumns(
        {
            "chunk_id": F.md5(F.concat_ws("|", F.lit("qa_cache"), F.col("video_id").cast("string"), F.col("question"))),
            "chunk_type": F.lit("QAcache"),
            "start_ms": zero,
            "end_ms": zero,
            "text": qa_chunk(F.col("question"), F.col("answer")),
            "metadata_json": parts,
        }
    ).drop("question", "answer", "confidence", "evidence_scene_ids", "cached_ms")


def may_serve(question: Column, score: Column, confidence: Column, cached_scenes: Column, current_scenes: Column) -> Column:
    """Whether a cached answer may be served under the strict rules: the question points at nothing said before, both
    questions are nearly one, the answer was sure, and its scenes are among those found now.  Null means no."""
    sure = (score >= SERVE_SCORE) & (confidence >= SERVE_CONFIDENCE)
    return F.coalesce(~question.rlike(POINTING_BACK) & ~is_player_command(question) & sure & F.arrays_overlap(cached_scenes, current_scenes), F.lit(False))


def qa_path(cached: DataFrame, questions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The three cached answers of the question's own video that are nearest, with a cosine of 0.85 or more."""
    return vector_topk(cached, questions, QA_PATH_HITS, min_score=QA_PATH_SCORE, same_video=True, carry=carry)


def window_path(chunks: DataFrame, windows: DataFrame, k: int, width_ms: int = CELL_MS) -> DataFrame:
    """(query_id, chunk_id, video_id, start_ms, end_ms, score, rank): for each question with a time window (query_id, video_id,
    from_ms, to_ms) the ``k`` chunks with the greatest overlap over the shorter length; ties go to the earlier, then the
    smaller id.  Joined on (video, time cell); a pair is met in its first common cell only."""
    w = windows.select("query_id", "video_id", "from_ms", "to_ms").where("to_ms > from_ms").withColumn("cell", F.explode(cells(F.col("from_ms"), F.col("to_ms"), width_ms)))
    c = chunks.select("chunk_id", "video_id", "start_ms", "end_ms").where("end_ms > start_ms").withColumn("cell", F.explode(cells(F.col("start_ms"), F.col("end_ms"), width_ms)))
    met = c.join(w, ["video_id", "cell"]).where(F.col("cell") == F.floor(F.greatest("from_ms", "start_ms") / width_ms))
    ratio = overlap_ratio({"start_ms": F.col("start_ms"), "end_ms": F.col("end_ms")}, {"start_ms": F.col("from_ms"), "end_ms": F.col("to_ms")})
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "start_ms", "chunk_id")
    ranked = met.withColumn("score", ratio).where(F.col("score") > 0).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "chunk_id", "video_id", "start_ms", "end_ms", "score", "rank")


def merge_evidence(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, video_id, start_ms, end_ms, chunk_id, score, n): hits of a query that share time in a video become one, whose
    score is the sum of theirs and whose chunk is the best of them (ties: the smaller id).  Hits are a query's fused ones."""
    order = Window.partitionBy(by, "video_id").orderBy("start_ms", "end_ms", "chunk_id")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("__fresh", F.coalesce((F.col("start_ms") >= reach).cast("int"), F.lit(1)))
    runs = marked.withColumn("__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "video_id", "__run").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min_by("chunk_id", F.struct(-F.col("score"), "chunk_id")).alias("chunk_id"),
        F.round(F.sum("score"), 9).alias("score"),
        F.count(F.lit(1)).alias("n"),
    ).drop("__run")


# The text that evidence is handed to a model in, and the names of paths in it.
PATH_LABELS = {"visual": "视觉检索", "text": "文本/语音", "entity": "实体", "qa_cache": "历史问答"}
EVIDENCE_LINES = {
    "number": "## 证据 {}\n",
    "times": "时间范围：{} - {}\n",
    "source": "来源：{}（相似度 {}）\n",
    "scene": "场景 ID：{}\n",
    "kind": "证据类型：{}\n",
    "relation": "音画关系：{}（置信度 {}）\n",
    "text": "相关内容：{}\n\n",
}
EVIDENCE_CHARS = 200


def _line(name: str, *values: Column) -> Column:
    parts = EVIDENCE_LINES[name].split("{}")
    return F.concat(*(x for pair in zip(map(F.lit, parts), [*values, F.lit("")], strict=True) for x in pair))


def evidence_text(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, n, evidence): a query's hits in rank order as numbered text.  ``hits`` has rank, hit_path, score, start_ms, end_ms and,
    each null or empty where there is none, scene_id, evidence_type, audio_relation, relation_confidence and text, of which the
    first EVIDENCE_CHARS are shown.  Hits are a query's few best."""
    two = lambda x: fixed(x, 2)
    place = F.row_number().over(Window.partitionBy(by).orderBy("rank"))
    path = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in PATH_LABELS.items() for x in pair)), F.col("hit_path")), F.col("hit_path"))
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    line = F.concat(
        _line("number", place.cast("string")),
        _line("times", time_label(F.col("start_ms")), time_label(F.col("end_ms"))),
        _line("source", path, two(F.col("score"))),
        F.when(F.col("scene_id").isNotNull(), _line("scene", F.col("scene_id").cast("string"))).otherwise(""),
        F.when(given("evidence_type"), _line("kind", F.col("evidence_type"))).otherwise(""),
        F.when(given("audio_relation"), _line("relation", F.col("audio_relation"), two(F.coalesce("relation_confidence", F.lit(0.0))))).otherwise(""),
        F.when(given("text"), _line("text", F.left("text", F.lit(EVIDENCE_CHARS)))).otherwise(""),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return hits.withColumn("line", line).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "").alias("evidence"))


def alike_runs(frames: DataFrame, least: float = ALIKE) -> DataFrame:
    """(video_id, run, first_id, last_id, n): frames of a video (video_id, frame_id, embedding) in order, where each is as
    near to the one before as ``least`` demands (above it); runs count from 1, and the first frame of one stands for it."""
    order = Window.partitionBy("video_id").orderBy("frame_id")
    near = cosine(F.lag("embedding").over(order), F.col("embedding"))
    marked = frames.select("video_id", "frame_id", (near <= least).cast("int").alias("__fresh"))
    runs = marked.withColumn("run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("video_id", "run").agg(F.min("frame_id").alias("first_id"), F.max("frame_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def sample_points(points: DataFrame, budget: int) -> DataFrame:
    """(video_id, ts_ms, kind, score, place): the points of a video (kind, ts_ms, score) that a budget of frames allows: scene
    points first, then motion, sound and entropy, each by falling score; points at one time count once, as the first."""
    place = F.array_position(F.array(*map(F.lit, POINT_KINDS)), F.col("kind"))
    first = Window.partitionBy("video_id", "ts_ms").orderBy("__kind", F.col("score").desc())
    order = Window.partitionBy("video_id").orderBy("__kind", F.col("score").desc(), "ts_ms")
    known = points.withColumn("__kind", place).where(F.col("__kind") > 0)
    single = known.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1)
    return single.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget).select("video_id", "ts_ms", "kind", "score", "place")


def sampling_ranges(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, need_new, place, density, budget, start_ms, end_ms): what to look at for a question, a row a range.

    ``questions`` has query_id, question_class, duration_ms, position_ms and enough; ``hits`` query_id, rank, start_ms and
    end_ms.  Nothing is looked at where what is known is enough.  Questions about a moment, an entity or an action take a range
    around each of the five best hits, those about a cause around the best; without hits, and for others, it is one range.
    """
    most = F.when(F.col("question_class").isin("TemporalLocalization", "EntityQuery", "ActionRecognition"), 5).when(F.col("question_class") == "CausalReasoning", 1).otherwise(0)
    asked = questions.withColumn("__most", F.when(F.col("enough"), 0).otherwise(most))
    near = hits.where("rank <= 5").select("query_id", F.col("rank").alias("__rank"), F.col("start_ms").alias("__start"), F.col("end_ms").alias("__end"))
    rows = asked.alias("a").join(near.alias("h"), (F.col("a.query_id") == F.col("h.query_id")) & (F.col("__rank") <= F.col("__most")), "left")
    plan = S.sampling_plan(F.col("question_class"), F.col("duration_ms"), F.col("__start"), F.col("__end"), F.col("position_ms"))
    named = rows.select(F.col("a.query_id").alias("query_id"), (~F.col("enough")).alias("need_new"), F.coalesce("__rank", F.lit(1)).cast("int").alias("place"), F.when(~F.col("enough"), plan).alias("plan"))
    return named.select("query_id", "need_new", "place", "plan.*")
