"""Speech aligned with scenes, the audio-visual gate, fusion and evidence chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions import text as X
from chronoreel.functions.vectors import cosine
from chronoreel.operators.segment import cells
from chronoreel.schema import CHUNK_TYPES

# A scene's quota of speech, and the gate's constants.
LEAST_RATIO, MOST_SEGMENTS, MOST_CHARS = 0.05, 8, 1500
SIM_FLOOR, SIM_SPAN, KEY_FULL, COVER_FULL, SPAN_FULL = 0.35, 0.35, 0.25, 0.40, 0.30
STRONG, CONTEXTUAL, UNSURE = 0.60, 0.30, 0.12
LEAST_CHARS = 6
#: Width of the time cells that interval joins meet in.
CELL_MS = 60_000


def overlaps(scenes: DataFrame, segments: DataFrame, width_ms: int = CELL_MS) -> DataFrame:
    """(video_id, scene_id, scene_start, scene_end, seg_idx, start_ms, end_ms, text, overlap) of scenes and segments
    that share time.  Joined on (video, time cell); each pair is met in its first common cell only."""
    s = scenes.select("video_id", "scene_id", F.col("start_ms").alias("scene_start"), F.col("end_ms").alias("scene_end"))
    s = s.withColumn("cell", F.explode(cells(F.col("scene_start"), F.col("scene_end"), width_ms)))
    g = segments.select("video_id", "seg_idx", "start_ms", "end_ms", "text").withColumn("cell", F.explode(cells(F.col("start_ms"), F.col("end_ms"), width_ms)))
    shared = F.least("scene_end", "end_ms") - F.greatest("scene_start", "start_ms")
    both = s.join(g, ["video_id", "cell"]).where(shared > 0)
    first = F.floor(F.greatest("scene_start", "start_ms") / width_ms)
    return both.where(F.col("cell") == first).drop("cell").withColumn("overlap", shared)


def scene_speech(pairs: DataFrame) -> DataFrame:
    """Each scene's speech: of segments with a twentieth or more inside it, by falling share, up to eight and 1500
    characters; if the very first is longer, it alone, cut.  (video_id, scene_id, seg_idx, start_ms, end_ms, text)."""
    share = F.col("overlap") / (F.col("end_ms") - F.col("start_ms"))
    order = Window.partitionBy("video_id", "scene_id").orderBy(F.col("share").desc(), "start_ms", "seg_idx")
    ranked = pairs.withColumn("share", share).where(F.col("share") >= LEAST_RATIO)
    ranked = ranked.withColumn("n", F.row_number().over(order))
    ranked = ranked.withColumn("chars", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where((F.col("n") == 1) | ((F.col("n") <= MOST_SEGMENTS) & (F.col("chars") <= MOST_CHARS)))
    return kept.select("video_id", "scene_id", "scene_start", "scene_end", "seg_idx", "start_ms", "end_ms", F.left("text", F.lit(MOST_CHARS)).alias("text"), "overlap")


def coverage(speech: DataFrame) -> DataFrame:
    """(video_id, scene_id, coverage): overlap over the scene's length, at most 1; overlapping speech counts twice."""
    total = F.sum("overlap") / F.greatest(F.lit(1), F.first("scene_end") - F.first("scene_start"))
    return speech.groupBy("video_id", "scene_id").agg(F.least(total, F.lit(1.0)).alias("coverage"))


def cross_span(speech: DataFrame, scenes: DataFrame) -> DataFrame:
    """(video_id, scene_id, spanned, span): scenes that a scene's speech touches, and the share beyond its own."""
    spoken = speech.select("video_id", F.col("scene_id").alias("of_scene"), "seg_idx", "start_ms", "end_ms", "text")
    touched = overlaps(scenes, spoken.select("video_id", F.struct("of_scene", "seg_idx").alias("seg_idx"), "start_ms", "end_ms", "text"))
    counted = touched.groupBy("video_id", F.col("seg_idx.of_scene").alias("scene_id")).agg(F.countDistinct("scene_id").alias("spanned"))
    total = scenes.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    share = F.greatest(F.lit(0), F.col("spanned") - 1) / F.greatest(F.lit(1), F.col("n"))
    return counted.join(total, "video_id").select("video_id", "scene_id", "spanned", share.alias("span"))


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def gate(similarity: Column, key_overlap: Column, covered: Column, span: Column, chars: Column) -> tuple[Column, Column, Column]:
    """(relevance, relation, confidence) of a scene's speech.  A null similarity was not computed; null ``chars`` means no
    speech at all."""
    s, k, c = _unit((similarity - SIM_FLOOR) / SIM_SPAN), _unit(key_overlap / KEY_FULL), _unit(covered / COVER_FULL)
    base = F.when(similarity.isNotNull(), 0.45 * s + 0.30 * k + 0.25 * c).otherwise(0.55 * k + 0.45 * c)
    r = base * (1 - 0.35 * _unit(span / SPAN_FULL))
    relation = (
        F.when(chars.isNull() | (chars < LEAST_CHARS), "unknown")
        .when(r >= STRONG, "strong")
        .when(r >= CONTEXTUAL, "contextual")
        .when(r >= UNSURE, "unknown")
        .otherwise("independent")
    )
    confidence = (
        F.when(chars.isNull(), 0.0)
        .when(chars < LEAST_CHARS, 0.3)
        .when(r >= STRONG, 0.55 + 0.4 * (r - STRONG) / (1 - STRONG))
        .when(r >= CONTEXTUAL, 0.45 + 0.25 * (r - CONTEXTUAL) / (STRONG - CONTEXTUAL))
        .when(r >= UNSURE, 0.35)
        .otherwise(0.5 + 0.3 * (UNSURE - r) / UNSURE)
    )
    return r, relation, F.least(confidence, F.lit(0.95))


def gate_scenes(scenes: DataFrame, segments: DataFrame, visual: DataFrame) -> DataFrame:
    """(video_id, scene_id, coverage, span, key_overlap, relevance, relation, confidence) of scenes with speech.

    ``visual`` has (video_id, scene_id, description) and, where encoders ran, description_vector and speech_vector."""
    speech = scene_speech(overlaps(scenes, segments))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "seg_idx", "text"))), lambda x: x["text"]), " ")
    spoken = speech.groupBy("video_id", "scene_id").agg(said.alias("said"))
    rows = spoken.join(coverage(speech), ["video_id", "scene_id"]).join(cross_span(speech, scenes), ["video_id", "scene_id"])
    rows = rows.join(visual, ["video_id", "scene_id"], "left")
    similarity = cosine(F.col("description_vector"), F.col("speech_vector")) if {"description_vector", "speech_vector"} <= set(visual.columns) else F.lit(None).cast("double")
    key = X.keyword_overlap(X.keywords(F.col("description")), X.keywords(F.col("said")))
    rows = rows.withColumn("key_overlap", key)
    r, relation, confidence = gate(similarity, F.col("key_overlap"), F.col("coverage"), F.col("span"), F.length("said"))
    return rows.select("video_id", "scene_id", "coverage", "span", "key_overlap", r.alias("relevance"), relation.alias("relation"), confidence.alias("confidence"), "said")


RELATIONS = ("strong", "contextual", "independent", "unknown")
REPLY = "relation string, audio_type string, audio_summary string, fused_description string, confidence double"


def reconcile(rows: DataFrame) -> DataFrame:
    """The model's reply joined with the program's verdict.

    ``rows`` has reply, visual, said, relation and confidence (the program's).  A reply without a JSON object leaves the
    program's verdict and tells picture and sound apart; a parsed one decides the relation, with the higher confidence
    if both agree, else between 0.3 and 0.6.
    """
    reply = F.from_json(X.json_object(F.col("reply")), REPLY)
    rows = rows.withColumn("__r", reply).withColumn("__said", F.trim(F.coalesce("__r.audio_summary", F.lit(""))))
    parsed = F.col("__r").isNotNull() & ~F.coalesce(X.json_object(F.col("reply")).rlike(r"^\{\s*\}$"), F.lit(True))
    stated = F.lower(F.trim(F.coalesce("__r.relation", F.lit(""))))
    relation = F.when(stated.isin(*RELATIONS), stated).otherwise("unknown")
    model = F.coalesce("__r.confidence", F.lit(0.0))
    agreed = F.when(relation == F.col("relation"), F.greatest(model, F.col("confidence"))).otherwise(F.least(F.greatest(model, F.lit(0.3)), F.lit(0.6)))
    fused = F.trim(F.coalesce("__r.fused_description", F.lit("")))
    apart = F.concat(F.lit("visual: "), F.col("visual"), F.lit("\naudio: "), F.col("said"), F.lit(" (relation to the picture not confirmed)"))
    return rows.select(
        *[c for c in rows.columns if c not in ("__r", "__said", "relation", "confidence", "reply")],
        parsed.alias("from_model"),
        F.when(parsed, relation).otherwise(F.col("relation")).alias("relation"),
        F.when(parsed, agreed).otherwise(F.col("confidence")).alias("confidence"),
        F.when(parsed & (F.col("__said") != ""), F.col("__said")).otherwise(F.col("said")).alias("audio_summary"),
        F.when(~parsed, apart).when(fused != "", fused).otherwise(F.col("visual")).alias("fused"),
    )


def evidence_chunks(fused: DataFrame) -> DataFrame:
    """Up to three text chunks a scene: picture always, sound if summarised, the fusion if it says something else.

    ``fused`` has video_id, scene_id, start_ms, end_ms, visual, audio_summary, fused and has_audio."""
    kind = lambda name, evidence, text, keep: F.struct(F.lit(name).alias("chunk_type"), F.lit(evidence).alias("evidence"), F.col(text).alias("text"), keep.alias("keep"))
    kinds = F.array(
        kind("SceneSummary", "visual", "visual", F.lit(True)),
        kind("SceneAudio", "audio", "audio_summary", F.lit(True)),
        kind("SceneFused", "fused", "fused", F.col("has_audio") & (F.col("fused") != F.col("visual"))),
    )
    rows = fused.select("video_id", "scene_id", "start_ms", "end_ms", F.explode(F.filter(kinds, lambda x: x["keep"] & (F.coalesce(x["text"], F.lit("")) != ""))).alias("k"))
    ordinal = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(CHUNK_TYPES) for x in (n, i))), F.col("k.chunk_type"))
    ident = X.chunk_id(F.col("video_id"), ordinal, F.col("start_ms"), F.col("end_ms"), F.col("scene_id"))
    return rows.select(ident.alias("chunk_id"), "video_id", "scene_id", "start_ms", "end_ms", "k.chunk_type", "k.evidence", "k.text")


def scene_evidence(scenes: DataFrame, gated: DataFrame, visual: DataFrame, speech: DataFrame, fused: DataFrame | None = None) -> DataFrame:
    """A row a scene with all that is known of it: scenes' columns, keyframe_ms, description, visual_description, audio_summary,
    fused_description, audio_relation, relation_confidence and speech_segments (start_ms, end_ms, text, by time).

    ``gated`` is the gate's verdict, ``visual`` has description, ``speech`` is a scene's (bounded) speech, ``fused``, if there is
    one, audio_summary and fused.  What is not known is null; a scene without speech has an empty list, and its relation is
    unknown.  The description is the fused one if there is one.
    """
    at = ["video_id", "scene_id"]
    said = F.array_sort(F.collect_list(F.struct("start_ms", "seg_idx", "end_ms", "text")))
    spoken = speech.groupBy(*at).agg(F.transform(said, lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text"))).alias("speech_segments"))
    rows = scenes.select(*at, "start_ms", "end_ms", *(["keyframe_ms"] if "keyframe_ms" in scenes.columns else []))
    rows = rows if "keyframe_ms" in rows.columns else rows.withColumn("keyframe_ms", F.col("start_ms"))
    rows = rows.join(visual.select(*at, F.col("description").alias("visual_description")), at, "left")
    rows = rows.join(gated.select(*at, F.col("relation").alias("audio_relation"), F.col("confidence").alias("relation_confidence")), at, "left").join(spoken, at, "left")
    if fused is None:
        rows = rows.withColumn("audio_summary", F.lit(None).cast("string")).withColumn("fused_description", F.lit(None).cast("string"))
    else:
        rows = rows.join(fused.select(*at, "audio_summary", F.col("fused").alias("fused_description")), at, "left")
    none = F.array().cast(spoken.schema["speech_segments"].dataType)
    return rows.select(
        *at, "start_ms", "end_ms", "keyframe_ms", F.coalesce("fused_description", "visual_description").alias("description"), "visual_description", "audio_summary", "fused_description",
        F.coalesce("audio_relation", F.lit("unknown")).alias("audio_relation"), F.coalesce("relation_confidence", F.lit(0.0)).alias("relation_confidence"), F.coalesce("speech_segments", none).alias("speech_segments"),
    )


def transcript(segments: DataFrame, plain: bool = False) -> DataFrame:
    """(video_id, transcript): lines of [m:ss-m:ss] text, or the texts in a row."""
    line = F.col("text") if plain else F.concat(F.lit("["), X.transcript_label(F.col("start_ms")), F.lit("-"), X.transcript_label(F.col("end_ms")), F.lit("] "), F.trim("text"), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "seg_idx", line.alias("line")))), lambda x: x["line"])
    return segments.groupBy("video_id").agg(F.array_join(parts, " " if plain else "").alias("transcript"))


def transcript_range(segments: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Segments that touch a closed interval, in time order."""
    return segments.where((F.col("end_ms") >= start_ms) & (F.col("start_ms") <= end_ms)).orderBy("video_id", "start_ms", "seg_idx")


def display_text(relation: Column, visual: Column, audio: Column, fused: Column, confidence: Column, has_audio: Column) -> Column:
    """At most 240 characters for a timeline card; unrelated sound is shown apart from the picture."""
    tag = F.concat(F.lit("\n["), relation, F.lit(" · "), F.coalesce(X.fixed(confidence, 2), F.lit("null")), F.lit("]"))
    apart = F.concat(F.lit("visual: "), visual, F.lit("\naudio: "), audio, tag)
    joined = F.concat(fused, F.when(has_audio, tag).otherwise(""))
    return F.left(F.when((relation == "independent") & (audio != ""), apart).otherwise(joined), F.lit(240))
