"""Data model: chunks, scenes, speech segments, entities, conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinals of chunk types (they enter chunk ids) and collection names.
CHUNK_TYPES = ("SceneSummary", "SpeechSegment", "Event", "FrameDesc", "QAcache", "SceneAudio", "SceneFused")
COLLECTIONS = ("visual_frames", "text_segments", "entity_profiles", "qa_cache")

CHUNK = "chunk_id string, collection string, video_id string, start_ms long, end_ms long, chunk_type string, text_content string, text_embedding array<float>, frame_embedding array<float>, keyframe_path string, metadata_json string, created_at timestamp, accessed_at timestamp"
SCENE = "video_id string, scene_id int, start_ms long, end_ms long, keyframe_ms long, keyframe_path string, visual_description string, audio_summary string, fused_description string, audio_relation string, relation_confidence double, audio_type string"
SEGMENT = "video_id string, seg_idx int, start_ms long, end_ms long, text string"
ENTITY = "video_id string, entity_id string, entity_type string, description string, aliases array<string>, appearances array<struct<scene_id:int,timestamp_ms:long,description:string>>, embedding array<float>"
MESSAGE = "conversation_id string, seq long, role string, content string"


def one_of(ordinal: Column, names: tuple[str, ...], unknown: str) -> Column:
    """Name of an ordinal; numbers outside the list give ``unknown``."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), ordinal.cast("int")), F.lit(unknown))


def chunk_type_name(ordinal: Column) -> Column:
    return one_of(ordinal, CHUNK_TYPES, "SceneSummary")


def chunk_type_ordinal(name: Column) -> Column:
    """Ordinal of a name; unknown names count as SceneSummary."""
    position = F.array_position(F.array(*map(F.lit, CHUNK_TYPES)), name)
    return F.coalesce(F.greatest(position - 1, F.lit(0)), F.lit(0)).cast("int")


def from_label(label: Column, names: tuple[str, ...], unknown: str = "unknown") -> Column:
    """The name that a label means, whatever its case and the space around it; ``unknown`` for any other, null too."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"^\s+|\s+$", "")))
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.lower(n) == plain), 0), F.lit(unknown))


def valid_chunk(chunk_id: Column, start: Column, end: Column) -> Column:
    return F.coalesce((chunk_id != "") & (end >= start), F.lit(False))


def valid_scene(scene_id: Column, start: Column, end: Column) -> Column:
    return F.coalesce((scene_id >= 0) & (end > start), F.lit(False))


def valid_segment(start: Column, end: Column) -> Column:
    return F.coalesce(end > start, F.lit(False))
