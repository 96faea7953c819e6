"""Named operators with JSON-schema parameters, for callers that choose them at run time."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.functions.sampling import range_times
from chronoreel.operators import align, search, segment


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict
    run: Callable[..., DataFrame]


class Registry:
    """Tools by name; registering a name again replaces the tool."""

    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        self._tools[tool.name] = tool

    def names(self) -> list[str]:
        return sorted(self._tools)

    def schema(self) -> str:
        """The tools as a JSON array of function declarations."""
        return json.dumps([{"name": t.name, "description": t.description, "parameters": t.parameters} for _, t in sorted(self._tools.items())])

    def call(self, name: str, tables: dict[str, DataFrame], arguments: str | dict) -> DataFrame:
        """The tool's result; unknown tools and missing arguments raise ValueError."""
        if name not in self._tools:
            raise ValueError(f"unknown tool: {name}")
        tool = self._tools[name]
        args = json.loads(arguments) if isinstance(arguments, str) else dict(arguments)
        if missing := [p for p in tool.parameters.get("required", []) if p not in args]:
            raise ValueError(f"{name}: missing {', '.join(missing)}")
        return tool.run(tables, **args)


def _object(required: list[str], **properties: str) -> dict:
    return {"type": "object", "properties": {k: {"type": v} for k, v in properties.items()}, "required": required}


def _search(tables, query_id: int, top_k: int = 5, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    asked = tables["questions"].where(F.col("query_id") == query_id)
    return search.retrieve(tables["chunks"], asked, top_k, start_gte=start_ms, end_lte=end_ms)


def _scene_info(tables, scene_id: int | None = None, timestamp_ms: int | None = None) -> DataFrame:
    scenes = tables["scenes"]
    if scene_id is not None:
        return scenes.where(F.col("scene_id") == scene_id)
    if timestamp_ms is None:
        raise ValueError("get_scene_info: scene_id or timestamp_ms is needed")
    points = scenes.select("video_id").distinct().select("video_id", F.lit(0).alias("point_id"), F.lit(timestamp_ms).alias("ts_ms"))
    return scenes.join(segment.scene_at(points, scenes).where("scene_id >= 0").select("video_id", "scene_id"), ["video_id", "scene_id"])


def _range(tables, start_ms: int, end_ms: int, sample_count: int = 5) -> DataFrame:
    if end_ms <= start_ms:
        raise ValueError("analyze_time_range: end_ms must lie after start_ms")
    one = tables["scenes"].sparkSession.range(1)
    return one.select(F.explode(range_times(F.lit(start_ms), F.lit(end_ms), F.lit(sample_count))).alias("ts_ms"))


def default_registry() -> Registry:
    """Search, transcript, scene and sampling tools over tables named chunks, questions, scenes and segments."""
    r = Registry()
    r.register(Tool("search_video_content", "Best matching chunks of a question", _object(["query_id"], query_id="integer", top_k="integer", start_ms="integer", end_ms="integer"), _search))
    r.register(Tool("get_transcript", "Speech that touches a time range", _object(["start_ms", "end_ms"], start_ms="integer", end_ms="integer"), lambda tables, start_ms, end_ms: align.transcript_range(tables["segments"], start_ms, end_ms)))
    r.register(Tool("get_scene_info", "A scene by number or time", _object([], scene_id="integer", timestamp_ms="integer"), _scene_info))
    r.register(Tool("analyze_time_range", "Sample times of a range", _object(["start_ms", "end_ms"], start_ms="integer", end_ms="integer", sample_count="integer"), _range))
    return r
