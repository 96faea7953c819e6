"""The tools as SQL table functions: ``SELECT * FROM get_scene_info(TABLE(scenes), scene_id => 1)``.

Table arguments are dealt out and sorted by Spark, as each function's ``analyze`` asks; what a function holds of a video is
bounded.  Results have the table's own columns, whatever they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _columns(tool: str, table: AnalyzeArgument, *needed: str) -> list[T.StructField]:
    if not table.isTable:
        raise ValueError(f"{tool}: the first argument is a table")
    names = table.dataType.names
    if missing := [c for c in needed if c not in names]:
        raise ValueError(f"{tool}: the table has no {', '.join(missing)}")
    return list(table.dataType.fields)


def _given(tool: str, **numbers: AnalyzeArgument | None) -> dict[str, int | None]:
    """Constant numbers; None for those that are not given or null."""
    out = {}
    for name, argument in numbers.items():
        if argument is not None and not argument.isConstantExpression:
            raise ValueError(f"{tool}: {name} has to be a constant")
        out[name] = None if argument is None else argument.value
    return out


def _label(ms: int) -> str:
    """M:SS with minutes beyond 59."""
    minutes, seconds = divmod(ms // 1000, 60)
    return f"{minutes}:{seconds:02d}"


class GetTranscript:
    """Segments that touch a closed interval, with their time label."""

    @staticmethod
    def analyze(segments: AnalyzeArgument, start_ms: AnalyzeArgument, end_ms: AnalyzeArgument) -> AnalyzeResult:
        fields = _columns("get_transcript", segments, "video_id", "start_ms", "end_ms")
        if None in _given("get_transcript", start_ms=start_ms, end_ms=end_ms).values():
            raise ValueError("get_transcript: start_ms and end_ms are needed")
        schema = T.StructType([*(f for f in fields if f.name != "label"), T.StructField("label", T.StringType())])
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row, start_ms: int, end_ms: int) -> Iterator[tuple]:
        if row["start_ms"] is not None and row["end_ms"] is not None and row["end_ms"] >= start_ms and row["start_ms"] <= end_ms:
            yield *(row[c] for c in row.__fields__ if c != "label"), f"{_label(row['start_ms'])}-{_label(row['end_ms'])}"


class GetSceneInfo:
    """Scenes by number or, in each video, the first that holds a time, with all the columns of the table: the evidence."""

    @staticmethod
    def analyze(scenes: AnalyzeArgument, scene_id: AnalyzeArgument | None = None, timestamp_ms: AnalyzeArgument | None = None) -> AnalyzeResult:
        fields = _columns("get_scene_info", scenes, "video_id", "scene_id", "start_ms", "end_ms")
        given = _given("get_scene_info", scene_id=scene_id, timestamp_ms=timestamp_ms)
        if given["scene_id"] is None and given["timestamp_ms"] is None:
            raise ValueError("get_scene_info: scene_id or timestamp_ms is needed")
        return AnalyzeResult(schema=T.StructType(fields), partitionBy=[PartitioningColumn("video_id")], orderBy=[OrderingColumn("scene_id")])

    def __init__(self):
        self.found = False

    def eval(self, row: Row, scene_id: int | None = None, timestamp_ms: int | None = None) -> Iterator[tuple]:
        if scene_id is not None and scene_id >= 0:
            if row["scene_id"] == scene_id:
                yield tuple(row)
        elif not self.found and timestamp_ms is not None and None not in (row["scene_id"], row["start_ms"], row["end_ms"]) and row["start_ms"] <= timestamp_ms < row["end_ms"]:
            self.found = True
            yield tuple(row)


class SearchVideoContent:
    """In each video the ``top_k`` chunks nearest to a question's vector, with score and rank."""

    @staticmethod
    def analyze(chunks: AnalyzeArgument, query: AnalyzeArgument, top_k: AnalyzeArgument | None = None) -> AnalyzeResult:
        fields = _columns("search_video_content", chunks, "video_id", "chunk_id", "embedding")
        _given("search_video_content", query=query, top_k=top_k)
        kept = [f for f in fields if f.name not in ("embedding", "score", "rank")]
        schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("video_id")])

    def __init__(self):
        self.best: list[tuple] = []
        self.unit = None

    def eval(self, row: Row, query: list[float], top_k: int = 5) -> None:
        if self.unit is None:
            q = np.asarray(query or [], dtype=np.float64)
            length = np.sqrt(q @ q)
            self.unit, self.k = (q / length if length > 0 else q), top_k or 0
        v = np.asarray(row["embedding"] or [], dtype=np.float64)
        if self.k <= 0 or not len(v) or v.shape != self.unit.shape:
            return
        length = np.sqrt(v @ v)
        score = round(float(self.unit @ v / length), 6) + 0.0 if length > 0 else 0.0
        if score < 0:
            return
        item = (score, _Falling(row["chunk_id"]), [row[c] for c in row.__fields__ if c not in ("embedding", "score", "rank")])
        if len(self.best) < self.k:
            heapq.heappush(self.best, item)
        elif item[:2] > self.best[0][:2]:
            heapq.heapreplace(self.best, item)

    def terminate(self) -> Iterator[tuple]:
        for rank, (score, _, values) in enumerate(sorted(self.best, key=lambda x: x[:2], reverse=True), 1):
            yield *values, score, rank


class _Falling:
    """A key of which the smaller one counts for more."""

    def __init__(self, key: Any):
        self.key = key

    def __lt__(self, other: _Falling) -> bool:
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Falling) and self.key == other.key


class AnalyzeTimeRange:
    """2 to 10 times of a range, a whole step apart."""

    def eval(self, start_ms: int, end_ms: int, sample_count: int = 5) -> Iterator[tuple]:
        if end_ms <= start_ms:
            raise ValueError("analyze_time_range: end_ms must lie after start_ms")
        n = min(max(sample_count, 2), 10)
        step = (end_ms - start_ms) // (n - 1)
        for i in range(n):
            yield (start_ms + i * step,)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, tool, kind in (("get_transcript", GetTranscript, None), ("get_scene_info", GetSceneInfo, None), ("search_video_content", SearchVideoContent, None), ("analyze_time_range", AnalyzeTimeRange, "ts_ms long")):
        spark.udtf.register(name, udtf(tool, returnType=kind) if kind else udtf(tool))
