"""Scenes from ordered frame signals, and lookups of points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAIL_MS = 1000
#: Mean sampling interval above which only the histogram score is usable.
SPARSE_MS = 2000


def differences(frames: DataFrame, distance=None) -> DataFrame:
    """Frames with ``score``: the distance to the frame before (null for a video's first).  ``distance`` takes the earlier
    and the later signal; the default is their absolute difference."""
    distance = distance or (lambda a, b: F.abs(b - a))
    order = Window.partitionBy("video_id").orderBy("ts_ms", "event_id")
    return frames.withColumn("score", distance(F.lag("signal").over(order), F.col("signal")))


def boundaries(scored: DataFrame, threshold: float) -> DataFrame:
    """(video_id, ts_ms, event_id, score) of frames that open a new scene."""
    return scored.where(F.col("score") > threshold).select("video_id", "ts_ms", "event_id", "score")


def scenes(scored: DataFrame, threshold: float) -> DataFrame:
    """(video_id, scene_id, start_ms, end_ms, keyframe_ms, n_frames).

    A frame whose score exceeds the threshold opens a scene; a scene ends where the next one starts and the last one a
    second after the last frame.  Scenes are contiguous from the first frame on; one frame makes one scene.
    """
    order = Window.partitionBy("video_id").orderBy("ts_ms", "event_id")
    opened = F.sum((F.coalesce(F.col("score"), F.lit(0.0)) > threshold).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = scored.withColumn("scene_id", opened).groupBy("video_id", "scene_id")
    runs = runs.agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n_frames"))
    following = F.lead("start_ms").over(Window.partitionBy("video_id").orderBy("scene_id"))
    return runs.select("video_id", "scene_id", "start_ms", F.coalesce(following, F.col("last_ms") + TAIL_MS).alias("end_ms"), F.col("start_ms").alias("keyframe_ms"), "n_frames")


def sampling_density(frames: DataFrame) -> DataFrame:
    """(video_id, n, mean_interval_ms, sparse): whole milliseconds between frames on average."""
    g = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("z"))
    mean = F.when(F.col("n") > 1, F.floor((F.col("z") - F.col("a")) / (F.col("n") - 1))).otherwise(F.lit(0)).cast("long")
    return g.select("video_id", "n", mean.alias("mean_interval_ms"), (mean > SPARSE_MS).alias("sparse"))


def cells(start: Column, end: Column, width_ms: int) -> Column:
    """Numbers of the time cells that a half-open interval touches (none if it is empty)."""
    span = F.sequence(F.floor(start / width_ms), F.floor((end - 1) / width_ms))
    return F.when(end > start, span).otherwise(F.array().cast("array<long>"))


def scene_at(points: DataFrame, scenes: DataFrame, width_ms: int = 6 * 3_600_000) -> DataFrame:
    """``points`` (video_id, point_id, ts_ms) with the smallest scene whose half-open interval holds them, -1 if none.

    The join is on (video, time cell) with the range as residual, so a video of any length spreads over many keys.
    """
    s = scenes.select(F.col("video_id").alias("v"), F.explode(cells(F.col("start_ms"), F.col("end_ms"), width_ms)).alias("cell"), "scene_id", "start_ms", "end_ms")
    p = points.withColumn("__cell", F.floor(F.col("ts_ms") / width_ms))
    on = (p["video_id"] == s["v"]) & (p["__cell"] == s["cell"]) & (p["ts_ms"] >= s["start_ms"]) & (p["ts_ms"] < s["end_ms"])
    return p.join(s, on, "left").groupBy("video_id", "point_id", "ts_ms").agg(F.coalesce(F.min("scene_id"), F.lit(-1)).cast("long").alias("scene_id"))
