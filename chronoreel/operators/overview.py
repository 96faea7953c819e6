"""Scene lists for readers: overviews, fallback scenes, confirmed boundaries, timeline bars, recent files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scenes that an overview lists.
OVERVIEW_SCENES = 15
#: A boundary's probability must be above this.
BOUNDARY_PROBABILITY = 0.3
#: Characters of a description in an overview.
DESCRIPTION = 60


def confirmed_boundaries(frames: DataFrame, least: float = BOUNDARY_PROBABILITY) -> DataFrame:
    """(video_id, ts_ms, event_id, probability) of frames whose given boundary probability is above ``least``.  A video's
    last frame opens nothing and is left out, so a single frame gives no boundary.  Null probabilities are none."""
    last = F.lead(F.lit(1)).over(Window.partitionBy("video_id").orderBy("ts_ms", "event_id")).isNull()
    return frames.withColumn("__last", last).where(~F.col("__last") & (F.col("probability") > least)).select("video_id", "ts_ms", "event_id", "probability")


def with_fallback(scenes: DataFrame, videos: DataFrame) -> DataFrame:
    """``scenes`` (video_id, scene_id, start_ms, end_ms, keyframe_ms) and one scene 0 from 0 to the end for each of ``videos``
    (video_id, duration_ms, first_sample_ms) without any; its key frame is the first sample, else the middle."""
    bare = videos.join(scenes.select("video_id").distinct(), "video_id", "left_anti")
    key = F.coalesce(F.col("first_sample_ms"), F.floor(F.col("duration_ms") / 2)).cast("long")
    single = bare.select("video_id", F.lit(0).cast("long").alias("scene_id"), F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), key.alias("keyframe_ms"))
    return scenes.select(*single.columns).unionByName(single)


def overview(scenes: DataFrame, most: int = OVERVIEW_SCENES) -> DataFrame:
    """(video_id, place, scene_id, start_ms, end_ms, description, n_scenes, more): the first ``most`` scenes of each video
    with the start of their description; ``more`` tells that the video has others, ``n_scenes`` how many it has in all."""
    of = Window.partitionBy("video_id")
    placed = scenes.withColumn("place", F.row_number().over(of.orderBy("scene_id"))).withColumn("n_scenes", F.count(F.lit(1)).over(of))
    short = F.left(F.coalesce("description", F.lit("")), F.lit(DESCRIPTION))
    return placed.where(F.col("place") <= most).select("video_id", "place", "scene_id", "start_ms", "end_ms", short.alias("description"), "n_scenes", (F.col("n_scenes") > most).alias("more"))


def timeline_bar(start: Column, end: Column, duration: Column) -> tuple[Column, Column, Column]:
    """Whole percentages before, in (two at least) and after a scene's bar; null without a duration above 0."""
    whole = F.when(duration > 0, duration)
    left = F.round(start / whole * 100).cast("long")
    width = F.greatest(F.lit(2), F.round((end / whole - start / whole) * 100)).cast("long")
    width = F.when(whole.isNotNull(), width)
    return left, width, F.greatest(F.lit(0), 100 - left - width).cast("long")


def frame_bytes(pixel_format: Column, width: Column, height: Column) -> Column:
    """Bytes of a raw picture: three halves a pixel for planar formats, four for packed ones, null for others."""
    pixels = width.cast("long") * height.cast("long")
    return F.when(pixel_format.isin("YUV420P", "NV12"), F.floor(pixels * 3 / 2)).when(pixel_format.isin("RGBA", "BGRA"), pixels * 4).cast("long")


def recent_existing(files: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` files opened last (ties: the smaller path) that still exist: files are looked up after the limit, so
    there may be fewer.  Rows that repeat a path count one by one."""
    newest = files.orderBy(F.col("opened_ms").desc_nulls_last(), F.col("path")).limit(limit)
    return newest.join(existing.select("path").distinct(), "path", "left_semi")
