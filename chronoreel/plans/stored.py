"""Stored tables and staged builds over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoreel.operators import levels as L
from chronoreel.operators import segment
from chronoreel.session import shared_dir
from chronoreel.sources import fixtures as X
from chronoreel.sources.store import Store

CHUNK = "chunk_id long, video_id long, collection int, start_ms long, end_ms long, version int"


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store_lifecycle(spark, sf_dir):
    """Chunks are stored, every seventh comes again in a later version and some anew, video 3 goes, and video 5 is built
    again from its even chunks; then what is stored is read."""
    v = F.col("chunk_id")
    chunks = X.chunks(spark, sf_dir).drop("embedding", "chunk_type").withColumn("version", F.lit(1))
    store = Store(spark, _folder(spark, "store"), CHUNK, buckets=8)
    store.upsert(chunks, ["chunk_id"], "version")
    later = chunks.where("chunk_id % 7 = 0").withColumn("end_ms", F.col("end_ms") + 1).withColumn("version", F.lit(2))
    fresh = chunks.where("chunk_id % 50 = 0").withColumn("chunk_id", v + 1_000_000)
    store.upsert(later.unionByName(fresh), ["chunk_id"], "version")
    # an older version comes late and changes nothing
    store.upsert(chunks.where("chunk_id % 7 = 0 and chunk_id % 2 = 0"), ["chunk_id"], "version")
    store.remove(spark.range(3, 4).select(F.col("id").alias("video_id")))
    store.rebuild(spark.range(5, 6).select(F.col("id").alias("video_id")), chunks.where("chunk_id % 2 = 0").withColumn("version", F.lit(3)))
    store.clean()
    return store.read()


LIFECYCLE_SQL = f"""WITH {X.CHUNKS}, c AS (SELECT chunk_id, video_id, collection, start_ms, end_ms FROM chunks),
s AS (SELECT chunk_id, video_id, collection, start_ms, end_ms + CASE WHEN chunk_id % 7 = 0 THEN 1 ELSE 0 END AS end_ms, CASE WHEN chunk_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM c
  UNION ALL SELECT chunk_id + 1000000, video_id, collection, start_ms, end_ms, 1 FROM c WHERE chunk_id % 50 = 0)
SELECT * FROM s WHERE video_id IS NULL OR video_id NOT IN (3, 5) UNION ALL SELECT *, 3 FROM c WHERE video_id = 5 AND chunk_id % 2 = 0"""


THRESHOLD = 60.0


def _scenes(videos, inputs, below):
    found = segment.scenes(segment.differences(inputs["frames"]), THRESHOLD)
    return found.select("video_id", "scene_id", "start_ms", "end_ms", F.col("n_frames").cast("long").alias("n_frames"))


def _speech(videos, inputs, below):
    """Speech with what the video's scenes are."""
    scenes = below.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_scenes"), F.sum("n_frames").alias("n_frames"))
    return inputs["segments"].join(scenes, "video_id")


def _summaries(videos, inputs, below):
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return below.groupBy("video_id").agg(F.max("n_scenes").alias("n_scenes"), F.count(F.lit(1)).alias("n_segments"), F.sum(words).cast("long").alias("n_words"), F.min_by("text", "seg_idx").alias("opening"))


LEVELS = (
    L.Level("L0", ("frames",), "video_id long, scene_id long, start_ms long, end_ms long, n_frames long", _scenes),
    L.Level("L1", ("segments",), "video_id long, seg_idx long, start_ms long, end_ms long, text string, n_scenes long, n_frames long", _speech),
    L.Level("L2", (), "video_id long, n_scenes long, n_segments long, n_words long, opening string", _summaries),
)


def progressive_levels(spark, sf_dir):
    """Scenes, speech and summaries of all videos, built twice: first without every 500th frame and the last turns of each
    tenth video, then with all.  What didn't change keeps its first run's number."""
    built = L.Levels(spark, _folder(spark, "levels"), LEVELS, buckets=8)
    frames, segments = X.frames(spark, sf_dir), X.segments(spark, sf_dir)
    built.run({"frames": frames.where("event_id % 500 > 0"), "segments": segments.where("not (video_id % 10 = 0 and seg_idx >= 4)")})
    built.run({"frames": frames, "segments": segments})
    lines = [
        built.read("L0").groupBy("video_id", "built").agg(F.count(F.lit(1)).alias("n"), F.sum("n_frames").alias("total")).select(F.lit("L0").alias("level"), "*"),
        built.read("L1").groupBy("video_id", "built").agg(F.count(F.lit(1)).alias("n"), F.max("n_scenes").alias("total")).select(F.lit("L1").alias("level"), "*"),
        built.read("L2").select(F.lit("L2").alias("level"), "video_id", "built", F.col("n_segments").alias("n"), F.col("n_words").alias("total")),
    ]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


LEVELS_SQL = rf"""WITH {X.FRAMES}, {X.SEGMENTS}, d AS (SELECT *, coalesce(abs(signal - lag(signal) OVER (PARTITION BY video_id ORDER BY ts_ms, event_id)), 0) > {THRESHOLD} AS opens FROM frames),
l0 AS (SELECT video_id, CAST(1 + count(*) FILTER (opens) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS total, CASE WHEN bool_or(event_id % 500 = 0) AND bool_or(event_id % 500 > 0) THEN 2 WHEN bool_or(event_id % 500 = 0) THEN 1 ELSE 1 END AS built0,
  NOT bool_or(event_id % 500 > 0) AS late FROM d GROUP BY 1),
b0 AS (SELECT video_id, n, total, CASE WHEN built0 = 2 OR late THEN 2 ELSE 1 END AS built FROM l0),
l1 AS (SELECT s.video_id, CAST(count(*) AS BIGINT) AS n, max(b0.n) AS total, CASE WHEN max(b0.built) = 2 OR (s.video_id % 10 = 0 AND bool_or(seg_idx >= 4)) THEN 2 ELSE 1 END AS built,
  CAST(sum(len(regexp_split_to_array(trim(text, ' '), '\s+'))) AS BIGINT) AS words FROM segments s JOIN b0 USING (video_id) GROUP BY 1)
SELECT 'L0' AS level, video_id, CAST(built AS BIGINT) AS built, n, total FROM b0 UNION ALL SELECT 'L1', video_id, built, n, total FROM l1 UNION ALL SELECT 'L2', video_id, built, n, words FROM l1"""


QUERIES = {
    "store_lifecycle": (store_lifecycle, LIFECYCLE_SQL),
    "progressive_levels": (progressive_levels, LEVELS_SQL),
}
