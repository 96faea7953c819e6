"""Retrieval tables derived from the generic test tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts_ms(ts) -> F.Column:
    return F.unix_millis(ts.cast("timestamp"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("chunk_id"),
        F.col("label").cast("long").alias("video_id"),
        (v % 4).cast("int").alias("collection"),
        ((v % 97) * 1000).alias("start_ms"),
        ((v % 97) * 1000 + 1500 + (v % 5) * 500).alias("end_ms"),
        (v % 7).cast("int").alias("chunk_type"),
        "embedding",
    )


CHUNKS = """chunks AS (
  SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS video_id, CAST(vec_id % 4 AS INTEGER) AS collection,
         (vec_id % 97) * 1000 AS start_ms, (vec_id % 97) * 1000 + 1500 + (vec_id % 5) * 500 AS end_ms,
         CAST(vec_id % 7 AS INTEGER) AS chunk_type, embedding::DOUBLE[] AS embedding
  FROM embeddings)"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("query_video"), F.col("embedding").alias("query"))


QUERY_VECTORS = "query_vectors AS (SELECT vec_id AS query_id, CAST(label AS BIGINT) AS query_video, embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id % 20 = 0)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), ts_ms(F.col("ts")).alias("ts_ms"), "event_id", F.col("value").alias("signal"))


FRAMES = "frames AS (SELECT user_id AS video_id, epoch_us(ts) // 1000 AS ts_ms, event_id, value AS signal FROM events)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 4000
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_idx"), start.alias("start_ms"), (start + 50 * F.length("text")).alias("end_ms"), "text")


SEGMENTS = "segments AS (SELECT conv_id AS video_id, turn AS seg_idx, turn * 4000 AS start_ms, turn * 4000 + 50 * length(text) AS end_ms, text FROM conversations)"


def seg_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for every 10 s of a conversation, up to its last segment's end."""
    ends = segments(spark, sf_dir).groupBy("video_id").agg(F.max("end_ms").alias("stop"))
    grid = ends.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("stop") - 1) / 10000)))).alias("scene_id"))
    return grid.select("video_id", "scene_id", (F.col("scene_id") * 10000).alias("start_ms"), (F.col("scene_id") * 10000 + 10000).alias("end_ms"))


SEG_SCENES = """ends AS (SELECT video_id, max(end_ms) AS stop FROM segments GROUP BY video_id),
seg_scenes AS (
  SELECT video_id, scene_id, scene_id * 10000 AS start_ms, scene_id * 10000 + 10000 AS end_ms
  FROM (SELECT video_id, unnest(range(0, greatest(0, (stop - 1) // 10000) + 1)) AS scene_id FROM ends))"""


def dedup_candidates(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The k strongest events of each user as scored intervals of ten days: the bounded list dedup is made for."""
    best = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    rows = table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    start = ts_ms(F.col("ts"))
    return rows.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("event_type").alias("chunk_type"), start.alias("start_ms"), (start + 864_000_000).alias("end_ms"), F.col("value").alias("score"), "rank")


DEDUP_CANDIDATES = """ranked AS (
  SELECT user_id AS query_id, event_id AS chunk_id, event_type AS chunk_type, epoch_us(ts) // 1000 AS start_ms,
         epoch_us(ts) // 1000 + 864000000 AS end_ms, value AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
dedup_candidates AS (SELECT * FROM ranked WHERE rank <= 20)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


MESSAGES = "messages AS (SELECT conv_id AS conversation_id, turn AS seq, role, text AS content FROM conversations)"
