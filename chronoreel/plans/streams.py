"""Streams over the given tables, run to their end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from chronoreel.session import shared_dir
from chronoreel.sources import fixtures as X
from chronoreel.sources import sse
from chronoreel.streaming import index as LI

THRESHOLD = 60.0
ARRIVALS = 3
#: Videos are users by their last digits, so that each has scenes enough; gaps and rings are of days, as the events are.
VIDEOS, KEEP_MS, IDLE_MS = 50, 6 * 3_600_000, 3 * 3_600_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session with the store that timers need, as it was before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, LI.PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def live_frames(spark, sf_dir):
    rows = X.frames(spark, sf_dir).withColumn("video_id", F.col("video_id") % VIDEOS)
    return rows.select("video_id", F.timestamp_millis("ts_ms").alias("ts"), "ts_ms", "event_id", "signal")


def arrivals(rows):
    """(frames with their arrival, the arrivals, the delay in ms): slots of event time, of which a third of the frames come one
    later.  One last frame of no video lets the watermark pass all others."""
    span = rows.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("z")).first()
    if span["a"] is None:
        return rows.withColumn("arrival", F.lit(0)), [], 1
    width = (span["z"] - span["a"]) // ARRIVALS + 1
    slot = F.floor((F.col("ts_ms") - span["a"]) / width)
    late = F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0
    clock = rows.sparkSession.createDataFrame([(-1, span["z"] + 10 * width + 10 * IDLE_MS, -1, 0.0)], "video_id long, ts_ms long, event_id long, signal double")
    clock = clock.select("video_id", F.timestamp_millis("ts_ms").alias("ts"), "ts_ms", "event_id", "signal").withColumn("arrival", F.lit(ARRIVALS + 1))
    return rows.withColumn("arrival", (slot + late.cast("int")).cast("int")).unionByName(clock), list(range(ARRIVALS + 2)), 2 * width


def live_scenes_shuffled(spark, sf_dir):
    """Scenes of frames that arrive out of order, as the live index closes them; the stream stops after each arrival and goes on
    from its checkpoint."""
    folder, rows = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", live_frames(spark, sf_dir)
    dealt, order, delay = arrivals(rows)
    with keyed_state(spark):
        for i in order:
            mixed = dealt.where(F.col("arrival") == i).drop("arrival").sortWithinPartitions(F.xxhash64("event_id"))
            mixed.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            found = LI.live_index(stream, THRESHOLD, f"{delay} milliseconds", KEEP_MS, IDLE_MS)
            query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    if not order:
        return spark.createDataFrame([], LI.SCENES)
    return spark.read.schema(LI.SCENES).parquet(f"{folder}/out").where("video_id >= 0")


LIVE_SQL = f"""WITH {X.FRAMES}, f AS (SELECT video_id % {VIDEOS} AS video_id, ts_ms, event_id, signal FROM frames),
g AS (SELECT *, lag(ts_ms) OVER w AS before, lag(signal) OVER w AS old FROM f WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms, event_id)),
s AS (SELECT *, before IS NULL OR ts_ms - before > {IDLE_MS} AS fresh, abs(signal - old) > {THRESHOLD} AS cut FROM g),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY video_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s),
c AS (SELECT *, CAST(sum((cut AND NOT fresh)::INT) OVER (PARTITION BY video_id, session ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scene_id,
  min(ts_ms) OVER (PARTITION BY video_id, session) AS session_ms FROM n),
r AS (SELECT video_id, session_ms, scene_id, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n_frames FROM c GROUP BY ALL)
SELECT video_id, session_ms, scene_id, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY video_id, session_ms ORDER BY scene_id), last_ms + 1000) AS end_ms, n_frames FROM r"""


#: Conversations of one log, and bytes of one piece.
TALKS, PIECE = 50, 7919


def event_pieces(spark, sf_dir):
    """Conversations as logs of events, cut every PIECE bytes wherever that is: (stream_id, place, data)."""
    c = X.table(spark, sf_dir, "conversations")
    delta = F.to_json(F.struct("conv_id", "turn", F.col("text").alias("content")))
    rows = c.select(F.coalesce(F.floor(F.col("conv_id") / TALKS), F.lit(-1)).alias("stream_id"), F.struct("conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("m")).alias("o"), sse.event_text(delta, F.concat_ws(" ", F.lit("turn"), "turn")).alias("e"))
    # where each event lies in its log, without a log in one row
    order = Window.partitionBy("stream_id").orderBy("o")
    at = F.sum(F.octet_length("e")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lying = rows.select("stream_id", F.encode("e", "UTF-8").alias("b"), (at - F.octet_length("e")).alias("a"), at.alias("z"))
    cut = lying.withColumn("place", F.explode(F.sequence(F.floor(F.col("a") / PIECE), F.floor((F.col("z") - 1) / PIECE))))
    low, high = F.greatest("a", F.col("place") * PIECE), F.least("z", (F.col("place") + 1) * PIECE)
    part = F.substring("b", (low - F.col("a") + 1).cast("int"), (high - low).cast("int"))
    parts = cut.groupBy("stream_id", "place").agg(F.array_sort(F.collect_list(F.struct(low.alias("low"), part.alias("part")))).alias("parts"))
    return parts.select("stream_id", "place", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["part"])).alias("data"))


def event_log_stream(spark, sf_dir):
    """Messages from event logs of which pieces arrive in three batches; the stream stops after each and goes on from its
    checkpoint."""
    spark.dataSource.register(sse.EventLogs)
    folder = f"{shared_dir(spark)}/sse-{uuid.uuid4().hex}"
    pieces = event_pieces(spark, sf_dir)
    pieces.write.parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")
    last = pieces.agg(F.max("place")).first()[0] or 0
    named = pieces.withColumn("name", F.lpad(F.col("place").cast("string"), 12, "0"))
    for third in range(3):
        sse.write_logs(named.where(F.floor(F.col("place") * 3 / (last + 1)) == third), f"{folder}/logs")
        query = spark.readStream.format("sse").load(f"{folder}/logs").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.schema(sse.SCHEMA).parquet(f"{folder}/out")
    m = F.from_json("payload", "struct<conv_id:bigint,turn:bigint,content:string>")
    return rows.select(m["conv_id"].alias("conv_id"), m["turn"].alias("turn"), F.md5(F.coalesce(m["content"], F.lit(""))).alias("content_md5"))


EVENTS_SQL = "SELECT conv_id, turn, md5(coalesce(text, '')) AS content_md5 FROM conversations"


QUERIES = {"live_scenes_shuffled": (live_scenes_shuffled, LIVE_SQL), "event_log_stream": (event_log_stream, EVENTS_SQL)}
