"""Batch and streaming forms give the same rows; sources and tools."""

import time

import pytest
from pyspark.sql import functions as F

from chronoreel.operators import extras, index, search, segment
from chronoreel.plans import extras as extra_plans
from chronoreel.plans import scenes as scene_plans
from chronoreel.sources import fixtures, media
from chronoreel.streaming import live
from chronoreel.tools import Tool, default_registry


def run_stream(spark, tmp_path, rows, operator, mode, name):
    """Writes rows as three files in order and streams them through the operator, one file a batch."""
    source = str(tmp_path / "in")
    for i, part in enumerate(rows):
        part.coalesce(1).write.mode("append").parquet(f"{source}/b={i}")
    stream = spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = operator(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def thirds(df, column, per=None):
    bounds = df.approxQuantile(column, [1 / 3, 2 / 3], 0.001)
    c = F.col(column)
    return [df.where(c <= bounds[0]), df.where((c > bounds[0]) & (c <= bounds[1])), df.where(c > bounds[1])]


def test_tool_calls(spark, sf_dir, tmp_path):
    deltas = extra_plans._whole_deltas(spark, sf_dir).withColumn("seq", F.col("seq").cast("long"))
    out = run_stream(spark, tmp_path, thirds(deltas, "seq"), live.assemble_calls, "update", "calls")
    last = {}
    for r in out.collect():
        key, held = (r.message_id, r.slot), last.get((r.message_id, r.slot))
        if held is None or len(r.arguments) >= len(held[2]):
            last[key] = (r.id, r.name, r.arguments, r.finish or None)
    want = {(r.message_id, r.slot): (r.id, r.name, r.arguments, r.finish or None) for r in extras.assemble_calls(deltas).collect()}
    assert last == want


def test_live_scenes(spark, sf_dir, tmp_path):
    frames = fixtures.frames(spark, sf_dir)
    out = run_stream(spark, tmp_path, thirds(frames, "ts_ms"), lambda s: live.live_scenes(s, 100.0), "append", "live_scenes")
    got = {(r.video_id, r.scene_id, r.start_ms, r.end_ms) for r in out.collect()}
    closed = scene_plans.scene_segments(spark, sf_dir)
    last = closed.groupBy("video_id").agg(F.max("scene_id").alias("last"))
    want = {tuple(r) for r in closed.join(last, "video_id").where("scene_id < last").select("video_id", "scene_id", "start_ms", "end_ms").collect()}
    assert got == want


def test_sse(spark, tmp_path):
    pieces = ['data: {"choices":[{"delta":{"content":"Hel"}}]}\n', '\n: note\n\nda', 'ta:{"choices":[{"delta":{"content":"lo"},"finish_reason":"stop"}]}\n\nevent: x\r\n\r\n', "data: [DONE]\n\ndata: late\n\ndata: unfinished"]
    raw = spark.createDataFrame([(1, i, p) for i, p in enumerate(pieces)], "stream_id long, seq long, data string")
    events = media.sse_events(raw)
    want = [(r.n, r.payload) for r in events.orderBy("n").collect()]
    assert [(r.content, r.finish) for r in media.chat_deltas(events).orderBy("n").collect()] == [("Hel", None), ("lo", "stop")]
    out = run_stream(spark, tmp_path, [raw.where(F.col("seq") == i) for i in range(4)], live.frame_events, "append", "sse")
    assert [(r.n, r.payload) for r in out.orderBy("n").collect()] == want


def test_sampled_frames(spark, sf_dir, tmp_path):
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("signal"))
    out = run_stream(spark, tmp_path, thirds(frames.withColumn("o", F.col("ts").cast("double")), "o"), lambda s: live.sample_frames(s.drop("o"), "1 day", "2 days"), "append", "sampled")
    batch = {(r.video_id, r.window_start): r.event_id for r in live.sample_frames(frames, "1 day", "2 days").collect()}
    got = {(r.video_id, r.window_start): r.event_id for r in out.collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_directory(spark, tmp_path):
    for name in ("b.mp4", "a.MKV", "c.txt"):
        (tmp_path / name).write_bytes(b"hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.mp4").write_bytes(b"x")
    rows = media.video_directory(spark, str(tmp_path), content=True).collect()
    assert [(r.name, r.size, r.video_id) for r in rows] == [("a.MKV", 5, "6bd4d7c29aedc3e1"), ("b.mp4", 5, "6bd4d7c29aedc3e1")]


def test_frames_codec(spark):
    df = spark.createDataFrame([([b"ab", b"\x00\xff"],)], "f array<binary>")
    assert [bytes(x) for x in df.select(media.decode_frames(media.encode_frames(F.col("f"))).alias("x")).first().x] == [b"ab", b"\x00\xff"]


def test_tools(spark, sf_dir):
    tables = {"segments": fixtures.segments(spark, sf_dir), "scenes": scene_plans.scene_segments(spark, sf_dir)}
    registry = default_registry()
    assert registry.call("get_transcript", tables, '{"start_ms": 0, "end_ms": 5000}').count() > 0
    assert [r.ts_ms for r in registry.call("analyze_time_range", tables, {"start_ms": 0, "end_ms": 1000, "sample_count": 3}).collect()] == [0, 500, 1000]
    assert registry.call("get_scene_info", tables, {"scene_id": 1}).count() > 0
    for name, args in (("nope", {}), ("get_transcript", {"start_ms": 1}), ("analyze_time_range", {"start_ms": 5, "end_ms": 5})):
        with pytest.raises(ValueError):
            registry.call(name, tables, args)
    registry.register(Tool("get_transcript", "new", {}, lambda t: t["segments"]))
    assert registry.call("get_transcript", tables, {}).columns == tables["segments"].columns and "new" in registry.schema()


def test_invariants(spark, sf_dir):
    """Scenes are contiguous; kept intervals of one type overlap by 0.7 at most; indexing again changes nothing."""
    by_video = {}
    for r in scene_plans.scene_segments(spark, sf_dir).orderBy("video_id", "scene_id").collect():
        if r.video_id in by_video:
            assert by_video[r.video_id] == r.start_ms
        by_video[r.video_id] = r.end_ms
    candidates = fixtures.dedup_candidates(spark, sf_dir)
    kept = search.remove_overlaps(candidates).select("query_id", "chunk_id").join(candidates, ["query_id", "chunk_id"])
    a, b = kept.alias("a"), kept.alias("b")
    both = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.chunk_type") == F.col("b.chunk_type")) & (F.col("a.chunk_id") < F.col("b.chunk_id")))
    ratio = search.overlap_ratio({c: F.col(f"a.{c}") for c in ("start_ms", "end_ms")}, {c: F.col(f"b.{c}") for c in ("start_ms", "end_ms")})
    assert both.where(ratio > 0.7).count() == 0
    chunks = scene_plans.evidence_fanout(spark, sf_dir).withColumn("v", F.lit(1))
    again = index.upsert(chunks, chunks.withColumn("v", F.lit(2)), ["chunk_id"], "v")
    assert again.count() == chunks.count() and again.where("v = 1").count() == 0


def test_points_on_boundaries(spark):
    scenes = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 200), (1, 2, 150, 90_000_000)], "video_id int, scene_id long, start_ms long, end_ms long")
    points = spark.createDataFrame([(1, 0, 0), (1, 1, 99), (1, 2, 100), (1, 3, 160), (1, 4, 89_999_999), (1, 5, 90_000_000), (2, 6, 5)], "video_id int, point_id int, ts_ms long")
    got = {r.point_id: r.scene_id for r in segment.scene_at(points, scenes).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: -1, 6: -1}


def test_silent_streams_leave_nothing(spark, tmp_path):
    """With a time limit, state of calls and of event streams goes once they have been silent for long."""
    pieces, raw = "message_id long, slot int, seq long, id string, name string, arguments string, finish string", "stream_id long, seq long, data string"
    for operator, rows, schema, mode in (
        (live.assemble_calls, [(i, 0, 0, "c", "n", "{}", None) for i in range(3)], pieces, "update"),
        (live.frame_events, [(i, 0, f"data: {i}\n\nda") for i in range(3)], raw, "append"),
    ):
        source = str(tmp_path / operator.__name__)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
        stream = operator(spark.readStream.schema(schema).parquet(source), idle_ms=1)
        query = stream.writeStream.format("noop").outputMode(mode).option("checkpointLocation", f"{source}-cp").trigger(processingTime="0 seconds").start()
        try:
            until, left = time.time() + 60, None
            while time.time() < until and left != 0:
                time.sleep(0.5)
                seen = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
                left = seen[-1].numRowsTotal if any(p.numRowsUpdated for p in seen) else None
        finally:
            query.stop()
        assert left == 0
