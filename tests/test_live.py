"""The live index: order, eviction, bounded state, reading while it runs, restart."""

import pytest
from pyspark.sql import functions as F

from chronoreel.plans import streams
from chronoreel.streaming import index as LI


def frames(spark, rows):
    df = spark.createDataFrame(rows, "video_id long, ts_ms long, event_id long, signal double")
    return df.select("video_id", F.timestamp_millis("ts_ms").alias("ts"), "ts_ms", "event_id", "signal")


@pytest.fixture
def run(spark, tmp_path):
    """Each call writes one batch of frames and goes on from the checkpoint until it is taken."""

    def step(rows, late="10 seconds", keep=60_000, idle=30_000):
        frames(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frames(spark, []).schema).parquet(str(tmp_path / "in"))
        with streams.keyed_state(spark):
            query = LI.live_index(stream, 5.0, late, keep, idle).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination()
        out = {tuple(r) for r in spark.read.schema(LI.SCENES).parquet(str(tmp_path / "out")).collect()}
        with streams.keyed_state(spark):
            ring = sorted((r.video_id, r.ts_ms, r.scene_id) for r in LI.ring(spark, str(tmp_path / "cp")).collect())
        return out, ring, query.lastProgress

    return step


def test_late_frames_are_put_in_order(run):
    # the frame of 2000 comes after those of 3000 and 9000, in another batch
    out, ring, _ = run([(1, 1000, 1, 0.0), (1, 3000, 3, 10.0), (1, 9000, 4, 10.0)])
    assert out == set() and ring == []
    out, ring, _ = run([(1, 2000, 2, 1.0), (1, 16_000, 5, 20.0)])
    assert ring == [(1, 1000, 0), (1, 2000, 0), (1, 3000, 1)] and out == {(1, 1000, 0, 1000, 3000, 2)}
    # behind the watermark (6000): too late
    out, ring, _ = run([(1, 5000, 9, 99.0), (1, 30_000, 6, 20.0)])
    assert out == {(1, 1000, 0, 1000, 3000, 2), (1, 1000, 1, 3000, 16_000, 2)}
    assert [x[1] for x in ring] == [1000, 2000, 3000, 9000, 16_000]


def test_idle_videos_leave_nothing(run):
    run([(1, 1000, 1, 0.0), (2, 1000, 2, 0.0)])
    out, ring, last = run([(2, 200_000, 3, 0.0)])
    # both first sessions have ended; the frame of 200 s waits
    assert out == {(1, 1000, 0, 1000, 2000, 1), (2, 1000, 0, 1000, 2000, 1)} and ring == []
    out, ring, _ = run([(3, 400_000, 4, 0.0)])
    assert (2, 200_000, 0, 200_000, 201_000, 1) in out and ring == []


def test_ring_is_bounded(run):
    """A frame a second for ten minutes: the ring keeps a minute, whatever came before."""
    sizes = []
    for i in range(5):
        _, ring, last = run([(1, 1000 * (120 * i + j), 120 * i + j, float(j % 2 * 10)) for j in range(120)])
        sizes.append(len(ring))
        assert all(a[1] < b[1] for a, b in zip(ring, ring[1:], strict=False))
    assert max(sizes) <= 61 and sizes[-1] == 61


def test_no_frames(spark, tmp_path):
    empty = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    empty.write.parquet(str(tmp_path / "events.parquet"))
    assert streams.live_scenes_shuffled(spark, str(tmp_path)).collect() == []


def test_state_goes_in_blocks(run, spark, tmp_path):
    """What waits for the watermark is some list elements a video, not one a frame, and comes back in order, across blocks too."""
    n = 2 * LI.BLOCK + 7
    rows = [(1, 1_000 + i, i, float(i // 1000 * 10)) for i in range(n)]
    run(rows[::-1])
    with streams.keyed_state(spark):
        held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "waiting").load()
        assert held.count() == 3
    out, ring, _ = run([(2, 20_000, 9_999, 0.0), (1, 9_000, 9_998, 20.0)])
    assert out == {(1, 1000, 0, 1000, 2000, 1000), (1, 1000, 1, 2000, 3000, 1000)}
    assert ring == [(1, ts, (ts - 1000) // 1000) for _, ts, *_ in rows] + [(1, 9000, 2)]
