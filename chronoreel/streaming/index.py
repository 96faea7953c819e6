"""A live index of frames: put in order by event time, cut into scenes, and kept as a ring that can be read meanwhile.

Frames may come in any order within the watermark's delay.  They wait in list state until the watermark has passed them;
an event-time timer then takes them in order, closes scenes and moves them to the ring.  The ring holds the last ``keep_ms``
of a video, first in, first out.  A gap of more than ``idle_ms`` ends a session: its last scene closes, and a video
that nothing more comes for loses all its state.  So what a video holds is bounded by its frame rate times the delay and the
ring's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoreel.operators.segment import TAIL_MS

KEEP_MS = IDLE_MS = 30 * 60_000
#: Keyed state with lists and timers needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SCENES = "video_id long, session_ms long, scene_id long, start_ms long, end_ms long, n_frames long"
_FRAME = "ts_ms long, event_id long, signal double"
_FRAMES = "ts_ms array<long>, event_id array<long>, signal array<double>"
#: Frames of one list element: state goes to and from Python element by element, which costs more than a frame.
BLOCK = 1024


def blocks(frames: list[tuple]) -> list[tuple]:
    """Frames as list elements: a list a column, of BLOCK frames at the most."""
    return [tuple(map(list, zip(*frames[i : i + BLOCK], strict=True))) for i in range(0, len(frames), BLOCK)]


def unblocked(state: Any) -> list[tuple]:
    """The frames of a list state."""
    return [f for block in state.get() for f in zip(*block, strict=True)] if state.exists() else []


class LiveIndex(StatefulProcessor):
    """Rows in: video_id, ts (the watermark's column), ts_ms, event_id, signal.  Rows out: SCENES, as scenes close."""

    def __init__(self, threshold: float, keep_ms: int = KEEP_MS, idle_ms: int = IDLE_MS):
        self.threshold, self.keep_ms, self.idle_ms = threshold, keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _FRAMES)
        self.ring = handle.getListState("ring", f"{_FRAMES}, scene_id array<long>")
        self.open = handle.getValueState("open", f"session_ms long, scene_id long, start_ms long, n_frames long, {_FRAME}")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r.ts_ms, r.event_id, r.signal) for r in rows]
        passed = timerValues.getCurrentWatermarkInMs()
        # a frame behind the watermark is late: its scene may have been closed
        fresh = [f for f in fresh if f[0] > passed]
        if fresh:
            self.waiting.appendList(blocks(fresh))
            self._wake(min(f[0] for f in fresh), passed)
        return iter(())

    def _wake(self, at: int, passed: int) -> None:
        """One timer a video, at the earliest time that something is to be done; one that is just expiring is still listed."""
        timers = [t for t in self.handle.listTimers() if t > passed]
        if timers and min(timers) <= at:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        video = key[0]
        waiting = sorted(unblocked(self.waiting))
        ready = [f for f in waiting if f[0] <= passed]
        later = waiting[len(ready) :]
        held = tuple(self.open.get()) if self.open.exists() else None
        out, entered = [], []
        close = lambda s, end: out.append(Row(video_id=video, session_ms=s[0], scene_id=s[1], start_ms=s[2], end_ms=end, n_frames=s[3]))
        for ts, event, signal in ready:
            if held is not None and ts - held[4] > self.idle_ms:
                close(held, held[4] + TAIL_MS)
                held = None
            if held is None:
                held = (ts, 0, ts, 1, ts, event, signal)
            elif abs(signal - held[6]) > self.threshold:
                close(held, ts)
                held = (held[0], held[1] + 1, ts, 1, ts, event, signal)
            else:
                held = (*held[:3], held[3] + 1, ts, event, signal)
            entered.append((ts, event, signal, held[1]))
        if held is not None and held[4] + self.idle_ms <= passed:
            # what waits lies further off than a session's gap
            close(held, held[4] + TAIL_MS)
            for state in (self.open, self.ring, self.waiting):
                state.clear()
            if later:
                self.waiting.appendList(blocks(later))
                self._wake(later[0][0], passed)
            return iter(out)
        if ready:
            edge = ready[-1][0] - self.keep_ms
            self.ring.put(blocks([f for f in unblocked(self.ring) + entered if f[0] >= edge]))
            self.open.update(held)
            if later:
                self.waiting.put(blocks(later))
            else:
                self.waiting.clear()
        self._wake(later[0][0] if later else held[4] + self.idle_ms, passed)
        return iter(out)


def live_index(frames: DataFrame, threshold: float, late: str, keep_ms: int = KEEP_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Scenes of a stream of frames (video_id, ts, ts_ms, event_id, signal) as they close; frames up to ``late`` behind the
    newest count.  The session has to use PROVIDER."""
    rows = frames.withWatermark("ts", late).select("video_id", "ts", "ts_ms", "event_id", "signal")
    return rows.groupBy("video_id").transformWithState(LiveIndex(threshold, keep_ms, idle_ms), SCENES, "append", "eventTime")


def ring(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(video_id, ts_ms, event_id, signal, scene_id): the ring as of the last finished batch, while the stream runs."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "ring").load()
    return held.select("key.*", F.inline(F.arrays_zip(*(f"list_element.{c}" for c in ("ts_ms", "event_id", "signal", "scene_id")))))
