"""Streaming forms: live frame index, scene state, tool-call assembly, framing of event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP = "30 minutes"
SAMPLE = "2 seconds"


def sample_frames(frames: DataFrame, every: str = SAMPLE, late: str = KEEP) -> DataFrame:
    """The first frame of each video in every window of event time; a window is given out once the watermark passed it.
    State is one frame a window, and windows beyond the watermark go: the ring buffer of a live index.
    ``frames`` has video_id, ts (timestamp), event_id and signal."""
    first = F.min_by(F.struct("ts", "event_id", "signal"), F.struct("ts", "event_id")).alias("f")
    windows = frames.withWatermark("ts", late).groupBy("video_id", F.window("ts", every)).agg(first)
    return windows.select("video_id", F.col("window.start").alias("window_start"), "f.ts", "f.event_id", "f.signal")


def live_scenes(frames: DataFrame, threshold: float, idle_ms: int | None = None) -> DataFrame:
    """(video_id, scene_id, start_ms, end_ms): scenes as they close.  State a video: the open scene and its last frame.

    Frames of a micro-batch are taken in order; across batches they must come in order, as a player's do.  A scene
    closes when a frame differs from the one before by more than ``threshold``, or after ``idle_ms`` without frames.
    ``frames`` has video_id, ts_ms, event_id and signal.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            scene, start, last, _ = state.get
            state.remove()
            yield pd.DataFrame({"video_id": [key[0]], "scene_id": [scene], "start_ms": [start], "end_ms": [last + 1000]})
            return
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "event_id"])
        out = []
        for ts, signal in zip(rows["ts_ms"].tolist(), rows["signal"].tolist(), strict=True):
            if held is None:
                held = (0, ts, ts, signal)
                continue
            scene, start, _, before = held
            if abs(signal - before) > threshold:
                out.append((key[0], scene, start, ts))
                scene, start = scene + 1, ts
            held = (scene, start, ts, signal)
        if held is not None:
            state.update(held)
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["video_id", "scene_id", "start_ms", "end_ms"])

    return frames.groupBy("video_id").applyInPandasWithState(
        step, "video_id long, scene_id long, start_ms long, end_ms long", "scene_id long, start_ms long, last_ms long, signal double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    )


def assemble_calls(deltas: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(message_id, slot, id, name, arguments, finish) so far, given out anew whenever a piece arrives (update mode).
    Pieces of a call come in order of seq across batches.  With ``idle_ms``, a call that nothing came for
    in that time is forgotten; such a stream looks for silent calls all the time, so it has to be stopped."""
    columns = ["message_id", "slot", "id", "name", "arguments", "finish"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        ident, name, arguments, finish = state.get if state.exists else (None, None, "", None)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            ident, name, finish = r.id or ident, r.name or name, r.finish or finish
            arguments += r.arguments or ""
        state.update((ident, name, arguments, finish))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"message_id": [key[0]], "slot": [key[1]], "id": [ident], "name": [name], "arguments": [arguments], "finish": [finish]})

    shape = "id string, name string, arguments string, finish string"
    return deltas.groupBy("message_id", "slot").applyInPandasWithState(step, f"message_id long, slot int, {shape}", shape, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def frame_events(raw: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(stream_id, n, payload) of server-sent events as their pieces arrive; state is the unfinished rest of a stream, of a finished
    one only that it is.  ``raw`` has stream_id, seq and data.  With
    ``idle_ms``, a stream that nothing came for in that time is forgotten, as in ``assemble_calls``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["stream_id", "n", "payload"])
            return
        rest, n, done = state.get if state.exists else ("", 0, False)
        out = []
        for piece in pd.concat(list(batches)).sort_values("seq")["data"]:
            rest += piece or ""
        *events, rest = rest.split("\n\n")
        for line in (line for e in events for line in e.split("\n")):
            if not done and line.startswith("data:"):
                payload = line[5:].removeprefix(" ")
                if payload == "[DONE]":
                    done = True
                else:
                    out.append((key[0], n, payload))
                    n += 1
        state.update(("" if done else rest, n, done))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "n", "payload"])

    return raw.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, n long, payload string", "rest string, n long, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
