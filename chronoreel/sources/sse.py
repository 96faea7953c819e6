"""Server-sent events as a streaming source: logs of received bytes, read from where a checkpoint left off.

A log is a folder ``stream=<number>`` of pieces whose names are in the order of arrival; a piece may end anywhere, inside
an event, a line or a character, and more may be appended.  A stream's offset is the number of bytes seen.  A partition
is a range of one log: events belong to the range in which they end, and a task looks back over earlier pieces for the
beginning of its first one, so the driver reads no byte of a log, and a range that is read again gives the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id long, position long, payload string"
DONE = b"[DONE]"
END = b"\n\n"
#: Bytes that a task looks back at a time for an event's beginning.
LOOK = 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes of one log; those before ``end`` are known to be there."""

    stream: int
    start: int
    end: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """Any file system that Arrow reads; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Log:
    """The pieces of one stream as one run of bytes."""

    def __init__(self, files: pafs.FileSystem, folder: str):
        found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        self.files, self.pieces, at = files, [], 0
        for info in sorted((i for i in found if i.is_file), key=lambda i: i.base_name):
            self.pieces.append((at, at + info.size, info.path))
            at += info.size
        self.size = at

    def read(self, start: int, end: int) -> bytes:
        out = []
        for a, z, path in self.pieces:
            if a < end and z > start:
                with self.files.open_input_file(path) as f:
                    f.seek(max(a, start) - a)
                    out.append(f.read(min(z, end) - max(a, start)))
        return b"".join(out)

    def beginning(self, at: int) -> int:
        """Where the event that byte ``at`` belongs to begins: behind the last end of an event that is no later."""
        high = at
        while high > 0:
            low = max(0, high - LOOK)
            found = self.read(low, min(at, high + len(END) - 1)).rfind(END)
            if found >= 0:
                return low + found + len(END)
            high = low
        return 0


def payloads(event: bytes) -> list[bytes]:
    """The data lines of an event; comments and other fields are left out, as are carriage returns at a line's end and one
    space behind the colon."""
    out = []
    for line in event.split(b"\n"):
        line = line.removesuffix(b"\r")
        if line.startswith(b"data:"):
            out.append(line[5:].removeprefix(b" "))
    return out


def events(log: Log, part: Range) -> Iterator[tuple[int, str]]:
    """(position, payload) of the data lines of events that end in the range; the position is that of the event's end, and
    lines of one event follow each other."""
    at = log.beginning(part.start)
    rest = log.read(at, part.start)
    begun, position = at, part.start
    while position < part.end:
        piece = log.read(position, min(part.end, position + LOOK))
        if not piece:
            return
        rest += piece
        position += len(piece)
        *whole, rest = rest.split(END)
        for event in whole:
            begun += len(event) + len(END)
            for payload in payloads(event):
                yield begun, payload.decode("utf-8", "replace")


class _Reader:
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def sizes(self) -> dict[str, int]:
        """The number of bytes of each log, from its pieces' sizes."""
        files, root = _open(self.path)
        if files.get_file_info(root).type == pafs.FileType.NotFound:
            return {}
        found: dict[str, int] = {}
        for info in files.get_file_info(pafs.FileSelector(root, recursive=True)):
            folder = info.path.rsplit("/", 2)[-2]
            if info.is_file and folder.startswith("stream="):
                stream = folder.removeprefix("stream=")
                found[stream] = found.get(stream, 0) + info.size
        return found

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        files, root = _open(self.path)
        rows: list[tuple[int, str]] = []
        for row in events(Log(files, f"{root}/stream={part.stream}"), part):
            rows.append(row)
            if len(rows) == 10_000:
                yield _batch(part.stream, rows)
                rows = []
        if rows:
            yield _batch(part.stream, rows)

    def ranges(self, start: dict, end: dict) -> list[Range]:
        return [Range(int(s), start.get(s, 0), n) for s, n in sorted(end.items()) if n > start.get(s, 0)] or [Range(0, 0, 0)]


def _batch(stream: int, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    columns = [pa.array([stream] * len(rows), pa.int64()), pa.array([p for p, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["stream_id", "position", "payload"])


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)

    def commit(self, end: dict) -> None:
        """Logs are kept, so nothing is to be done."""


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.sizes())


class EventLogs(DataSource):
    """``spark.read`` and ``spark.readStream.format("sse").load(path)``, once registered with ``spark.dataSource``."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(self.options)


def until_done(rows: DataFrame) -> DataFrame:
    """Without what follows a stream's first ``[DONE]``, itself included."""
    done = rows.where(F.col("payload") == DONE.decode()).groupBy("stream_id").agg(F.min("position").alias("__done"))
    return rows.join(done, "stream_id", "left").where(F.col("__done").isNull() | (F.col("position") < F.col("__done"))).drop("__done")


def event_text(payload: Column, note: Column | None = None) -> Column:
    """An event with one data line, behind a comment if there is one."""
    line = F.concat(F.lit("data: "), payload, F.lit("\n\n"))
    return line if note is None else F.concat(F.lit(": "), note, F.lit("\n"), line)


def write_logs(pieces: DataFrame, path: str) -> None:
    """Writes pieces (stream_id, name, data binary) as files of their logs.  A name is written whole and then renamed, so a task
    that runs again leaves the same file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _open(path)
        attempt = TaskContext.get().taskAttemptId()
        n = 0
        for batch in batches:
            for stream, name, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                folder = f"{root}/stream={stream}"
                files.create_dir(folder, recursive=True)
                files.create_dir(f"{root}/_drafts", recursive=True)
                draft = f"{root}/_drafts/{stream}-{name}-{attempt}"
                with files.open_output_stream(draft) as f:
                    f.write(data or b"")
                files.move(draft, f"{folder}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    pieces.select("stream_id", "name", "data").mapInArrow(work, "n long").agg(F.sum("n")).collect()
