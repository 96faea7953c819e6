"""File and stream sources: video directories, server-sent events, message frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.functions.text import VIDEO_EXTENSIONS, video_id

DELTA = "struct<choices:array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>>>"


def video_directory(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, name, size, modified[, video_id]) of a directory's videos, by name; subdirectories are not entered.
    Contents are read only for ids."""
    names = ",".join(f"*.{e}" for ext in VIDEO_EXTENSIONS for e in (ext, ext.upper()))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{names}}}").load(path)
    cols = [F.col("path"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if content:
        cols.append(video_id(F.col("length"), F.col("content"), F.col("path")).alias("video_id"))
    return files.select(*cols).orderBy("name")


def sse_events(raw: DataFrame, by: str = "stream_id", order: str = "seq", data: str = "data") -> DataFrame:
    """(by, n, payload): the events of recorded streams.  A stream's pieces are joined in order, events end at an empty
    line (LF LF), comments and other fields are skipped, one space after ``data:`` goes, ``[DONE]`` ends the stream."""
    pieces = F.array_sort(F.collect_list(F.struct(order, F.col(data).alias("d"))))
    whole = raw.groupBy(by).agg(F.array_join(F.transform(pieces, lambda p: p["d"]), "").alias("text"))
    framed = F.split("text", "\n\n")
    complete = F.slice(framed, F.lit(1), F.size(framed) - 1)
    lines = F.filter(F.flatten(F.transform(complete, lambda e: F.split(e, "\n"))), lambda line: line.startswith("data:"))
    payloads = F.transform(lines, lambda line: F.regexp_replace(line, "^data: ?", ""))
    done = F.array_position(payloads, "[DONE]")
    live = F.when(done > 0, F.slice(payloads, F.lit(1), (done - 1).cast("int"))).otherwise(payloads)
    return whole.select(by, F.posexplode(live).alias("n", "payload"))


def chat_deltas(events: DataFrame, by: str = "stream_id") -> DataFrame:
    """(by, n, content, finish) of the first choice of every event."""
    choice = F.from_json("payload", DELTA)["choices"][0]
    return events.select(by, "n", choice["delta"]["content"].alias("content"), choice["finish_reason"].alias("finish"))


def encode_frames(frames: F.Column) -> F.Column:
    """JSON array of base64 pictures from an array of binaries, as messages store them."""
    return F.to_json(F.transform(frames, lambda b: F.base64(b)))


def decode_frames(text: F.Column) -> F.Column:
    return F.transform(F.from_json(text, "array<string>"), lambda s: F.unbase64(s))
