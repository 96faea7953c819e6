"""WARC archives: whole-file gzip in, one gzip member a record and an offset index out.

``write_archives`` stores rows as records of monolithic gzip streams.  ``normalise`` inflates
each stream once, in pieces, and rewrites every record as a member of its own beside a
sidecar index of (offset, length).  ``read_records`` opens records by that index.  An archive
is one task's work; archives roll over at a bounded size, so tasks stay bounded too.  Files
are written under a name of the attempt and then moved, so a task that runs again leaves
whole files only.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import Scratch

#: Uncompressed bytes at which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20
#: The crawl's date is not among the columns; a fixed one keeps archives the same from run to run.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PIECE = 1 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_UNSAFE_ID = re.compile(r"[\x00-\x20\x7f%<>]")
#: The id of a record whose key is null; any other starts with the first name.
_ID, _NULL_ID = "<urn:x-page:", "<urn:x-no-page:>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record: a response with the payload, or a revisit that names the response holding an equal one."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _escape(url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _escape(value: str, unsafe: re.Pattern = _UNSAFE) -> str:
    return unsafe.sub(lambda m: f"%{ord(m[0]):02X}", value)


def _id(key) -> str:
    """A record's id: the key, percent-encoded so that ``_key`` reads it back as it was."""
    return _NULL_ID if key is None else f"{_ID}{_escape(str(key), _UNSAFE_ID)}>"


def _key(uri: str) -> str | None:
    return None if uri == _NULL_ID else unquote(uri[len(_ID) : -1])


def headers(record: bytes) -> tuple[dict[str, str], int]:
    """A record's header fields and where its block begins."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines), end + 4


class _File:
    """An output file that appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.attempt-{TaskContext.get().taskAttemptId()}"
        self.stream = self.fs.open_output_stream(self.part, compression=None)

    def close(self) -> None:
        self.stream.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def _inflated(path: str) -> Iterator[bytes]:
    """The uncompressed pieces of a gzip file of one or more members."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as stream:
        inflater = zlib.decompressobj(31)
        while piece := stream.read(_PIECE):
            while piece:
                yield inflater.decompress(piece)
                piece = inflater.unused_data
                if inflater.eof:
                    inflater = zlib.decompressobj(31)
                else:
                    break


def records(path: str) -> Iterator[bytes]:
    """Whole records of an archive, in order; one record and one piece are held at a time."""
    held = bytearray()
    for piece in _inflated(path):
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            found = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", bytes(held[at:end]))
            if not found:
                raise ValueError(f"{path}: a record without Content-Length")
            stop = end + 4 + int(found[1]) + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError(f"{path}: {len(held)} bytes after the last whole record")


def mark_revisits(pages: DataFrame, scratch: Scratch, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the largest key among rows with an equal payload of at least ``min_bytes``
    bytes, null for that row itself.  Payloads are told apart by length and SHA-256.  Digests that occur once are left out
    of what is joined; where the others are too many to broadcast, the join deals the rows by digest."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumn("__sha", F.sha2(body, 256)).withColumn("__bytes", F.octet_length(body))
    equal = rows.where(F.col("__bytes") >= min_bytes).groupBy(F.col("__sha").alias("s"), F.col("__bytes").alias("b"))
    again = scratch.save(equal.agg(F.max(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    out = rows.join(again, (F.col("__sha") == F.col("s")) & (F.col("__bytes") == F.col("b")), "left")
    return out.withColumn("refers_to", F.when(~F.col(key).eqNullSafe(F.col("first")), F.col("first"))).drop("__sha", "__bytes", "s", "b", "first")


def write_archives(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, records) of monolithic gzip archives under ``root``; ``pages`` has refers_to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, deflater, size, count = 0, None, None, 0, 0
        part = TaskContext.get().partitionId()

        def finish():
            out.stream.write(deflater.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{root}/part-{part:06d}-{number:04d}.warc.gz"]), pa.array([count], pa.int64())], ["path", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, address, html, refers_to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    out, deflater, size, count = _File(f"{root}/part-{part:06d}-{number:04d}.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                record = record_bytes(page_id, address, (html or "").encode(), refers_to)
                out.stream.write(deflater.compress(record))
                size, count = size + len(record), count + 1
                if size >= archive_bytes:
                    yield finish()
                    number, out = number + 1, None
        if out is not None:
            yield finish()

    return pages.select(key, url, payload, "refers_to").mapInArrow(work, "path string, records long")


def normalise(archives: DataFrame, root: str, level: int = 5) -> DataFrame:
    """(path, index, records): each archive of ``archives`` (path) rewritten under ``root`` with a gzip member for
    every record, and its sidecar index of JSON lines (offset, length, id, type)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                target = f"{root}/{path.rpartition('/')[2]}"
                data, index = _File(target), _File(f"{target}.idx")
                offset = count = 0
                for record in records(path):
                    deflater = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = deflater.compress(record) + deflater.flush()
                    data.stream.write(member)
                    fields, _ = headers(record)
                    line = {"offset": offset, "length": len(member), "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"]}
                    index.stream.write(json.dumps(line).encode() + b"\n")
                    offset, count = offset + len(member), count + 1
                data.close()
                index.close()
                made.append((target, f"{target}.idx", count))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "index", "records"])

    return archives.select("path").mapInArrow(work, "path string, index string, records long")


def read_records(archives: DataFrame, key: str, key_type: T.DataType, payload: bool = True) -> DataFrame:
    """Records of normalised archives (path, index), each opened at its offset: (key, url, payload_bytes,
    payload_digest, record_type, refers_to, and payload unless left out).  A payload that does not
    match its stated digest or length is an error."""
    fields = [T.StructField(key, key_type), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", key_type)]
    if payload:
        fields.append(T.StructField("payload", T.StringType()))
    whole = isinstance(key_type, T.IntegralType)

    def named(uri: str | None):
        value = None if uri is None else _key(uri)
        return int(value) if whole and value is not None else value

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType(fields))
        for batch in batches:
            for path, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                index_fs, index_name = pafs.FileSystem.from_uri(index)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(name) as data, index_fs.open_input_stream(index_name, compression=None) as lines:
                    for line in lines.read().splitlines():
                        entry = json.loads(line)
                        record = zlib.decompress(data.read_at(entry["length"], entry["offset"]), 31)
                        head, at = headers(record)
                        block = record[at : at + int(head["Content-Length"])]
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response" and (sha1_base32(body) != digest or len(body) != size):
                            raise ValueError(f"{path}: record {head['WARC-Record-ID']} does not match its digest")
                        row = (named(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], named(head.get("WARC-Refers-To")))
                        rows.append((*row, body.decode()) if payload else row)
                        held += len(body) if payload else 100
                        if held > _PIECE * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("path", "index").mapInArrow(work, T.StructType(fields))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes ``pages`` as WARC archives in the shared folder, normalises them and reads every record back.

    A row is one record.  Null payloads are empty; of equal payloads of at least ``min_bytes`` bytes the largest key is the
    response and the others revisit it; rows that repeat that key are responses too.  A null key is read back as
    null, a null URL as null; control characters and spaces in URLs are percent-encoded.  An empty table gives no archives
    and no rows.  Only the three named columns are read.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    marked = mark_revisits(pages.select(key, url, payload), scratch, key, payload, min_bytes)
    raw = scratch.save(write_archives(marked, f"{scratch.root}/monolithic", key, url, payload), "raw")
    raw = raw.repartition(max(1, raw.count()))
    normal = scratch.save(normalise(raw, f"{scratch.root}/members"), "normal")
    normal = normal.repartition(max(1, normal.count()))
    return read_records(normal, key, pages.schema[key].dataType, with_payload)


def op4_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Contract columns for ``pages``."""
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
