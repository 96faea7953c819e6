"""Event logs: framing over pieces and ranges, restart, batch and stream."""

import random

import pytest
from pyarrow import fs as pafs

from chronoreel.sources import media, sse

TEXT = "data: {\"a\": 1}\n\n: a comment\ndata:two\nevent: x\ndata:  three\r\n\ndata: é日\U0001f600\n\n\n\n: only a comment\n\ndata:\n\ndata: [DONE]\n\ndata: after\n\ndata: unfinished"


def plain(text):
    """(end of event, payload) in order."""
    raw, out, at = text.encode(), [], 0
    *whole, _ = raw.split(b"\n\n")
    for event in whole:
        at += len(event) + 2
        out += [(at, line.removesuffix(b"\r")[5:].removeprefix(b" ").decode()) for line in event.split(b"\n") if line.startswith(b"data:")]
    return out


def log_of(tmp_path, text, cuts):
    raw, edges = text.encode(), [0, *sorted(cuts), len(text.encode())]
    folder = tmp_path / "stream=1"
    folder.mkdir(exist_ok=True)
    for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        (folder / f"{i:06d}").write_bytes(raw[a:z])
    return sse.Log(pafs.LocalFileSystem(), str(folder))


@pytest.mark.parametrize("look", [3, 7, 1 << 16])
def test_ranges(tmp_path, monkeypatch, look):
    """However the log is cut into pieces and ranges, each event comes once, in the range in which it ends."""
    monkeypatch.setattr(sse, "LOOK", look)
    size, r = len(TEXT.encode()), random.Random(look)
    for turn in range(30):
        folder = tmp_path / str(turn)
        folder.mkdir()
        log = log_of(folder, TEXT, r.sample(range(1, size), turn % 7))
        assert log.size == size and log.read(0, size) == TEXT.encode()
        edges = [0, *sorted(r.sample(range(1, size), r.randrange(1, 12))), size]
        got = [e for a, z in zip(edges[:-1], edges[1:], strict=True) for e in sse.events(log, sse.Range(1, a, z))]
        assert got == plain(TEXT)


def test_every_two_ranges(tmp_path):
    log, size = log_of(tmp_path, TEXT, [5, 40, 41]), len(TEXT.encode())
    for cut in range(size + 1):
        assert [*sse.events(log, sse.Range(1, 0, cut)), *sse.events(log, sse.Range(1, cut, size))] == plain(TEXT), cut


def test_stream_goes_on(spark, tmp_path):
    """Pieces of two logs arrive between runs, cut inside characters; a run without news brings nothing."""
    spark.dataSource.register(sse.EventLogs)
    raws = {1: TEXT.encode(), 2: "".join(f"data: {i} é\n\n" for i in range(500)).encode()}
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    at = dict.fromkeys(raws, 0)
    r = random.Random(3)
    for turn in range(4):
        for stream, raw in raws.items():
            end = len(raw) if turn == 3 else min(len(raw), at[stream] + r.randrange(len(raw) // 3))
            rows = [(stream, f"{turn}", raw[at[stream] : end])]
            sse.write_logs(spark.createDataFrame(rows, "stream_id long, name string, data binary"), f"file://{tmp_path}/logs")
            at[stream] = end
        for _ in range(2 if turn == 1 else 1):
            query = spark.readStream.format("sse").load(f"file://{tmp_path}/logs").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            query.awaitTermination()
    got = sorted((r.stream_id, r.position, r.payload) for r in spark.read.schema(sse.SCHEMA).parquet(out).collect())
    want = sorted((s, p, t) for s, raw in raws.items() for p, t in plain(raw.decode()))
    assert got == want
    # the batch form reads the same; nothing counts behind a stream's end
    rows = spark.read.format("sse").load(f"file://{tmp_path}/logs")
    assert sorted((r.stream_id, r.position, r.payload) for r in rows.collect()) == want
    kept = sse.until_done(rows).where("stream_id = 1").collect()
    assert sorted(r.payload for r in kept) == sorted(["", '{"a": 1}', " three", "two", "é日\U0001f600"])
    assert media.chat_deltas(sse.until_done(rows).withColumnRenamed("position", "n")).count() == len(kept) + 500


def test_no_logs(spark, tmp_path):
    spark.dataSource.register(sse.EventLogs)
    assert spark.read.format("sse").load(str(tmp_path / "none")).count() == 0
