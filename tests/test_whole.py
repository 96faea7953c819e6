"""Queries that return whole texts, against the rows themselves."""

from __future__ import annotations

from chronoreel.plans import registry

QUERIES = registry.queries()


def said(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()


def test_history_is_whole(spark, sf_dir):
    talks = {}
    for r in said(spark, sf_dir):
        if r.role != "system":
            talks.setdefault(r.conv_id, []).append((r.turn, r.text))
    want = {(c, turn): text for c, turns in talks.items() for turn, text in sorted(turns)[-4:]}
    got = {(r.conversation_id, r.seq): r.content for r in QUERIES["history_last4_whole"](spark, sf_dir).collect()}
    assert max(map(len, want.values())) > 100 and got == want


def test_timeline_is_whole(spark, sf_dir):
    want = {(r.conv_id, r.turn): r.text for r in said(spark, sf_dir)}
    rows = QUERIES["interleaved_timeline_whole"](spark, sf_dir).collect()
    assert max(map(len, want.values())) > 20 and {(r.video_id, r.seq): r.text for r in rows if r.kind == "speech"} == want


def test_calls_are_whole_and_limited(spark, sf_dir):
    slots = {}
    for r in sorted(said(spark, sf_dir), key=lambda r: r.turn):
        slots.setdefault((r.conv_id, r.turn % 5), []).append(r.text)
    first = {c: sorted(s for x, s in slots if x == c)[:3] for c, _ in slots}
    want = {(c, s): "".join(texts) for (c, s), texts in slots.items() if s in first[c]}
    got = {(r.message_id, r.slot): r.arguments for r in QUERIES["tool_call_assembly_whole"](spark, sf_dir).collect()}
    assert len(want) < len(slots) and got == want
