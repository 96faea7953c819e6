"""Literal cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from chronoreel.functions import questions as Q
from chronoreel.functions import sampling as S
from chronoreel.functions import text as X
from chronoreel.functions import vectors as V
from chronoreel.operators import align, entities, extras, reflect, search, segment


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("question", "kind", "needs", "weights", "prefers"),
    [
        ("这个视频讲了什么", "GlobalSummary", (1, 0, 1), (0.7, 0.2, 0.1), (0, 1, 1)),
        ("什么时候出现红色汽车", "TemporalLocalization", (0, 1, 0), (0.2, 0.7, 0.1), (0, 0, 1)),
        ("那个穿红衣服的人是谁", "EntityQuery", (0, 1, 1), (0.2, 0.7, 0.1), (1, 0, 0)),
        ("视频后半部分发生了什么", "TemporalOrder", (1, 0, 0), (0.7, 0.2, 0.1), (0, 0, 1)),
        ("左上角是什么", "Unknown", (0, 1, 0), (0.2, 0.7, 0.1), (1, 0, 0)),
        ("画面里的人说了什么", "Unknown", (1, 1, 0), (0.4, 0.4, 0.2), (0, 1, 0)),
        ("hello", "Unknown", (1, 0, 0), (0.7, 0.2, 0.1), (0, 0, 1)),
    ],
)
def test_questions(spark, question, kind, needs, weights, prefers):
    q = F.lit(question)
    r = one(spark, Q.question_class(q).alias("c"), *(c.alias(n) for n, c in Q.intent(q).items()))
    assert r.c == kind
    assert (r.needs_text, r.needs_visual, r.has_entity) == tuple(map(bool, needs))
    assert (r.w_text, r.w_visual, r.w_entity) == weights
    assert (r.prefers_visual, r.prefers_audio, r.prefers_fused) == tuple(map(bool, prefers))


@pytest.mark.parametrize(("text", "hit"), [("seek 3", True), ("please go  to 5", True), ("跳转 now", False), ("a跳转b", True), ("replay", False), ("Pause!", True)])
def test_player_commands(spark, text, hit):
    assert one(spark, Q.is_player_command(F.lit(text)).alias("x")).x is hit


@pytest.mark.parametrize(
    ("sim", "key", "cov", "span", "chars", "relevance", "relation", "confidence"),
    [
        (0.70, 0.25, 0.40, 0.0, 50, 1.0, "strong", 0.95),
        (0.50, 0.10, 0.30, 0.1, 50, 0.4420, "contextual", 0.5683),
        (0.35, 0.00, 0.05, 0.5, 50, 0.0203, "independent", 0.7492),
        (None, 0.25, 0.40, 0.0, 50, 1.0, "strong", 0.95),
        (None, 0.10, 0.10, 0.0, 50, 0.3325, "contextual", 0.4771),
        (0.90, 1.00, 1.00, 0.0, 3, 1.0, "unknown", 0.3),
        (None, 0.0, 0.0, 0.0, None, 0.0, "unknown", 0.0),
    ],
)
def test_gate(spark, sim, key, cov, span, chars, relevance, relation, confidence):
    lit = lambda x, t: F.lit(x).cast(t)
    r = one(spark, *(c.alias(n) for n, c in zip("rkc", align.gate(lit(sim, "double"), lit(key, "double"), lit(cov, "double"), lit(span, "double"), lit(chars, "int")), strict=True)))
    assert (round(r.r, 4), r.k, round(r.c, 4)) == (relevance, relation, confidence)


def test_ids_and_labels(spark):
    c = X.chunk_id(F.lit("vid"), F.lit(0), F.lit(0), F.lit(1000), F.lit("0"))
    d = X.chunk_id(F.lit("vid"), F.lit(3), F.lit(0), F.lit(1000), F.lit("0"))
    v = X.video_id(F.lit(5), F.lit(b"hello"), F.lit("p"))
    assert tuple(one(spark, c, d, v)) == ("f0c658a641ab3256f53abed68befe234881366a5", "125452195b0d09c5beccc49f26222088b7e9ae15", "6bd4d7c29aedc3e1")
    for ms, labels in ((3_725_000, ("1:02:05", "62:05", "01:02:05")), (65_000, ("1:05", "1:05", "01:05"))):
        m = F.lit(ms)
        assert tuple(one(spark, X.time_label(m), X.transcript_label(m), X.subtitle_label(m))) == labels


def test_sampling(spark):
    d = F.lit(100_000)
    times = one(spark, S.sample_times(d, S.sample_count(d, dense=False)).alias("t")).t
    assert times[:2] == [2500, 7500] and times[-1] == 97500 and len(times) == 20
    assert one(spark, S.range_times(F.lit(0), F.lit(10_000), F.lit(5)).alias("t")).t == [0, 2500, 5000, 7500, 10000]
    assert tuple(one(spark, *(S.frame_budget(F.lit(600_000), F.lit(p)) for p in ("initial_overview", "question_targeted", "full_analysis")))) == (30, 10, 50)


def test_text(spark):
    r = one(spark, X.keywords(F.lit("红色Car开过街道 a 42")).alias("k"), X.timestamps_ms(F.lit("见[01:23]和[1:02:03]")).alias("t"), X.json_object(F.lit('text ```json\n{"k":1}\n``` text')).alias("j"))
    assert r.k == ["红色", "car", "开过", "过街", "街道", "42"]
    assert r.t == [83_000, 3_723_000]
    assert r.j == '{"k":1}'


def test_histogram_and_cosine(spark):
    same, other = F.lit([1.0, 0.0] * 3), F.lit([0.0, 1.0] * 3)
    r = one(spark, V.histogram_distance(same, same), V.histogram_distance(same, other), V.cosine(F.lit([1.0, 0.0]), F.lit([0.0, 0.0])), V.cosine(F.lit([1.0]), F.lit([1.0, 0.0])))
    assert tuple(r) == (0.0, 1.0, 0.0, 0.0)


def test_fusion_and_dedup(spark):
    rows = [("text", "a", 1), ("text", "b", 2), ("visual", "b", 1), ("visual", "c", 2)]
    fused = search.rrf(spark.createDataFrame(rows, "path string, chunk_id string, rank int").withColumn("weight", F.lit(0.4)), "chunk_id")
    assert {r.chunk_id: r.score for r in fused.collect()} == {"b": 0.01300899, "a": 0.006557377, "c": 0.006451613}
    rows = [(1, "A", 0, 10000, "0", 0.9), (1, "B", 1000, 9000, "0", 0.8), (1, "C", 1000, 9000, "1", 0.7), (1, "D", 8000, 20000, "0", 0.6)]
    kept = search.remove_overlaps(spark.createDataFrame(rows, "query_id int, chunk_id string, start_ms long, end_ms long, chunk_type string, score double"))
    assert [r.chunk_id for r in kept.orderBy("rank").collect()] == ["A", "C", "D"]


def test_scenes(spark):
    rows = [(1, i * 1000, i, s) for i, s in enumerate((0.0, 0.1, 0.6, 0.8))] + [(2, 700, 9, 1.0)]
    scored = segment.differences(spark.createDataFrame(rows, "video_id int, ts_ms long, event_id int, signal double"))
    got = [tuple(r)[:4] for r in segment.scenes(scored, 0.3).orderBy("video_id", "scene_id").collect()]
    assert got == [(1, 0, 0, 2000), (1, 1, 2000, 4000), (2, 0, 700, 1700)]


def test_speech_quota(spark):
    scene = spark.createDataFrame([(1, 0, 10000, 20000)], "video_id int, scene_id long, start_ms long, end_ms long")
    segs = "video_id int, seg_idx int, start_ms long, end_ms long, text string"
    three = spark.createDataFrame([(1, 0, 0, 12000, "x"), (1, 1, 11000, 13000, "y"), (1, 2, 19900, 30000, "z")], segs)
    assert sorted(r.seg_idx for r in align.scene_speech(align.overlaps(scene, three)).collect()) == [0, 1]
    long = spark.createDataFrame([(1, 0, 10000, 20000, "x" * 2000)], segs)
    assert [len(r.text) for r in align.scene_speech(align.overlaps(scene, long)).collect()] == [1500]


def test_reflection(spark):
    late = reflect.late_timestamp(F.lit("见[59:59]"), F.lit(600_000))
    assert one(spark, late.alias("x")).x == 3_599_000
    assert round(one(spark, reflect.confidence(F.lit(1)).alias("x")).x, 2) == 0.75
    assert round(one(spark, reflect.confidence(F.lit(9)).alias("x")).x, 2) == 0.3


def test_fusion_confidence(spark):
    rows = [("bad reply", "strong", 0.8), ('{"relation":"contextual","confidence":0.7}', "strong", 0.8), ('{"relation":"strong","confidence":0.9}', "strong", 0.8), ('{"relation":"contextual","confidence":0.1}', "strong", 0.8)]
    df = spark.createDataFrame([(*r, "v", "s") for r in rows], "reply string, relation string, confidence double, visual string, said string")
    assert [round(r.confidence, 2) for r in align.reconcile(df).collect()] == [0.8, 0.6, 0.9, 0.3]


def test_cluster_order(spark):
    rows = [(1, 2, 20, "person", [0.0, 1.0]), (1, 1, 10, "person", [1.0, 0.0]), (1, 3, 30, "person", [0.9, 0.1]), (1, 4, 40, "person", [0.0, 0.0])]
    got = entities.cluster(spark.createDataFrame(rows, "video_id long, desc_id long, ts_ms long, entity_type string, embedding array<double>"))
    assert [r.entity_id for r in got.orderBy("desc_id").collect()] == ["person_1", "person_2", "person_1", "person_3"]


def test_tool_calls(spark):
    rows = [(1, 0, 0, "c1", "find", '{"a"', ""), (1, 0, 1, None, None, ":1}", "tool_calls")]
    calls = extras.assemble_calls(spark.createDataFrame(rows, "message_id long, slot int, seq long, id string, name string, arguments string, finish string"))
    assert tuple(calls.first()) == (1, 0, "c1", "find", '{"a":1}', "tool_calls")
