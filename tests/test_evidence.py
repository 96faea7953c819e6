"""Stored entities, strict cache rules, window path, merged evidence and sampling on fixed cases."""

from pyspark.sql import functions as F

from chronoreel.operators import evidence as V


def test_entities_come_back_as_written(spark):
    kind = "video_id long, entity_id string, entity_type string, description string, aliases array<string>, appearances array<struct<scene_id:long,timestamp_ms:long,description:string,bbox:struct<x:double,y:double,w:double,h:double>>>"
    rows = [
        (1, "a", "person", "tall", ["A\"b", None], [(3, 10, None, (1.0, 2.0, 3.0, 4.0)), (None, None, "seen", (1.0, 2.0, 0.0, 4.0)), (4, 5, "", None)]),
        (1, "b", "ghost", None, None, None),
        (2, "c", None, "", [], []),
    ]
    back = {r.entity_id: r for r in V.decode_entities(V.encode_entities(spark.createDataFrame(rows, kind))).collect()}
    a = back["a"]
    assert a.aliases[0] == 'A"b'
    assert [(x.scene_id, x.timestamp_ms, x.description, x.bbox is not None) for x in a.appearances] == [(3, 10, "", True), (-1, 0, "seen", False), (4, 5, "", False)]
    assert (back["b"].entity_type, back["b"].aliases, back["b"].appearances) == ("unknown", [], [])
    assert (back["c"].entity_type, back["c"].appearances) == ("unknown", [])
    bad = spark.createDataFrame([(1, "x", "text", "d", "no json", None)], "video_id long, entity_id string, entity_type string, description string, aliases_json string, appearances_json string")
    (x,) = V.decode_entities(bad).collect()
    assert (x.entity_type, x.appearances) == ("text", [])
    assert {r.entity_id: (r.start_ms, r.end_ms) for r in V.entity_chunks(spark.createDataFrame(rows, kind)).collect()}["b"] == (0, 0)


def test_strict_rules(spark):
    rows = [("what is shown", 0.95, 0.8, [1], [1, 2]), ("what is shown", 0.94, 0.9, [1], [1]), ("what is shown", 0.99, 0.7, [1], [1]), ("what is shown", 0.99, 0.9, [1], [2]), ("那个人是谁", 0.99, 0.9, [1], [1]), ("play it", 0.99, 0.9, [1], [1]), (None, 0.99, 0.9, [1], [1]), ("what", 0.99, 0.9, None, [1])]
    df = spark.createDataFrame(rows, "q string, s double, c double, a array<long>, b array<long>")
    served = [r[0] for r in df.select(V.may_serve(F.col("q"), F.col("s"), F.col("c"), F.col("a"), F.col("b"))).collect()]
    assert served == [True] + [False] * 7


def test_window_path_meets_a_pair_once(spark):
    chunks = spark.createDataFrame([(1, 7, 0, 250_000), (2, 7, 60_000, 60_000), (3, 7, 119_000, 121_000), (4, 8, 0, 500_000), (5, None, 0, 9), (6, 7, 200_000, 210_000)], "chunk_id long, video_id long, start_ms long, end_ms long")
    windows = spark.createDataFrame([(1, 7, 50_000, 130_000), (2, 9, 0, 10), (3, 7, 5, 5)], "query_id long, video_id long, from_ms long, to_ms long")
    found = V.window_path(chunks, windows, 5).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id, r.score, r.rank) for r in found] == [(1, 1, 1.0, 1), (1, 3, 1.0, 2)]


def test_merged_evidence(spark):
    rows = [(1, 7, 1, 0, 10, 0.25), (1, 7, 2, 5, 20, 0.5), (1, 7, 3, 20, 30, 0.5), (1, 8, 4, 0, 10, 1.0), (2, 7, 5, 0, 10, 1.0)]
    df = spark.createDataFrame(rows, "query_id long, video_id long, chunk_id long, start_ms long, end_ms long, score double")
    got = {(r.query_id, r.video_id, r.start_ms, r.end_ms, r.chunk_id, r.score, r.n) for r in V.merge_evidence(df).collect()}
    assert got == {(1, 7, 0, 20, 2, 0.75, 2), (1, 7, 20, 30, 3, 0.5, 1), (1, 8, 0, 10, 4, 1.0, 1), (2, 7, 0, 10, 5, 1.0, 1)}


def test_ranges_take_five_hits_or_one(spark):
    asked = spark.createDataFrame([(1, "EntityQuery", 9000, -1, False), (2, "CausalReasoning", 9000, -1, False), (3, "Counting", 9000, -1, False), (4, "EntityQuery", 9000, -1, True), (5, "TemporalLocalization", 9000, -1, False)], "query_id long, question_class string, duration_ms long, position_ms long, enough boolean")
    hits = spark.createDataFrame([(q, i, 1000 * i, 1000 * i + 500) for q in (1, 2, 3, 4) for i in range(1, 7)], "query_id long, rank int, start_ms long, end_ms long")
    rows = V.sampling_ranges(asked, hits).collect()
    of = lambda q: sorted((r.place, r.start_ms, r.end_ms) for r in rows if r.query_id == q and r.need_new)
    assert of(1) == [(i, max(0, 1000 * i - 2000), min(9000, 1000 * i + 2500)) for i in range(1, 6)]
    assert of(2) == [(1, 0, 6500)] and of(3) == [(1, 0, 9000)] and of(5) == [(1, 0, 9000)]
    assert [r.start_ms for r in rows if r.query_id == 4] == [None] and of(4) == []
