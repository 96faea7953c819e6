"""Tools as SQL table functions: polymorphic results, bounded state, arguments that are wrong."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chronoreel import sql_tools
from chronoreel.functions.sampling import range_times


@pytest.fixture(scope="module")
def views(spark):
    sql_tools.register(spark)
    spark.createDataFrame([(1, 0, 0, 100, "a"), (1, 1, 50, 200, "b"), (2, 0, 0, 60, "c"), (2, 7, 60, 90, "d"), (3, None, None, None, "e")], "video_id long, scene_id long, start_ms long, end_ms long, more string").createOrReplaceTempView("sc")
    vectors = [(v, i, [1.0, float(i), 0.5]) for v in (1, 2) for i in range(8)] + [(1, 90, None), (1, 91, []), (2, 92, [0.0, 0.0, 0.0]), (2, 93, [1.0, 3.0, 0.5])]
    spark.createDataFrame(vectors, "video_id long, chunk_id long, embedding array<double>").withColumn("tag", F.col("chunk_id") * 2).createOrReplaceTempView("ch")
    return spark


def rows(spark, sql):
    return sorted((tuple(r) for r in spark.sql(sql).collect()), key=repr)


def test_scene_info(views):
    assert rows(views, "SELECT video_id, more FROM get_scene_info(TABLE(sc), scene_id => 0)") == [(1, "a"), (2, "c")]
    # of two scenes at a time the first; a number below 0 counts as none
    assert rows(views, "SELECT video_id, more FROM get_scene_info(TABLE(sc), timestamp_ms => 60)") == [(1, "a"), (2, "d")]
    assert rows(views, "SELECT more FROM get_scene_info(TABLE(sc), scene_id => -1, timestamp_ms => 150)") == [("b",)]
    assert views.sql("SELECT * FROM get_scene_info(TABLE(SELECT *, 5 AS extra FROM sc), scene_id => 7)").columns == ["video_id", "scene_id", "start_ms", "end_ms", "more", "extra"]


def test_transcript(views):
    assert rows(views, "SELECT * FROM get_transcript(TABLE(SELECT video_id, start_ms * 1000 AS start_ms, end_ms * 1000 AS end_ms, more FROM sc), start_ms => 100000, end_ms => 100000)") == [(1, 0, 100_000, "a", "0:00-1:40"), (1, 50_000, 200_000, "b", "0:50-3:20")]


def test_search(views):
    found = rows(views, "SELECT video_id, chunk_id, tag, rank FROM search_video_content(TABLE(ch), query => array(1.0D, 3.0D, 0.5D), top_k => 2)")
    # ties go to the smaller key
    assert [(v, c, t, r) for v, c, t, r in found if v == 2] == [(2, 3, 6, 1), (2, 93, 186, 2)] and (1, 3, 6, 1) in found and len(found) == 4
    assert rows(views, "SELECT * FROM search_video_content(TABLE(ch), query => array(1.0D, 3.0D), top_k => 2)") == []


def test_time_range(views):
    for start, end, n in [(0, 1000, 3), (0, 10, 1), (5, 6, 50), (0, 7, 4)]:
        want = views.range(1).select(range_times(F.lit(start), F.lit(end), F.lit(n))).first()[0]
        assert [r[0] for r in views.sql(f"SELECT * FROM analyze_time_range({start}, {end}, {n})").collect()] == want
    with pytest.raises(Exception, match="must lie after"):
        views.sql("SELECT * FROM analyze_time_range(5, 5, 3)").collect()


@pytest.mark.parametrize(
    "call, says",
    [
        ("get_scene_info(TABLE(sc))", "is needed"),
        ("get_scene_info(TABLE(SELECT video_id FROM sc), scene_id => 1)", "the table has no"),
        ("get_scene_info(5, scene_id => 1)", "is a table"),
        ("get_transcript(TABLE(sc), start_ms => NULL, end_ms => 5)", "are needed"),
    ],
)
def test_wrong_arguments(views, call, says):
    with pytest.raises(AnalysisException, match=says):
        views.sql(f"SELECT * FROM {call}").collect()
