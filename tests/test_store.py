"""Generations of a stored table, and staged builds on them."""

import pytest
from pyspark.sql import functions as F

from chronoreel.operators import levels as L
from chronoreel.sources.store import ConcurrentWrite, Store

SCHEMA = "video_id long, chunk_id long, text string, version int"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", SCHEMA, buckets=4)


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lifecycle(spark, store):
    assert store.generation() == 0 and held(store.read()) == [] and store.read().schema == store.schema
    assert store.upsert(rows(spark, (1, 10, "a", 1), (2, 20, "b", 1), (None, 30, "c", 1)), ["chunk_id"], "version") == 1
    assert store.upsert(rows(spark, (1, 10, "newer", 3), (1, 11, "d", 1)), ["chunk_id"], "version") == 2
    assert store.upsert(rows(spark, (1, 10, "older", 2)), ["chunk_id"], "version") == 3
    want = [(1, 10, "newer", 3), (1, 11, "d", 1), (2, 20, "b", 1), (None, 30, "c", 1)]
    assert held(store.read()) == sorted(want, key=repr)
    # earlier generations stay readable until they are cleaned
    assert held(store.read(1)) == sorted([(1, 10, "a", 1), (2, 20, "b", 1), (None, 30, "c", 1)], key=repr)
    store.remove(spark.createDataFrame([(None,), (2,), (99,)], "video_id long"))
    assert held(store.read()) == [(1, 10, "newer", 3), (1, 11, "d", 1)]
    store.rebuild(spark.createDataFrame([(1,), (7,)], "video_id long"), rows(spark, (7, 70, "e", 1), (8, 80, "not named", 1)))
    assert held(store.read()) == [(7, 70, "e", 1)]
    assert store.upsert(rows(spark), ["chunk_id"], "version") == 5
    store.remove(spark.createDataFrame([(7,)], "video_id long"))
    assert held(store.read()) == [] and store.generation() == 6
    store.upsert(rows(spark, (1, 1, "again", 1)), ["chunk_id"], "version")
    assert store.clean(1) >= 3 and held(store.read()) == [(1, 1, "again", 1)]


def test_only_touched_buckets_are_written(spark, store):
    many = spark.range(200).select((F.col("id") % 20).alias("video_id"), F.col("id").alias("chunk_id"), F.lit("x").alias("text"), F.lit(1).alias("version"))
    store.upsert(many, ["chunk_id"], "version")
    before = store.heads()
    store.upsert(rows(spark, (3, 3, "y", 2)), ["chunk_id"], "version")
    after = store.heads()
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    # other folders are pruned by their names
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan and "bucket" in plan


def test_half_a_write_is_not_seen(spark, store, monkeypatch):
    first = rows(spark, *((i % 5, i, "a", 1) for i in range(50)))
    store.upsert(first, ["chunk_id"], "version")
    want = held(store.read())
    # a task fails in the midst of the write
    broken = rows(spark, *((i % 5, i, "b", 2) for i in range(50))).repartition(5).withColumn("text", F.when(F.col("chunk_id") == 33, F.raise_error(F.lit("stopped"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stopped"):
        store.change([0, 1, 2, 3], lambda old: broken)
    assert store.generation() == 1 and held(store.read()) == want
    # the driver goes when all is written but the last file
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.upsert(rows(spark, (1, 1, "b", 2)), ["chunk_id"], "version")
    assert store.generation() == 1 and held(store.read()) == want
    assert store.clean() >= 1 and held(store.read()) == want
    store.upsert(rows(spark, (1, 1, "b", 2)), ["chunk_id"], "version")
    assert (1, 1, "b", 2) in held(store.read()) and len(held(store.read())) == 50


def test_second_of_two_writers_fails(spark, store):
    store.upsert(rows(spark, (1, 1, "a", 1)), ["chunk_id"], "version")

    def meanwhile(old):
        store.upsert(rows(spark, (1, 2, "theirs", 1)), ["chunk_id"], "version")
        return old.unionByName(rows(spark, (1, 3, "ours", 1)))

    with pytest.raises(ConcurrentWrite):
        store.change([0, 1, 2, 3], meanwhile)
    assert held(store.read()) == [(1, 1, "a", 1), (1, 2, "theirs", 1)]


A = L.Level("A", ("x",), "video_id long, v long", lambda videos, inputs, below: inputs["x"])
B = L.Level("B", ("y",), "video_id long, total long", lambda videos, inputs, below: below.join(inputs["y"], "video_id").groupBy("video_id").agg(F.sum(F.col("v") * F.col("w")).alias("total")))


def stamped(built, name):
    return {r.video_id: r.built for r in built.read(name).collect()}


def test_levels_build_what_changed(spark, tmp_path):
    built = L.Levels(spark, f"file://{tmp_path}/levels", (A, B), buckets=4)
    x = lambda *r: spark.createDataFrame(list(r), "video_id long, v long")
    y = lambda *r: spark.createDataFrame(list(r), "video_id long, w long")
    ys = y((1, 2), (2, 3), (3, 4), (9, 9))
    # the first run stops after the lowest level; the next goes on
    assert built.run({"x": x((1, 10), (2, 20), (3, 30), (None, 5)), "y": ys}, upto="A") == {"A": 3}
    assert stamped(built, "B") == {}
    assert built.run({"x": x((1, 10), (2, 20), (3, 30)), "y": ys}) == {"A": 0, "B": 3}
    assert stamped(built, "A") == {1: 1, 2: 1, 3: 1} and stamped(built, "B") == {1: 1, 2: 1, 3: 1}
    # nothing new, nothing built
    assert built.run({"x": x((3, 30), (2, 20), (1, 10)), "y": ys}) == {"A": 0, "B": 0}
    # a new row of 2, a new video 4 that nothing is known about in y, 1 goes; then only y of 3 changes
    second = x((2, 20), (2, 1), (3, 30), (4, 1))
    assert built.run({"x": second, "y": ys}) == {"A": 3, "B": 2}
    assert stamped(built, "A") == {2: 2, 3: 1, 4: 2} and stamped(built, "B") == {2: 2, 3: 1}
    assert built.run({"x": second, "y": y((1, 2), (2, 3), (3, 5), (9, 9))}) == {"A": 0, "B": 1}
    assert stamped(built, "B") == {2: 2, 3: 3}
    assert {r.video_id: r.total for r in built.read("B").collect()} == {2: 63, 3: 150}


def test_levels_resume_between_rows_and_stamps(spark, tmp_path, monkeypatch):
    built = L.Levels(spark, f"file://{tmp_path}/levels", (A,), buckets=2)
    x = spark.createDataFrame([(1, 10), (2, 20)], "video_id long, v long")
    with monkeypatch.context() as m:
        m.setattr(built.stamps["A"], "rebuild", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            built.run({"x": x})
    assert stamped(built, "A") == {} and built.run({"x": x}) == {"A": 2}
    assert sorted(tuple(r) for r in built.read("A").collect()) == [(1, 10, 1), (2, 20, 1)]
