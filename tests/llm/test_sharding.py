import zlib

from pyspark.sql import functions as F

from chronoreel.llm import sharding


def test_messy(spark, messy, messy_rows):
    got = sharding.assign(messy.drop("slot", "size"), 4).collect()
    assert len(got) == len(messy_rows)
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, size(r[1]), zlib.crc32((r[1] or "").encode())) for r in messy_rows)
    for shard in range(4):
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places)))


def test_clash(spark, messy, messy_rows):
    assert sharding.assign(messy, 4).count() == len(messy_rows)


def test_near_equal_and_stable(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    out = sharding.op2_sharding(spark, docs)
    loads = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 40 and max(loads) < 1.02 * min(loads)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sharding.op2_sharding(spark, docs.repartition(7)).collect()))


def test_rebalance_moves_little():
    sizes = {s: 100 + s % 17 for s in range(4096)}
    one = sharding.build_map(sizes, 8, 4096)
    two = sharding.rebalance(one, sizes, 9)
    assert (two.version, two.n_shards) == (2, 9)
    moved = [s for s in range(4096) if one.shard_of[s] != two.shard_of[s]]
    assert {two.shard_of[s] for s in moved} == {8} and 0.09 < len(moved) / 4096 < 0.13
    loads = [sum(sizes[s] for s in range(4096) if two.shard_of[s] == k) for k in range(9)]
    assert max(loads) < 1.02 * min(loads)
    assert sharding.rebalance(two, sizes, 9).shard_of == two.shard_of


def test_empty(spark, empty):
    assert sharding.assign(empty).collect() == []


def test_map_versions(spark, tmp_path):
    """The stored map is loaded, edited when shards are added or sizes move, and left alone else."""
    store = f"file://{tmp_path}/map"
    rows = [(i, "x" * (i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def run(n, of=docs):
        out = sharding.assign(of, n, slots=512, store=store).collect()
        sizes = {}
        for r in out:
            sizes[r.vslot] = sizes.get(r.vslot, 0) + r.size
        stored = sharding.load_map(spark, store)
        assert {r.map_version for r in out} == {stored.version}
        assert all(stored.shard_of[r.vslot] == r.shard for r in out)
        for shard in range(n):
            assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
        return stored, sizes

    one, sizes = run(4)
    assert one == sharding.build_map(sizes, 4, 512) and one.version == 1
    assert run(4)[0] == one
    two, _ = run(5)
    assert two == sharding.rebalance(one, sizes, 5)
    moved = [s for s in range(512) if one.shard_of[s] != two.shard_of[s]]
    assert two.version == 2 and moved and {two.shard_of[s] for s in moved} == {4}
    more = docs.unionByName(spark.createDataFrame([(i, "y" * 400) for i in range(3000, 3100)], docs.schema))
    three, sizes = run(5, more)
    assert three.version == 3
    loads = [sum(sizes.get(s, 0) for s in range(512) if three.shard_of[s] == k) for k in range(5)]
    assert max(loads) < 1.03 * sum(loads) / 5


def test_null_and_repeated_keys_are_spread(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(400)], "doc_id long, text string")
    assert max(r["count"] for r in sharding.assign(docs, 4).groupBy("vslot").count().collect()) < 10
