"""Shards by fixed virtual slots.

Records hash into ``VIRTUAL_SLOTS`` slots, bytes and rows are summed per slot, and a
versioned slot-to-shard map says where each slot lives.  A map is built once from the
slot sizes; later versions are edits of it that move as few slots as even sizes need.

Everything per record is a native expression.  The only data on the driver is the slot
table, whose size is the constant VIRTUAL_SLOTS whatever the input.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoreel.llm._io import Scratch, crc32_long

#: Fixed for the life of a data set: a record's slot never changes.
VIRTUAL_SLOTS = 16384
#: Bytes that a record costs besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shard_of[slot]`` for each of the fixed slots."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def rows(self, spark: SparkSession) -> DataFrame:
        """The map as a table (map_version, n_shards, vslot, shard) to store beside the data."""
        return spark.range(len(self.shard_of)).select(
            F.lit(self.version).alias("map_version"),
            F.lit(self.n_shards).alias("n_shards"),
            F.col("id").cast("int").alias("vslot"),
            _pick(self.shard_of, F.col("id")).cast("int").alias("shard"),
        )


def _pick(values, at) -> F.Column:
    """values[at] from one literal, which costs a single expression however long it is."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ","), at.cast("int"))


def load_map(spark: SparkSession, store: str) -> SlotMap | None:
    """The latest version in the folder ``store``, None if there is none yet.  A version is a table of its own, as
    many rows as slots, and is never changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    whole = [n for n in names if n.startswith("version-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS"))]
    if not whole:
        return None
    rows = spark.read.parquet(f"{store}/{max(whole)}").orderBy("vslot").collect()
    return SlotMap(rows[0].map_version, rows[0].n_shards, tuple(r.shard for r in rows))


def store_map(spark: SparkSession, store: str, slot_map: SlotMap) -> DataFrame:
    """Writes a version beside the earlier ones and returns its rows; an existing version is an error."""
    path = f"{store}/version-{slot_map.version:06d}"
    slot_map.rows(spark).write.parquet(path)
    return spark.read.parquet(path)


def virtual_slot(*record, slots: int = VIRTUAL_SLOTS) -> F.Column:
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


def record_size(text) -> F.Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


def slot_sizes(df: DataFrame, key: str, text: str, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Rows and bytes per virtual slot: at most ``slots`` rows, summed before the shuffle."""
    return df.groupBy(virtual_slot(F.col(key), F.col(text), slots=slots).alias("vslot")).agg(
        F.sum(record_size(F.col(text))).alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def build_map(sizes: dict[int, int], n_shards: int, slots: int = VIRTUAL_SLOTS) -> SlotMap:
    """First version: slots by falling size, each to the lightest shard so far.  Ties go to
    the smaller slot and shard; empty slots are dealt in turn."""
    heap = [(0, 0, s) for s in range(n_shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), held + 1, shard))
    return SlotMap(1, n_shards, tuple(shard_of))


def rebalance(old: SlotMap, sizes: dict[int, int], n_shards: int, tolerance: float = 0.001) -> SlotMap:
    """Next version for ``n_shards`` (not fewer than before): slots leave shards above the new
    mean, the largest that fit first, for shards that are below it.  All others stay."""
    if n_shards < old.n_shards:
        raise ValueError("shards can only be added")
    shard_of, loads = list(old.shard_of), [0] * n_shards
    for slot, shard in enumerate(shard_of):
        loads[shard] += sizes.get(slot, 0)
    mean = sum(loads) / n_shards
    members: dict[int, list[int]] = {}
    for slot, shard in enumerate(shard_of):
        members.setdefault(shard, []).append(slot)
    for shard in sorted(members, key=lambda s: -loads[s]):
        for slot in sorted(members[shard], key=lambda s: (-sizes.get(s, 0), s)):
            size, to = sizes.get(slot, 0), min(range(n_shards), key=lambda s: (loads[s], s))
            if loads[shard] <= mean * (1 + tolerance):
                break
            if size and loads[to] + size < loads[shard] and loads[shard] - size >= mean * (1 - tolerance):
                loads[shard] -= size
                loads[to] += size
                shard_of[slot] = to
    return SlotMap(old.version + 1, n_shards, tuple(shard_of))


def collect_sizes(df: DataFrame, key: str, text: str, slots: int = VIRTUAL_SLOTS) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows per slot on the driver: bounded by the constant number of slots."""
    found = slot_sizes(df, key, text, slots).collect()
    return {r.vslot: r.bytes for r in found}, {r.vslot: r.rows for r in found}


def current_map(spark: SparkSession, sizes: dict[int, int], n_shards: int, slots: int, store: str, tolerance: float) -> tuple[SlotMap, DataFrame]:
    """The map to use and its stored rows: the latest version in ``store``, edited and stored as the next one where
    shards were added or a shard is more than ``tolerance`` above the mean; the first version where there is none."""
    old = load_map(spark, store)
    if old is None:
        new = build_map(sizes, n_shards, slots)
        return new, store_map(spark, store, new)
    if len(old.shard_of) != slots:
        raise ValueError("the number of slots is fixed")
    loads = [0] * old.n_shards
    for slot, shard in enumerate(old.shard_of):
        loads[shard] += sizes.get(slot, 0)
    if n_shards != old.n_shards or max(loads) > (1 + tolerance) * sum(loads) / n_shards:
        new = rebalance(old, sizes, n_shards)
        if new.shard_of != old.shard_of or n_shards != old.n_shards:
            return new, store_map(spark, store, new)
    return old, spark.read.parquet(f"{store}/version-{old.version:06d}")


def assign(
    df: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text", slots: int = VIRTUAL_SLOTS, store: str | None = None, tolerance: float = 0.01
) -> DataFrame:
    """``df``'s rows as (key, size, text_crc32, vslot, map_version, shard, slot): the shard by the slot map
    in the folder ``store`` and the row's place in its shard, gapless from 0.

    Law: bytes.  Sizes of shards are near equal, as near as one slot's bytes; one record larger than a
    shard's share stays whole.  The map is read from ``store``, and a next version is written where shards were added or
    sizes have moved by more than ``tolerance``; without a folder the map is a first version in the shared folder.
    Places follow (virtual slot, key, text hash, size); rows that agree in all of these are interchangeable.  A record is
    a key with its text, so null or repeated keys are spread over slots as their texts are; equal rows share a slot.
    A null text counts no bytes, an empty table gives no rows.  Only the named columns are read, so others may have
    any name.  The map is broadcast: ``slots`` rows, whatever the input.
    """
    spark = df.sparkSession
    sizes, counts = collect_sizes(df, key, text, slots)
    slot_map, stored = current_map(spark, sizes, n_shards, slots, store or Scratch(spark, "slot-map").root, tolerance)
    first, filled = [0] * slots, [0] * slot_map.n_shards
    for vslot, shard in enumerate(slot_map.shard_of):
        first[vslot] = filled[shard]
        filled[shard] += counts.get(vslot, 0)
    stored = stored.drop("n_shards").withColumn("first", _pick(first, F.col("vslot")).cast("long"))
    rows = df.select(
        F.col(key).alias(key),
        record_size(F.col(text)).alias("size"),
        crc32_long(F.col(text)).alias("text_crc32"),
        virtual_slot(F.col(key), F.col(text), slots=slots).alias("vslot"),
    )
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size"))
    return (
        rows.withColumn("place", place)
        .join(F.broadcast(stored), "vslot")
        .select(key, "size", "text_crc32", "vslot", "map_version", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))
    )


def op2_sharding(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract columns for the ``documents`` table."""
    return assign(documents, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version"
    )
