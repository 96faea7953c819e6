"""Embedding near duplicates by PCA-ordered tiled comparison.

Rows with one label and one vector form a class.  Classes are turned to the axes of their second moments, largest first,
and put in order of label and of their cells on the leading axes; runs of them make tiles of bounded size.  Tiles
of one label are compared if their boxes on the leading axes are near enough for a link.  A pair of tiles is one
row: it accumulates the leading axes' products first, bounds what is left by the norms of the suffixes, and goes
on only with pairs whose cosine can still reach the threshold.  Those are settled by the vectors as given, in double
precision.

A pair of tiles returns numbers of links by class and a spanning forest, at most two rows a member, never the
pairs.  Components come from the forests by alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import Scratch
from chronoreel.llm._text import tidied
from chronoreel.llm.codes import usable
from chronoreel.llm.minhash import components

THRESHOLD = 0.98
#: Vectors of a tile, and components: 2 MB as single, 4 MB as double numbers.
TILE, TILE_VALUES = 4096, 1 << 19
#: Leading axes whose cells give the order, and that bound a tile's box.
AXES = 4
#: Axes added at a time.
STEP = 16
#: Rows of one tile compared at once, and pairs whose products are made one by one.
ROWS, PAIRS = 512, 1 << 15
#: Rounding of bounds.
OFF = 1e-9
#: Lengths of vectors with axes of their own; others, if there are more, keep their components' order.
LENGTHS = 8
#: Classes that may be broadcast to rows; beyond, a shuffle joins them.
BROADCAST_CLASSES = 200_000


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles with their norms; those of extreme size are scaled first, which leaves cosines as they are."""
    v = vectors.astype(np.float64)
    largest = np.abs(v).max(axis=1, initial=0)
    odd = (largest > 1e100) | (largest < 1e-100)
    v[odd] /= largest[odd, None]
    return v, np.sqrt(np.einsum("ij,ij->i", v, v))


def rows_of(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, type]:
    """(id, label, length, digest, v) and v's kind of number: ``digest`` names the vector and is null where nothing can be linked."""
    wide = not isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    zero = F.forall(vector, lambda x: x == 0)
    good = usable(F.col(vector)) & F.col(label).isNotNull() & ~F.coalesce(zero, F.lit(True))
    cast = F.col(vector).cast("array<double>" if wide else "array<float>")
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(good, cast).alias("v"))
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("label", df.schema[label].dataType), *T._parse_datatype_string("length int, digest binary, v binary")])
    kind = np.float64 if wide else np.float32

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at = column.offsets.to_numpy()
            # adding zero makes one of both zeros
            values = column.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
            raw = [values[at[i] : at[i + 1]].tobytes() if column[i].is_valid else None for i in range(batch.num_rows)]
            named = [hashlib.blake2b(x, digest_size=16).digest() if x is not None else None for x in raw]
            size = [len(x) // kind().itemsize if x is not None else None for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int32()), pa.array(named, pa.binary()), pa.array(raw, pa.binary())], ["id", "label", "length", "digest", "v"])

    return rows.mapInArrow(work, schema), kind


def _stack(column: pa.Array, kind, length: int) -> np.ndarray:
    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + column.offset + 1)[column.offset :]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, length)


def axes(classes: DataFrame, kind) -> dict[int, np.ndarray]:
    """For each of the commonest lengths the axes of all classes' second moments, as columns, largest first.  A task adds up
    its products; the sums have length^2 numbers, whatever the rows."""
    common = classes.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "length").limit(LENGTHS).collect()
    lengths = [r["length"] for r in common]

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            size = batch.column(0).to_numpy(zero_copy_only=False)
            for n in np.unique(size).tolist():
                if n in lengths:
                    v, norm = units(_stack(batch.column(1).filter(pa.array(size == n)), kind, n))
                    u = v / norm[:, None]
                    held[n] = held.get(n, 0) + u.T @ u
        for n, m in held.items():
            upper = np.flatnonzero(np.triu(np.ones((n, n), dtype=bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper), n, dtype=np.int32)), pa.array(upper, pa.int64()), pa.array(m.reshape(-1)[upper])], ["length", "at", "x"])

    sums = classes.select("length", "v").mapInArrow(work, "length int, at long, x double").groupBy("length", "at").agg(F.sum("x").alias("x")).collect()
    moments = {n: np.zeros(n * n) for n in lengths}
    for r in sums:
        moments[r["length"]][r["at"]] = r["x"]
    out = {}
    for n, m in moments.items():
        m = m.reshape(n, n)
        _, vectors = np.linalg.eigh(m + np.triu(m, 1).T)
        out[n] = np.ascontiguousarray(vectors[:, ::-1])
    return out


def _turned(v: np.ndarray, norm: np.ndarray, turn: dict[int, np.ndarray]) -> np.ndarray:
    u = v / norm[:, None]
    return u @ turn[v.shape[1]] if v.shape[1] in turn else u


TILES = "tile long, length int, n int, low array<double>, high array<double>, numbers binary, copies binary, v binary"


def tiles(classes: DataFrame, turn, kind, reach: float, tile: int) -> DataFrame:
    """(label, tile, length, n, low, high, numbers, v): runs of classes in order of label, length and cells of ``reach`` on the
    leading axes.  Spark deals them out by ranges, so a common label or cell fills many tasks."""
    named = T.StructType([classes.schema["label"], *T._parse_datatype_string("no long, copies long, length int, cells array<int>, v binary")])

    @tidied
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).to_numpy(zero_copy_only=False)
            cells = np.zeros((batch.num_rows, AXES), dtype=np.int32)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                v, norm = units(_stack(batch.column(4).take(pa.array(at)), kind, n))
                lead = _turned(v, norm, turn.value)[:, :AXES]
                cells[at, : lead.shape[1]] = np.floor(lead / reach)
            places = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, AXES), pa.int32()), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], places, batch.column(4)], ["label", "no", "copies", "length", "cells", "v"])

    @tidied
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            nonlocal number
            n = held[0].column(3)[0].as_py()
            v, norm = units(_stack(pa.concat_arrays([b.column(4) for b in held]), kind, n))
            lead = _turned(v, norm, turn.value)[:, :AXES]
            numbers, copies = (np.concatenate([b.column(c).to_numpy() for b in held]).astype("<i8").tobytes() for c in (1, 2))
            raw = b"".join(x for b in held for x in b.column(4).to_pylist())
            number += 1
            values = [[number], [n], [len(v)], [lead.min(axis=0).tolist()], [lead.max(axis=0).tolist()], [numbers], [copies], [raw]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([held[0].column(0).slice(0, 1), *(pa.array(x, t) for x, t in zip(values, kinds, strict=True))], ["label", "tile", "length", "n", "low", "high", "numbers", "copies", "v"])

        for batch in batches:
            label, size = batch.column(0), batch.column(3)
            changes = [i for i in range(1, batch.num_rows) if not (label[i] == label[i - 1] and size[i] == size[i - 1])]
            for a, z in zip([0, *changes], [*changes, batch.num_rows], strict=True):
                if held and not (label[a] == held[0].column(0)[0] and size[a] == held[0].column(3)[0]):
                    yield made()
                    held = []
                most = max(1, min(tile, TILE_VALUES // max(1, size[a].as_py())))
                while a < z:
                    part = batch.slice(a, min(z - a, most - sum(b.num_rows for b in held)))
                    held.append(part)
                    a += part.num_rows
                    if sum(b.num_rows for b in held) == most:
                        yield made()
                        held = []
        if held:
            yield made()

    placed = classes.select("label", "no", "copies", "length", "v").mapInArrow(place, named)
    rows = classes.count()
    spread = max(1, min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // tile)))
    dealt = placed.repartitionByRange(spread, "label", "length", "cells", "no").sortWithinPartitions("label", "length", "cells", "no")
    return dealt.select("label", "no", "copies", "length", "v").mapInArrow(gather, T.StructType([classes.schema["label"], *T._parse_datatype_string(TILES)]))


def tile_pairs(made: DataFrame, reach: float) -> DataFrame:
    """(a, b): tiles of one label and length whose boxes lie within ``reach`` of each other, each pair and each tile with
    itself once.  Tiles meet by cells of the first axis that their interval, ``reach`` longer, covers."""
    wide = reach + OFF
    cell = lambda x: F.floor(x / wide).cast("long")
    small = made.select("label", "length", "tile", "low", "high")
    low, high = F.col("low")[0], F.col("high")[0]
    a = small.withColumn("cell", F.explode(F.sequence(cell(low), cell(high + wide)))).select("label", "length", "cell", F.struct("tile", "low", "high").alias("a"))
    b = small.select("label", "length", cell(low).alias("cell"), F.struct("tile", "low", "high").alias("b"))
    first = (F.col("a.low")[0] < F.col("b.low")[0]) | ((F.col("a.low")[0] == F.col("b.low")[0]) & (F.col("a.tile") <= F.col("b.tile")))
    gaps = F.zip_with(F.arrays_zip(F.col("a.low").alias("l"), F.col("a.high").alias("h")), F.arrays_zip(F.col("b.low").alias("l"), F.col("b.high").alias("h")), lambda x, y: F.greatest(F.lit(0.0), x["l"] - y["h"], y["l"] - x["h"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, ["label", "length", "cell"]).where(first & (apart <= wide * wide)).select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b"))


class Forest:
    """A spanning forest over numbered members."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[np.ndarray] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes in links i - j: while any connects two trees, each tree of a larger number is hung under the smallest number
        that it has a link to, so that a link is kept for each tree that goes."""
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            lead = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
            self.edges.append(np.stack([i[lead], j[lead]], axis=1))
            to = np.arange(len(self.root))
            to[high[lead]] = low[lead]
            while True:
                further = to[to]
                if (further == to).all():
                    break
                to = further
            self.root = to[self.root]


def compare(a: np.ndarray, b: np.ndarray | None, turn: dict[int, np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i of a, j of b) of two tiles, or of one with itself (i < j), a bounded number at a time."""
    va, na = units(a)
    vb, nb = (va, na) if b is None else units(b)
    ta = _turned(va, na, turn)
    tb = ta if b is None else _turned(vb, nb, turn)
    width = ta.shape[1]
    rest = lambda t, k: np.sqrt(np.maximum(0.0, (t[:, k:] ** 2).sum(axis=1)))
    steps = list(range(STEP, width, STEP)) + [width]
    ends_a, ends_b = {k: rest(ta, k) for k in steps}, {k: rest(tb, k) for k in steps}
    floor = threshold - OFF
    for r in range(0, len(ta), ROWS):
        own = ta[r : r + ROWS]
        since = r if b is None else 0
        k = steps[0]
        s = own[:, :k] @ tb[since:, :k].T
        near = s + np.multiply.outer(ends_a[k][r : r + ROWS], ends_b[k][since:]) >= floor
        if b is None:
            near &= np.arange(near.shape[1])[None, :] > np.arange(near.shape[0])[:, None]
        if near.mean() > 0.05:
            # dense: all products of the vectors as given
            exact = (va[r : r + ROWS] @ vb[since:].T) / np.multiply.outer(na[r : r + ROWS], nb[since:])
            i, j = np.nonzero(near & (exact >= threshold))
            yield i + r, j + since
            continue
        i, j = np.nonzero(near)
        for p in range(0, len(i), PAIRS):
            x, y = i[p : p + PAIRS], j[p : p + PAIRS]
            sums = s[x, y]
            x, y = x + r, y + since
            for before, k in zip(steps, steps[1:], strict=False):
                sums = sums + np.einsum("ij,ij->i", ta[x, before:k], tb[y, before:k])
                can = sums + ends_a[k][x] * ends_b[k][y] >= floor
                x, y, sums = x[can], y[can], sums[can]
            exact = np.einsum("ij,ij->i", va[x], vb[y]) / (na[x] * nb[y])
            yield x[exact >= threshold], y[exact >= threshold]


LINKS = "no long, other long, n long"


def links(made: DataFrame, pairs: DataFrame, turn, kind, threshold: float) -> DataFrame:
    """(no, other, n): rows with ``other`` are the forests' links, those with n a class's links to other classes' rows."""
    side = lambda x: made.select(F.col("tile").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("length", "numbers", "copies", "v")))
    met = pairs.join(side("a"), "a").join(side("b"), "b")

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                own = lambda n, t: [np.frombuffer(row[f"{n}_{x}"], dtype=t) for x in (("a",) if row["a"] == row["b"] else ("a", "b"))]  # noqa: E731, B023
                sides = [x.reshape(-1, row["length_a"]) for x in own("v", kind)]
                no, weight = np.concatenate(own("numbers", "<i8")), np.concatenate(own("copies", "<i8"))
                found, forest = np.zeros(len(no), dtype=np.int64), Forest(len(no))
                for i, j in compare(sides[0], sides[1] if len(sides) > 1 else None, turn.value, threshold):
                    j = j + (len(sides[0]) if len(sides) > 1 else 0)
                    np.add.at(found, i, weight[j])
                    np.add.at(found, j, weight[i])
                    forest.join(i, j)
                at, edges = np.flatnonzero(found), np.concatenate([np.zeros((0, 2), dtype=np.int64), *forest.edges])
                missing = lambda n: pa.nulls(n, pa.int64())
                columns = [pa.array(np.concatenate([no[at], no[edges[:, 0]]])), pa.concat_arrays([missing(len(at)), pa.array(no[edges[:, 1]])]), pa.concat_arrays([pa.array(found[at]), missing(len(edges))])]
                yield pa.RecordBatch.from_arrays(columns, ["no", "other", "n"])

    return met.mapInArrow(work, LINKS)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Rows of one label whose vectors' cosine, in double precision, is ``threshold`` (above 0) or more are linked, equal vectors among
    them.  ``n_links`` counts other rows linked directly, ``component_id`` is the smallest key reachable, itself included,
    and ``kept`` marks it.  Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing; nor do vectors of unlike length.  A null key gets the component of what it is linked with, if that has a
    key, else null, and is kept only then.  Rows that repeat a key are rows of their own.  Only the named columns are read.
    """
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "vectors")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows, kind = rows_of(df, key, vector, label)
    rows = scratch.save(rows, "rows")
    same = ["label", "length", "digest"]
    classes = rows.where("digest is not null").groupBy(*same).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = scratch.save(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    turn = spark.sparkContext.broadcast(axes(classes, kind))
    made = scratch.save(tiles(classes, turn, kind, reach, tile), "tiles")
    pairs = scratch.save(tile_pairs(made, reach), "pairs")
    found = scratch.save(links(made, pairs, turn, kind, threshold), "links")
    met = components(scratch, found.where("other is not null").select(F.col("no").alias("a"), F.col("other").alias("b")))
    met = scratch.save(met.unionByName(met.select(F.col("component").alias("id"), "component").distinct()), "met")
    numbers = found.where("n is not null").groupBy("no").agg(F.sum("n").alias("others"))
    named = classes.select("no", *same, "copies", "least").join(met.withColumnRenamed("id", "no"), "no", "left").join(numbers, "no", "left")
    named = named.where("copies > 1 or component is not null")
    heads = scratch.save(named.withColumn("group", F.coalesce("component", "no")).select("group", *same, "copies", "least", F.coalesce("others", F.lit(0)).alias("others")), "named")
    least = scratch.save(heads.groupBy("group").agg(F.min("least").alias("component_id")), "least")
    by_class = scratch.save(heads.join(least, "group").select(*same, (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id"), "by-class")
    if by_class.count() <= BROADCAST_CLASSES:
        by_class = F.broadcast(by_class)
    out = rows.select("id", *same).join(by_class, same, "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    scratch.drop(made, pairs, found, heads, least)
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def op11_embeddings(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """Contract columns for ``embeddings``."""
    return near_duplicates(embeddings)
