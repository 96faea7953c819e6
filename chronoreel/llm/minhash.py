"""Near duplicates: many universal hash minima with banding, signature checks, exact
confirmation on full shingle sets, and components by alternating large-star and small-star.

Documents with one and the same text form a class, and only the class's smallest
document takes part further on.  Members that share a band meet in a bucket, and buckets that
share members form a cluster.  A cluster within a block's bounds is compared as one group: the
signatures first, then the full sets, whose shingles are the words themselves, not hashes of them.
A task returns links of a spanning forest: at most one row a member, never all pairs.

In larger clusters every bucket is a group of its own; buckets with the same members are met
once.  A bucket beyond a block's bounds is first linked as a star to its smallest member.  What
that joins is one component and need not be compared again: if it is the whole bucket, the
bucket is done.  Otherwise members outside the largest component are compared, in blocks,
with each other and with that component, every pair of blocks in a task of its own, so no
link is lost and no task holds more than two blocks.  A block is bounded in members and in
shingles, so long documents make small blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import Scratch, free_name
from chronoreel.llm._text import SPACES, Words, buffers, chunks, mix64, shingles, tidied, tidy

#: 32 bands of 6 minima: a pair at similarity 0.85 shares none with probability 3e-7, at 0.8 6e-5.
BANDS, ROWS = 32, 6
MINIMA = BANDS * ROWS
#: Members of one block, and their shingles (about 8 MB of text and as much of sets), or one longer document; a task
#: holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Standard deviations below the threshold at which an estimate from signatures rules a pair out.
SLACK = 5.0
#: Rows of document ids that may be broadcast (16 MB); beyond, ids and texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SEED = 20240601

_random = np.random.default_rng(SEED)
#: h(x) = (a x + b mod 2^64) >> 32 over 32-bit x: strongly universal.
_A = _random.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, MINIMA, dtype=np.uint64)


def signature(elements: np.ndarray) -> np.ndarray:
    """MINIMA minima of a set of 64-bit elements."""
    x, low = elements >> np.uint64(32), None
    for i in range(0, len(x), 2048):
        h = np.multiply.outer(_A, x[i : i + 2048])
        h += _B[:, None]
        least = h.min(axis=1)
        low = least if low is None else np.minimum(low, least)
    return (low >> np.uint64(32)).astype("<u4")


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band of each row of minima."""
    bands = minima.reshape(len(minima), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for r in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return out.view(np.int64)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        words = Words(data, offsets[i : j + 1], SPACES)
        for n in range(j - i):
            yield np.unique(shingles(words.hash[words.first[n] : words.first[n + 1]], k))


def exact_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, as numbers that are equal just where the words are."""
    data, offsets = buffers(column)
    parts, counts = [], [np.zeros(1, np.int64)]
    for i, j in chunks(offsets):
        words = Words(data, offsets[i : j + 1], SPACES)
        parts.append(words.array())
        counts.append(np.diff(words.first))
    first = np.cumsum(np.concatenate(counts))
    named = pa.concat_arrays(parts or [pa.array([], pa.large_binary())]).dictionary_encode()
    at = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = bits = max(1, len(named.dictionary).bit_length())
    code = at
    for j in range(1, k):
        if width + bits > 63:
            seen, code = np.unique(code, return_inverse=True)
            width = max(1, len(seen).bit_length())
        code = (code[: max(0, len(at) - j)] << bits) | at[j:]
        width += bits
    short: dict[bytes, int] = {}
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= k:
            out.append(np.unique(code[a : z - k + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(at[a:z].tobytes(), len(short))] if z > a else [], dtype=np.int64))
    return out


def _digest(text) -> F.Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, digest, n_shingles, bands, sig): ``digest`` names the text; ``bands`` are its buckets and ``sig`` the lower
    halves of its minima, null for the empty set."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, minima = np.zeros(batch.num_rows, np.int64), []
            for i, elements in enumerate(_sets(batch.column(2), k)):
                counts[i] = len(elements)
                if len(elements):
                    minima.append(signature(elements))
            at = np.where(counts > 0, np.cumsum(counts > 0) - 1, -1).tolist()
            minima = np.stack(minima) if minima else np.zeros((0, MINIMA), "<u4")
            bands, low = list(band_keys(minima)), minima.astype("<u2")
            columns = [pa.array(counts), pa.array([bands[i] if i >= 0 else None for i in at], pa.list_(pa.int64())), pa.array([low[i].tobytes() if i >= 0 else None for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "digest", "n_shingles", "bands", "sig"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), *T._parse_datatype_string("digest binary, n_shingles long, bands array<long>, sig binary")])
    return docs.select(F.col(key).alias("id"), _digest(F.col(text)).alias("digest"), F.col(text)).mapInArrow(work, schema)


def _buckets(classes: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """(bucket, id, members) of buckets of two or more, each set of members once."""
    in_bands = classes.select("id", F.explode("bands").alias("bucket"))
    same = F.sum(F.xxhash64("id").cast("decimal(20,0)"))
    sizes = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), same.alias("who")).where("members > 1")
    once = scratch.save(sizes.groupBy("members", "who").agg(F.min("bucket").alias("bucket")), "buckets", n * BANDS // 2)
    placed = scratch.save(in_bands.join(once, "bucket").select("bucket", "id", "members"), "members")
    scratch.drop(once)
    return placed


def _links(k: int, threshold: float):
    """Links within a group of members: exact, forming a forest over what ``part`` already joins.  Members of different
    sides are compared if the group is crossing, all otherwise."""
    floor = threshold - SLACK * (threshold * (1 - threshold) / MINIMA) ** 0.5
    least = Fraction(str(threshold))
    few, many = least.numerator, least.denominator

    def work(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        n = len(ids)
        sides = np.asarray(table.column("side").to_numpy())
        crossing = table.column("crossing")[0].as_py()
        sets = exact_sets(table.column("text").combine_chunks(), k)
        sigs = np.stack([np.frombuffer(x, dtype="<u2") for x in table.column("sig").to_pylist()])
        sizes = np.array([len(x) for x in sets])
        number: dict = {}
        root = np.array([number.setdefault(p, len(number)) for p in table.column("part").to_pylist()])
        out: list[tuple[int, int]] = []
        for i in range(1, n):
            apart = root[:i] != root[i]
            if crossing:
                apart &= sides[:i] != sides[i]
            at = np.flatnonzero(apart & (np.minimum(sizes[:i], sizes[i]) * many >= few * np.maximum(sizes[:i], sizes[i])))
            like = (sigs[at] == sigs[i]).mean(axis=1)
            at, like = at[like >= floor], like[like >= floor]
            for j in at[np.argsort(-like, kind="stable")].tolist():
                if root[i] == root[j]:
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if many * shared >= few * (sizes[i] + sizes[j] - shared):
                    out.append((ids[i], ids[j]))
                    root[root == root[i]] = root[j]
        kind = table.schema.field("id").type
        tidy()
        return pa.table({"a": pa.array([x for x, _ in out], kind), "b": pa.array([x for _, x in out], kind)})

    return work


GROUP = ("bucket", "step", "x", "y")


def _compare(rows: DataFrame, full: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links found in every group of ``rows`` (GROUP, id, side, crossing, part)."""
    kind = rows.schema["id"].dataType
    edge = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return rows.join(full, "id").groupBy(*GROUP).applyInArrow(_links(k, threshold), edge)


def _block(members: str, weight: str) -> F.Column:
    """A member's block among as many as its fellows fill."""
    return F.pmod(F.xxhash64("id", F.lit(SEED)), _blocks(members, weight)).cast("int")


def _blocks(members: str, weight: str) -> F.Column:
    return F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(weight) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _each(n: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _fits(members: str, weight: str) -> F.Column:
    return (F.col(members) <= BLOCK) & (F.col(weight) <= BLOCK_SHINGLES)


def _totals(rows: DataFrame, by: str, members: str, weight: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias(members), F.sum("n").alias(weight))


def _clusters(placed: DataFrame, weights: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """(id, n, cluster, within, weight): members that buckets join, directly or through others, how many a cluster has
    and their shingles.  A member names its buckets' leaders (BANDS at most) at once, so that edges between leaders,
    of which there are few, take the place of one edge a bucket and member."""
    leaders = scratch.save(placed.groupBy("bucket").agg(F.min("id").alias("leader")), "bucket-leaders", n * BANDS // 2)
    known = placed.join(leaders, "bucket").groupBy("id").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    known = scratch.save(known, "leaders-of", n)
    least = F.col("leaders")[0]
    edges = known.select(F.col("id").alias("a"), least.alias("b")).unionByName(known.select(F.explode(F.slice("leaders", 2, BANDS)).alias("a"), least.alias("b")).distinct())
    met = components(scratch, edges, n * BANDS)
    met = met.unionByName(met.select(F.col("component").alias("id"), "component").distinct()).join(weights, "id")
    met = scratch.save(met, "met")
    sizes = scratch.save(_totals(met, "component", "within", "weight"), "cluster-sizes", n)
    scratch.drop(leaders, known)
    return met.join(sizes, "component").select("id", "n", F.col("component").alias("cluster"), "within", "weight")


def _star_rows(large: DataFrame, scratch: Scratch) -> DataFrame:
    """Each leader with blocks of its members: a large bucket's leader is its smallest member, and buckets of one
    leader are met together."""
    leaders = scratch.save(large.groupBy("bucket").agg(F.min("id").alias("leader")), "leaders")
    pairs = scratch.save(large.join(leaders, "bucket").where(F.col("id") != F.col("leader")).select("leader", "id", "n").distinct(), "stars")
    sizes = scratch.save(_totals(pairs, "leader", "members", "weight"), "sizes")
    star = [F.xxhash64("leader").alias("bucket"), F.lit(1).alias("step"), F.lit(0).alias("x")]
    members = pairs.join(sizes, "leader").select(*star, _block("members", "weight").alias("y"), "id", F.lit(1).alias("side"))
    heads = sizes.select(*star, _each(_blocks("members", "weight")).alias("y"), F.col("leader").alias("id"), F.lit(0).alias("side"))
    return members.unionByName(heads).select(*GROUP, "id", "side", F.lit(True).alias("crossing"), F.col("id").alias("part"))


def _rest_rows(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Groups in which members outside a bucket's largest part meet each other and that part.  ``parts`` has bucket,
    id, n and part."""
    sizes = parts.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    largest = F.max_by(F.struct("part", "members", "weight"), F.struct("members", "part")).alias("main")
    split = sizes.groupBy("bucket").agg(largest, F.sum("members").alias("members"), F.sum("weight").alias("weight"))
    inside = [F.col("main.members").alias("inside"), F.col("main.weight").alias("inside_w")]
    outside = [(F.col("members") - F.col("main.members")).alias("outside"), (F.col("weight") - F.col("main.weight")).alias("outside_w")]
    split = scratch.save(split.where("main.members < members").select("bucket", F.col("main.part").alias("main"), *inside, *outside), "split")
    rows = scratch.save(parts.join(split, "bucket").withColumn("is_main", F.col("part") == F.col("main")), "parts")
    out_blocks, in_blocks = _blocks("outside", "outside_w"), _blocks("inside", "inside_w")
    few, many = rows.where("not is_main").withColumn("own", _block("outside", "outside_w")), rows.where("is_main").withColumn("own", _block("inside", "inside_w"))
    among = few.withColumn("o", _each(out_blocks))
    among = among.select("bucket", F.lit(2).alias("step"), F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), "id", F.col("own").alias("side"), (F.col("own") != F.col("o")).alias("crossing"), "part")
    to_main = few.select("bucket", F.lit(3).alias("step"), F.col("own").alias("x"), _each(in_blocks).alias("y"), "id", F.lit(0).alias("side"), F.lit(True).alias("crossing"), "part")
    of_main = many.select("bucket", F.lit(3).alias("step"), _each(out_blocks).alias("x"), F.col("own").alias("y"), "id", F.lit(1).alias("side"), F.lit(True).alias("crossing"), "part")
    return among.unionByName(to_main).unionByName(of_main)


def _full(docs: DataFrame, key: str, text: str, signed: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text, sig) of the wanted documents.  A key given with unlike texts has a row for each class it leads."""
    few = _bounded(wanted)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(few, "id", "left_semi")
    texts = texts.withColumn("own", _digest(F.col("text")))
    leading = classes.join(few, "id", "left_semi").select("id", "digest")
    sigs = signed.join(few, "id", "left_semi").select("id", "digest", "sig").join(leading, ["id", "digest"]).groupBy("id", "digest").agg(F.first("sig").alias("sig"))
    # not an equality, so that rows are dealt by id alone
    return texts.join(sigs, (texts["id"] == sigs["id"]) & F.array_contains(F.array("own"), F.col("digest"))).select(texts["id"], "text", "sig")


def components(scratch: Scratch, links: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component) of all linked ids: the smallest id reachable.  Alternating large-star and small-star
    on written tables; each star is a grouped minimum and a join, so no neighbourhood is ever collected.  ``rows`` bounds the links, if known."""
    edges = scratch.save(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "edges", rows)
    while not (state := _shape(edges))["stars"]:
        # no table of a round has more rows than twice its edges
        rows = 2 * state["n"]
        # large-star: every larger neighbour of a node joins the smallest one
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least", rows)
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        large = scratch.save(large, "large", rows)
        # small-star: a node and its smaller neighbours join the smallest of them
        low = scratch.save(large.groupBy("v").agg(F.min("u").alias("m")), "low", rows)
        small = large.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        after = scratch.save(small.where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges", rows)
        scratch.drop(least, large, low, edges)
        edges = after
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))


def _shape(edges: DataFrame):
    """n, the number of edges, and whether they are stars: every node has one smaller neighbour, which has none itself, or has
    none.  Stars are what the rounds end with: a node's smaller neighbour is the smallest it reaches."""
    ends = edges.select(F.col("u").alias("id"), F.lit(0).alias("over")).unionByName(edges.select(F.col("v").alias("id"), F.lit(1).alias("over")))
    nodes = ends.groupBy("id").agg(F.sum("over").alias("over"), F.count(F.lit(1)).alias("ends"))
    return nodes.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("n"), F.coalesce(F.bool_and(F.expr("over = 0 or ends = 1")), F.lit(True)).alias("stars")).first()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs of non-space, A-Z lower-cased; a document's set holds its distinct ``k``-word shingles, or all
    its words as one when it has fewer.  Documents whose sets' Jaccard similarity is ``threshold`` or more are
    linked; ``component_id`` is the smallest key reachable and ``kept`` marks it.  Null, empty and blank texts are
    linked with nothing.  Rows that repeat a key are one document, linked as any of their texts is.  A null key gets the component of its copies,
    if any, else null, and is kept only then.  Keys may have any type with an order.  Only the two named columns are read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    signed = scratch.save(signatures(docs, key, text, k), "signatures")
    n = signed.count()
    first = F.min(F.struct("id", "n_shingles", "bands")).alias("m")
    banded = signed.where("n_shingles > 0 and id is not null").groupBy("digest").agg(first)
    banded = scratch.save(banded.select("digest", "m.*"), "banded", n)
    classes = scratch.save(banded.select("digest", "id", F.col("n_shingles").alias("n")), "classes")
    weights = classes.groupBy("id").agg(F.sum("n").alias("n"))

    placed = _buckets(banded, scratch, n)
    scratch.drop(banded)
    clusters = scratch.save(_clusters(placed, weights, scratch, n), "clusters")
    alone = [F.lit(0).alias("step"), F.lit(0).alias("x"), F.lit(0).alias("y"), "id", F.lit(0).alias("side"), F.lit(False).alias("crossing"), F.col("id").alias("part")]
    rows = clusters.where(_fits("within", "weight")).select(F.xxhash64("cluster").alias("bucket"), *alone)
    wide = scratch.save(placed.join(clusters.where(~_fits("within", "weight")).select("id", "n"), "id"), "wide")
    stars, found_in = None, [placed, wide, clusters]
    if not wide.isEmpty():
        sums = scratch.save(wide.groupBy("bucket").agg(F.sum("n").alias("weight")), "weights", n * BANDS // 2)
        wide = wide.join(sums, "bucket")
        rows = rows.unionByName(wide.where(_fits("members", "weight")).select("bucket", *alone))
        large = scratch.save(wide.where(~_fits("members", "weight")), "large")
        found_in += [sums, large]
        if not large.isEmpty():
            inside = scratch.save(large.select("id").distinct(), "inside", n)
            stars = scratch.save(_compare(_star_rows(large, scratch), _full(docs, key, text, signed, classes, inside), k, threshold), "star-links")
            joined = components(scratch, stars, n * BANDS)
            parts = large.join(joined, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("part"))
            rows = rows.unionByName(_rest_rows(parts, scratch))
    links = _compare(rows, _full(docs, key, text, signed, classes, clusters.select("id")), k, threshold)
    found = components(scratch, links if stars is None else links.unionByName(stars), n * BANDS)
    scratch.drop(*found_in)

    named = classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    named = scratch.save(named, "named")
    out = signed.select(F.col("id"), "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def op10_near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract columns for ``documents``: 3-word shingles, similarity 0.85."""
    return near_duplicates(documents, k=3, threshold=0.85)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest key.

    Rows without words are no one's duplicates and all stay, as do rows that are linked with nothing.  Unlike texts under
    one key are documents of their own.  Rows that agree in key and words' text are one document and leave one row: the
    one whose columns as JSON come first.  Null keys come after all others; among rows of one key the text with the
    smallest SHA-256 comes first.  Keys may have any type with an order.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    several = docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1))
    if several.isEmpty():
        gone = scratch.save(near_duplicates(docs, key, text, k, threshold).where("not kept").select(key), "gone")
        return docs.join(_bounded(gone), key, "left_anti").select(*docs.columns)
    name = free_name("__row_name", *docs.columns)
    unnamed, plain = F.col(key).isNull(), F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.withColumn(name, F.concat_ws(":", unnamed.cast("string"), plain, F.coalesce(F.sha2(F.col(text), 256), F.lit("null"))))
    groups = scratch.save(near_duplicates(rows, name, text, k, threshold).where("n_shingles > 0"), "groups")
    named = groups.join(rows.select(name, unnamed.alias("last"), F.col(key).alias("k")), name).groupBy("component_id")
    first = scratch.save(named.agg(F.min(F.struct("last", "k", name)).alias("m")).select(f"m.{name}"), "first")
    gone = scratch.save(groups.select(name).distinct().join(first, name, "left_anti"), "gone")
    often = scratch.save(groups.groupBy(name).count().where("count > 1").select(name).join(first, name, "left_semi"), "often")
    left = rows.join(_bounded(gone), name, "left_anti")
    once = left.join(_bounded(often), name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("m"))
    return left.join(_bounded(often), name, "left_anti").select(*docs.columns).unionByName(once.select(*(F.col("m")[c].alias(c) for c in docs.columns)))


def _bounded(ids: DataFrame) -> DataFrame:
    """Ids to be broadcast if there are few enough of them, else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
