"""Vector search, rank fusion and overlap removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.functions.questions import evidence_weight

RRF_K = 60
OVERLAP = 0.7
#: Queries of one block on average: what the driver holds and a pass over the chunks broadcasts.
QUERY_BLOCK = 2048
#: Scores that a task holds at once.
TILE = 1 << 20


def search_filter(chunks: DataFrame, collection=None, video_id=None, start_gte: int | None = None, end_lte: int | None = None, chunk_type=None, entity_ids: list | None = None) -> DataFrame:
    """Conjunction of constraints, below any scoring so that it reaches the scan.  Times are containment."""
    for name, value in (("collection", collection), ("video_id", video_id), ("chunk_type", chunk_type)):
        if value is not None:
            chunks = chunks.where(F.col(name) == F.lit(value))
    if start_gte is not None:
        chunks = chunks.where(F.col("start_ms") >= start_gte)
    if end_lte is not None:
        chunks = chunks.where(F.col("end_ms") <= end_lte)
    if entity_ids:
        chunks = chunks.where(F.arrays_overlap("entity_ids", F.array(*map(F.lit, entity_ids))))
    return chunks


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors of ``size`` entries (zero for zero vectors), and their places."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    at = np.flatnonzero(lengths == size)
    kept = column.take(pa.array(at))
    m = np.nan_to_num(kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(at), size) if size else np.zeros((0, 0))
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0), at


def vector_topk(
    chunks: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0, same_video: bool = False, vector: str = "embedding", key: str = "chunk_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(query_id, key, *carry, score, rank): for each query the ``k`` chunks with the highest cosine, at least ``min_score``.

    ``queries`` has query_id and query (and query_video where ``same_video``); ``chunks`` is already filtered.  The
    stated queries go in blocks of QUERY_BLOCK: each block's matrix is broadcast, each batch of chunks is one matrix
    product (one a video where ``same_video``), and only a batch's best ``k`` rows a query leave it.  Vectors of another
    length, empty or null are no hits; scores are rounded to six digits, ties go to the smaller key.  k <= 0 finds nothing.
    ``carry`` names columns of the chunks that come with their hits.
    """
    spark = chunks.sparkSession
    taken = [chunks.schema[c] for c in (key, *carry)]
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *(T.StructField(f.name, f.dataType) for f in taken), T.StructField("score", T.DoubleType())])
    wanted = ["query_id", "query", *(["query_video"] if same_video else [])]
    asked = queries.select(*wanted).where(F.size("query") > 0)
    out = spark.createDataFrame([], kinds)
    blocks = -(-asked.count() // QUERY_BLOCK) if k > 0 else 0
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if block.num_rows:
            out = out.unionByName(_block_topk(chunks, spark.sparkContext.broadcast(block), k, min_score, same_video, vector, [key, *carry], kinds))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _places(column: pa.ChunkedArray | pa.Array) -> dict:
    """The places of each value that is not null."""
    found: dict = {}
    for i, value in enumerate(column.to_pylist()):
        if value is not None:
            found.setdefault(value, []).append(i)
    return found


def _order(ids: pa.Array) -> np.ndarray:
    """The place of each key in their order."""
    keys = ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.array(ids.to_pylist(), dtype=object)
    out = np.empty(len(keys), np.int64)
    out[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    return out


def _best_pairs(q: np.ndarray, m: np.ndarray, order: np.ndarray, k: int, min_score: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, scores) of each query's ``k`` best chunks, for as many queries at once as TILE scores allow."""
    step = max(1, TILE // max(1, len(m)))
    for at in range(0, len(q) if len(m) else 0, step):
        scores = q[at : at + step] @ m.T
        np.round(scores, 6, out=scores)
        scores += 0.0
        least = np.full(len(scores), min_score)
        if len(m) > k:
            least = np.maximum(least, np.partition(scores, len(m) - k, axis=1)[:, len(m) - k])
        r, c = np.nonzero(scores >= least[:, None])
        by = np.lexsort((order[c], -scores[r, c], r))
        r, c = r[by], c[by]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[first], c[first]
        yield r + at, c, scores[r, c]


def _block_topk(chunks, block, k, min_score, same_video, vector, names, kinds) -> DataFrame:
    def best(queries: pa.Table, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = queries.column("query_id").combine_chunks()
        for size in np.unique(np.asarray(queries.column("query").combine_chunks().value_lengths())).tolist():
            q, of = _matrix(queries.column("query"), size)
            m, at = _matrix(batch.column(len(names)), size)
            order = _order(batch.column(0).take(pa.array(at)))
            parts = list(_best_pairs(q, m, order, k, min_score))
            if parts:
                r, c, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
                hits = [batch.column(i).take(pa.array(at[c])) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(of[r])), *hits, pa.array(scores)], ["query_id", *names, "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        if not same_video:
            for batch in batches:
                yield from best(queries, batch)
            return
        asked = {v: queries.take(pa.array(at)) for v, at in _places(queries.column("query_video")).items()}
        for batch in batches:
            for video, at in _places(batch.column(len(names) + 1)).items():
                if video in asked:
                    yield from best(asked[video], batch.take(pa.array(at)))

    of_video = [F.col("video_id").alias("__video")] if same_video else []
    return chunks.select(*names, vector, *of_video).mapInArrow(work, kinds)


def vector_of(collection: Column, frame: Column, text: Column) -> Column:
    """The vector that a chunk is found by: its picture's in the collection of frames (0), its text's in all others."""
    return F.when(collection == 0, frame).otherwise(text)


def lookup(chunks: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("collection", "chunk_id"), **default) -> DataFrame:
    """A row for each of ``wanted`` (with ``keys``): the chunk of that key, or the defaults given and nulls where there is none.
    ``found`` tells which."""
    held = chunks.withColumn("found", F.lit(True))
    met = wanted.join(held, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))
    for name, value in default.items():
        met = met.withColumn(name, F.when(F.col("found"), F.col(name)).otherwise(F.lit(value)))
    return met


def rrf(ranked: DataFrame, *by: str) -> DataFrame:
    """(*by, score): the sum over paths of weight / (60 + rank), rank from 1.  ``ranked`` has weight and rank."""
    return ranked.groupBy(*by).agg(F.round(F.sum(F.col("weight").cast("double") / (RRF_K + F.col("rank"))), 9).alias("score"))


def hit_path(ranked: DataFrame, *by: str) -> DataFrame:
    """(*by, hit_path): paths in name order; the last whose raw score exceeds the first path's, else the first."""
    listed = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("path", "score"))).alias("hits"))
    hits = F.col("hits")
    folded = F.aggregate(hits, hits[0]["path"], lambda path, x: F.when(x["score"] > hits[0]["score"], x["path"]).otherwise(path))
    return listed.select(*by, folded.alias("hit_path"))


def overlap_ratio(a, b) -> Column:
    """Overlap over the shorter duration; 0 if a duration is not positive."""
    shared = F.greatest(F.lit(0), F.least(a["end_ms"], b["end_ms"]) - F.greatest(a["start_ms"], b["start_ms"]))
    shorter = F.least(a["end_ms"] - a["start_ms"], b["end_ms"] - b["start_ms"])
    return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))


def remove_overlaps(candidates: DataFrame, by: str = "query_id", key: str = "chunk_id", ratio: float = OVERLAP, k: int | None = None) -> DataFrame:
    """(by, key, chunk_type, score, rank): greedily by falling score, without rows that overlap a kept one of their type
    by more than ``ratio``.  ``candidates`` are a query's fused hits, at most four times k and five, so a fold over an
    array holds them."""
    item = F.struct((-F.col("score")).alias("order"), F.col(key).alias("key"), "start_ms", "end_ms", "chunk_type")
    listed = candidates.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("hits"))
    hits = F.col("hits")

    def keep(kept: Column, x: Column) -> Column:
        again = F.exists(kept, lambda y: (y["chunk_type"] == x["chunk_type"]) & (overlap_ratio(x, y) > ratio))
        return F.when(again, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.slice(hits, F.lit(2), F.size(hits)), F.slice(hits, 1, 1), keep)
    if k is not None:
        kept = F.slice(kept, 1, k)
    rows = listed.select(by, F.posexplode(kept).alias("rank", "hit"))
    return rows.select(by, F.col("hit.key").alias(key), F.col("hit.chunk_type").alias("chunk_type"), (-F.col("hit.order")).alias("score"), (F.col("rank") + 1).alias("rank"))


def prefer_evidence(hits: DataFrame, by: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Hits with scores times their type's weight, ranked anew.  ``hits`` has chunk_type (name) and the preferences."""
    weight = evidence_weight(F.col("chunk_type"), F.col("prefers_visual"), F.col("prefers_audio"), F.col("prefers_fused"))
    scored = hits.withColumn("score", F.round(F.col("score") * weight, 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), key)))


#: Weight of the path that ranks by words.
SPARSE_WEIGHT = 0.3


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 5, entity_k: int = 5, start_gte: int | None = None, end_lte: int | None = None, sparse: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, chunk_type, score, rank): text, visual and entity paths, weighted fusion, overlap removal.

    ``questions`` has query_id, query and the columns of an intent; collections are numbered as in COLLECTIONS and
    ``chunk_type`` is a name.  Text and visual paths take 2k hits, the entity path ``entity_k`` without time limits.
    ``sparse`` is a fourth path: (query_id, chunk_id, score) ranked by words, of which 2k count.  A question without a vector, as
    where no encoder runs, finds nothing on the paths that need one.
    """
    inside = search_filter(chunks, start_gte=start_gte, end_lte=end_lte)
    about = ("chunk_type", "start_ms", "end_ms")
    paths = []
    for path, number, source, limit, when in (("text", 1, inside, 2 * k, "needs_text"), ("visual", 0, inside, 2 * k, "needs_visual"), ("entity", 2, chunks, entity_k, "has_entity")):
        asked = questions.where(F.col(when))
        hits = vector_topk(search_filter(source, collection=number), asked, limit, carry=about)
        hits = hits.join(asked.select("query_id", F.col(f"w_{path}").alias("weight"), "prefers_visual", "prefers_audio", "prefers_fused"), "query_id")
        if path == "text":
            hits = prefer_evidence(hits)
        paths.append(hits.select("query_id", "chunk_id", *about, "weight", "rank", F.lit(path).alias("path"), "score"))
    if sparse is not None:
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        ranked = sparse.join(questions.select("query_id"), "query_id", "left_semi").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 2 * k)
        hits = ranked.join(inside.select("chunk_id", *about), "chunk_id")
        paths.append(hits.select("query_id", "chunk_id", *about, F.lit(SPARSE_WEIGHT).alias("weight"), "rank", F.lit("sparse").alias("path"), "score"))
    every = paths[0]
    for path in paths[1:]:
        every = every.unionByName(path)
    fused = rrf(every, "query_id", "chunk_id", *about)
    return remove_overlaps(fused, k=k)
