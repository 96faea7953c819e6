"""Merging, budgets, timelines, keyword ranking and evaluation around retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions.text import keywords
from chronoreel.session import kept

#: Asked terms that are broadcast; more are joined.
ASKED_TERMS = 200_000
#: Rows that may be broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 500_000
#: Matches of a term of a document with one of a query that a task adds up.
TASK_MATCHES = 4_000_000


def merge_adjacent(rows: DataFrame, by: list[str], gap_ms: int = 3000, *order: str) -> DataFrame:
    """(by, start_ms, end_ms, n) of runs of intervals no more than ``gap_ms`` apart."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms", *order)
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__reach", reach).withColumn("__new", (F.coalesce(F.col("start_ms") - F.col("__reach"), F.lit(gap_ms + 1)) > gap_ms).cast("int"))
    run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__run", run).groupBy(*by, "__run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("__run")


def within_budget(rows: DataFrame, by: str, cost: Column, budget: int, *order: Column) -> DataFrame:
    """The leading rows of each group whose costs add up to no more than ``budget``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def timeline(*sources: tuple[str, DataFrame]) -> DataFrame:
    """(video_id, start_ms, kind, seq, text): all sources of a video interleaved by time."""
    out = None
    for kind, rows in sources:
        part = rows.select("video_id", "start_ms", F.lit(kind).alias("kind"), "seq", "text")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("video_id", "start_ms", "kind", "seq")


def keyword_hits(docs: DataFrame, key: str, text: str, words: list[str], k: int) -> DataFrame:
    """(key, hits): the documents with most of the words, the fallback where no encoder runs."""
    wanted = F.array(*map(F.lit, sorted(set(words))))
    found = docs.select(key, F.size(F.array_intersect(F.array_distinct(keywords(F.col(text))), wanted)).alias("hits"))
    return found.where("hits > 0").orderBy(F.col("hits").desc(), key).limit(k)


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) of documents that share a keyword with a query (query_id, query).  Keys are unique.

    A document's keywords are found once.  Asked terms (broadcast up to ASKED_TERMS) are picked before anything is
    shuffled, so only their postings move, and one row a document that counts it and its length.  Scores of a document are
    added up where its postings meet.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(keywords(F.col("query")))).alias("term"))
    words = docs.select(key, keywords(F.col(text)).alias("words"))
    return bm25_terms(words, asked, key, k1, b).select("query_id", key, "score")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, score): the ``k`` best documents of each query, by scores of nine digits, then key.  Queries with one text are
    asked once."""
    known = queries.where("query is not null")
    first = known.groupBy("query").agg(F.min("query_id").alias("__first"))
    scored = bm25(docs, first.select(F.col("__first").alias("query_id"), "query"), key, text).withColumn("score", F.round("score", 9))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    hits = scored.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= k).select(F.col("query_id").alias("__first"), key, "score")
    return known.join(first, "query").select("query_id", "__first").join(hits, "__first").select("query_id", key, "score")


def bm25_terms(words: DataFrame, asked: DataFrame, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, n_terms) of documents (key, words: all their keywords) for asked terms (query_id, term and, if
    given, weight and own): n_terms of a query's terms (of its own ones) are in the document.

    Postings of asked terms are written once, with a row a document.  Then a document's postings meet in one task with the
    broadcast terms, so its scores are added up where they arise and don't move.
    """
    wanted = asked.select("term").distinct()
    words = words.withColumn("length", F.size("words"))
    if wanted.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS:
        marked = words.select(key, "length", F.explode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("term"))
        found = marked.join(F.broadcast(wanted.withColumn("__asked", F.lit(True))), "term", "left")
        listed = found.where(F.col("term").isNull() | F.col("__asked")).drop("__asked")
    else:
        found = words.select(key, "length", F.explode("words").alias("term")).join(wanted, "term", "left_semi")
        listed = found.unionByName(words.select(F.lit(None).cast("string").alias("term"), key, "length"))
    counted = kept(listed.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    total = counted.where("term is null").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("mean")).first()
    df = counted.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = kept(asked.join(df, "term"), "terms")
    size = terms.agg(F.count(F.lit(1)).alias("rows"), F.sum("df").alias("matches")).first()
    held = counted.where(F.col("term").isNotNull() & F.col(key).isNotNull())
    if size["rows"] <= BROADCAST_ROWS:
        held, terms = held.repartition(1 + (size["matches"] or 0) // TASK_MATCHES, key), F.broadcast(terms)
    n, mean = F.lit(total["n"] or 0), F.lit(total["mean"] or 1.0)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    share = F.col("weight") if "weight" in asked.columns else F.lit(1.0)
    own = F.count(F.when(F.col("own"), 1)) if "own" in asked.columns else F.count(F.lit(1))
    met = held.join(terms, "term").withColumn("w", weight).groupBy("query_id", key)
    return met.agg(F.sum(F.col("w") * share).alias("score"), own.alias("n_terms"))


def flushes(deltas: DataFrame, every_ms: int = 40) -> DataFrame:
    """(message_id, flush_ms, text, so_far): pieces of messages (message_id, seq, at_ms, delta) as they are shown: what came in
    each ``every_ms`` is appended at once, in the order of seq, and ``so_far`` is the message's length then."""
    due = (F.floor(F.col("at_ms") / every_ms) + 1) * every_ms
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"])
    shown = deltas.where(F.coalesce("delta", F.lit("")) != "").groupBy("message_id", due.alias("flush_ms")).agg(F.array_join(pieces, "").alias("text"))
    order = Window.partitionBy("message_id").orderBy("flush_ms").rowsBetween(Window.unboundedPreceding, 0)
    return shown.withColumn("so_far", F.sum(F.length("text")).over(order))


def recall_at_k(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's relevant chunks among its hits.  Both have query_id, chunk_id."""
    found = relevant.join(hits.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return found.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def half_of_video(question: Column, duration_ms: Column) -> tuple[Column, Column]:
    """The range a question's words for the first or second half mean; the whole video otherwise."""
    half = F.floor(duration_ms / 2)
    later, earlier = question.rlike("(后半|下半)"), question.rlike("(前半|上半)")
    return F.when(later, half).otherwise(F.lit(0)), F.when(earlier, half).otherwise(duration_ms)


def semantic_segments(segments: DataFrame, silence_ms: int = 800, least_ms: int = 15_000, most_ms: int = 30_000) -> DataFrame:
    """(video_id, start_ms, end_ms, n, text): speech merged to pieces of 15 to 30 s: cut at a silence or a full stop once
    a piece is long enough, and in any case before it grows too long.

    One task reads a video's segments, sorted by Spark and as Arrow batches; it holds a batch and the open piece.
    """
    schema = f"video_id {segments.schema['video_id'].dataType.simpleString()}, start_ms long, end_ms long, n int, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video = start = end = texts = None
        n, ended = 0, _ENDS_NOT

        def piece() -> tuple:
            return video, start, end, n, " ".join(texts) if texts else None

        def rows(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            kinds = (like.schema.field("video_id").type, pa.int64(), pa.int64(), pa.int32(), pa.string())
            columns = zip(*done, strict=True) if done else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["video_id", "start_ms", "end_ms", "n", "text"])

        for batch in batches:
            done = []
            for v, s, e, text in zip(*(batch.column(c).to_pylist() for c in ("video_id", "start_ms", "end_ms", "text")), strict=True):
                grows = False
                if n and v == video and None not in (start, end, e) and e - start <= most_ms:
                    stop = (ended[1] if texts else None, s is None or s - end >= silence_ms)
                    grows = end - start < least_ms or stop == (False, False)
                if grows:
                    end, n = max(end, e), n + 1
                    ended = _ends(text, ended)
                    if text is not None or not texts:
                        texts.append(text or "")
                    continue
                if n:
                    done.append(piece())
                video, start, end, n = v, s, e, 1
                texts, ended = [] if text is None else [text], _ends(text, _ENDS_NOT)
            yield rows(done, batch)
        if n:
            yield rows([piece()], batch)

    listed = segments.select("video_id", F.col("start_ms").cast("long").alias("start_ms"), "seg_idx", F.col("end_ms").cast("long").alias("end_ms"), "text")
    return listed.repartition("video_id").sortWithinPartitions("video_id", "start_ms", "seg_idx", "end_ms", "text").mapInArrow(work, schema)


#: White space of Java's \\s; line ends besides it that its $ may stand before; full stops.
_BLANK, _LINE_ENDS, _STOPS = " \t\n\x0b\f\r", "\x85\u2028\u2029", ".。!?！？"
_ENDS_NOT = (False, False)


def _ends(text: str | None, before: tuple[bool, bool]) -> tuple[bool, bool]:
    """Whether a piece that ended so ``before`` ends with a full stop and white space after ``text`` is added; and then
    perhaps one more line end (Java's ``[.。!?！？]\\s*$``)."""
    if text is None:
        return before
    bare, open_line = text.rstrip(_BLANK), (text[:-1] if text[-1:] and text[-1] in _LINE_ENDS else text).rstrip(_BLANK)
    return (bare[-1] in _STOPS if bare else before[0]), (open_line[-1] in _STOPS if open_line else before[0])


def assemble_calls(deltas: DataFrame) -> DataFrame:
    """(message_id, slot, id, name, arguments, finish): streamed tool calls put together.  Ids and names overwrite, argument
    pieces concatenate in order; the finish reason is the last one that is not empty.  ``deltas`` has seq."""
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq")))
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a"))))
    return deltas.groupBy("message_id", "slot").agg(
        last("id").alias("id"), last("name").alias("name"), F.array_join(F.transform(pieces, lambda p: p["a"]), "").alias("arguments"), last("finish").alias("finish")
    )


def limit_calls(calls: DataFrame, most: int = 3) -> DataFrame:
    """The first calls of each message."""
    w = Window.partitionBy("message_id").orderBy("slot")
    return calls.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
