"""Questions rewritten by what they find first, a second ranking, and the error of found times."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions.text import keywords
from chronoreel.operators.extras import BROADCAST_ROWS, bm25_terms
from chronoreel.session import kept

#: Documents that a question is rewritten from, terms that it gets, and the weight of the best of them; its own weigh 1.
HITS, TERMS, SHARE = 10, 10, 0.5
#: What of the final score is the share of the question's own terms that a document holds.
COVERAGE = 0.2
WITHIN_MS = 3000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def document_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words), written once, as every ranking needs all documents' keywords."""
    return kept(docs.select(key, keywords(F.col(text)).alias("words")), "words")


def own_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of questions (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(keywords(F.col("query")))).alias("term"))


def _best(rows: DataFrame, k: int, *order) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def rewrite(words: DataFrame, asked: DataFrame, key: str = "doc_id", hits: int = HITS, terms: int = TERMS, share: float = SHARE) -> DataFrame:
    """(query_id, term, weight, own): the question's own terms, weighing 1, and the ``terms`` best others of the ``hits``
    documents that these find first.

    A term's worth is its frequency in each such document, by the document's share of their scores, times its rarity
    in all documents; the best weighs ``share`` and the others in proportion.  Ties go to the smaller key and
    term.  A question that finds nothing keeps its terms.
    """
    first = bm25_terms(words, asked, key).select("query_id", key, F.round("score", 9).alias("score"))
    top = kept(_best(first, hits, F.col("score").desc(), key), "first-hits")
    total = top.groupBy("query_id").agg(F.sum("score").alias("total"))
    told = words.join(_few(top.join(total, "query_id")), key).select("query_id", key, (F.col("score") / F.col("total")).alias("s"), F.size("words").alias("length"), F.explode("words").alias("term"))
    told = kept(told.groupBy("query_id", key, "s", "length", "term").agg(F.count(F.lit(1)).alias("tf")), "told")
    candidates = told.select("term").distinct()
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).join(_few(candidates), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = words.agg(F.count(F.lit(1)).alias("n"))
    rare = df.crossJoin(F.broadcast(n)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    worth = told.join(rare, "term").groupBy("query_id", "term").agg(F.round(F.sum(F.col("s") * F.col("tf") / F.col("length") * F.col("idf")), 9).alias("worth"))
    others = _best(worth.join(asked, ["query_id", "term"], "left_anti"), terms, F.col("worth").desc(), "term")
    most = F.max("worth").over(Window.partitionBy("query_id"))
    added = others.select("query_id", "term", F.round(share * F.col("worth") / most, 9).alias("weight"), F.lit(False).alias("own"))
    return asked.select("query_id", "term", F.lit(1.0).alias("weight"), F.lit(True).alias("own")).unionByName(added)


def rerank(words: DataFrame, asked: DataFrame, k: int, key: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best documents for rewritten questions (``asked`` as from ``rewrite``): their score
    over the question's best one, and the share of the question's own terms that they hold."""
    asked = kept(asked, "asked")
    found = bm25_terms(words, asked, key).select("query_id", key, F.round("score", 9).alias("raw"), "n_terms")
    n = asked.where("own").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_own"))
    # a sum a question, so that only its best rows move, not all that it meets
    most = kept(found.groupBy("query_id").agg(F.max("raw").alias("most")).join(n, "query_id"), "most")
    score = (1 - coverage) * F.col("raw") / F.col("most") + coverage * F.col("n_terms") / F.col("n_own")
    return _best(found.join(_few(most), "query_id").select("query_id", key, F.round(score, 9).alias("score")), k, F.col("score").desc(), key)


def assignment(costs: list[list[int]]) -> list[int]:
    """For each row its column, one to one, with the least total; -1 for rows beyond the columns.  Shortest augmenting paths
    with potentials."""
    if not costs or not costs[0]:
        return [-1] * len(costs)
    if len(costs) > len(costs[0]):
        back = assignment([list(c) for c in zip(*costs, strict=True)])
        out = [-1] * len(costs)
        for column, row in enumerate(back):
            out[row] = column
        return out
    n, m = len(costs), len(costs[0])
    u, v, of = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], at = i, 0
        least: list = [None] * (m + 1)
        way, seen = [0] * (m + 1), [False] * (m + 1)
        while of[at]:
            seen[at] = True
            row, delta, to = of[at], None, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    slack = costs[row - 1][j - 1] - u[row] - v[j]
                    if least[j] is None or slack < least[j]:
                        least[j], way[j] = slack, at
                    if delta is None or least[j] < delta:
                        delta, to = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[of[j]] += delta
                    v[j] -= delta
                elif j and least[j] is not None:
                    least[j] -= delta
            at = to
        while at:
            of[at], at = of[way[at]], way[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if of[j]:
            out[of[j] - 1] = j - 1
    return out


def temporal_error(found: DataFrame, truth: DataFrame, within_ms: int = WITHIN_MS) -> DataFrame:
    """(query_id, n_found, n_true, n_matched, total_ms, n_within) of every question that has found or true intervals.

    Both have query_id, start_ms and end_ms.  Found intervals are assigned to true ones, one to one, as many as there can be,
    with the least sum of errors; an error is half of both ends' distances.  Of equal sums the one with more errors
    below ``within_ms`` counts.  A question's intervals are its few answers, so they fit a row; intervals without a
    start or an end don't count.
    """
    span = F.struct("start_ms", "end_ms")
    some = lambda df, name: df.where("start_ms is not null and end_ms is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(span)).alias(name))
    both = some(found, "found").join(some(truth, "truth"), "query_id", "full")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("query_id", "found", "truth")), strict=True):
                a, b = a or [], b or []
                twice = [[abs(x["start_ms"] - y["start_ms"]) + abs(x["end_ms"] - y["end_ms"]) for y in b] for x in a]
                scale = min(len(a), len(b)) + 1
                to = assignment([[c * scale + (c >= 2 * within_ms) for c in row] for row in twice])
                errors = [twice[i][j] for i, j in enumerate(to) if j >= 0]
                out.append((key, len(a), len(b), len(errors), sum(errors) / 2, sum(e < 2 * within_ms for e in errors)))
            kinds = [batch.schema.field("query_id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "n_found", "n_true", "n_matched", "total_ms", "n_within"])

    kind = both.schema["query_id"].dataType.simpleString()
    return both.select("query_id", "found", "truth").mapInArrow(work, f"query_id {kind}, n_found long, n_true long, n_matched long, total_ms double, n_within long")


def temporal_summary(errors: DataFrame) -> DataFrame:
    """(n_questions, recall, mean_ms, share_within): over all matched intervals; recall is of true ones."""
    matched = F.sum("n_matched")
    return errors.agg(F.count(F.lit(1)).alias("n_questions"), (matched / F.sum("n_true")).alias("recall"), (F.sum("total_ms") / matched).alias("mean_ms"), (F.sum("n_within") / matched).alias("share_within"))
