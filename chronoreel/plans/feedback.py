"""Rewritten questions, their second ranking, and the error of found times."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoreel.operators import feedback as B
from chronoreel.plans.scenes import keywords_sql
from chronoreel.sources import fixtures as X


def _asked(spark, sf_dir):
    return B.own_terms(X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def query_rewrite(spark, sf_dir):
    """Every benchmark item's terms and those it gets from the documents that it finds first."""
    words = B.document_words(X.table(spark, sf_dir, "documents"))
    return B.rewrite(words, _asked(spark, sf_dir))


def feedback_rank(spark, sf_dir):
    """The ten best documents of every rewritten item."""
    words, asked = B.document_words(X.table(spark, sf_dir, "documents")), _asked(spark, sf_dir)
    return B.rerank(words, B.rewrite(words, asked), 10).withColumn("score", F.round("score", 6))


_IDF = "ln(1 + (n.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE))"
_BM25 = f"{_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.length / n.mean))"
_REWRITE_SQL = f"""k AS MATERIALIZED (SELECT doc_id, {keywords_sql("text")} AS k FROM documents), l AS (SELECT doc_id, len(k) AS length FROM k),
t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(k) AS term FROM k) GROUP BY ALL), d AS MATERIALIZED (SELECT term, count(*) AS df FROM t GROUP BY 1),
n AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
q AS MATERIALIZED (SELECT item_id AS query_id, unnest(list_distinct({keywords_sql("text")})) AS term FROM benchmark),
f AS (SELECT q.query_id, t.doc_id, round(sum({_BM25}), 9) AS score FROM q JOIN t USING (term) JOIN d USING (term) JOIN l USING (doc_id), n GROUP BY ALL),
top AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {B.HITS}),
told AS (SELECT top.query_id, t.term, score, t.tf, l.length, t.doc_id FROM top JOIN t USING (doc_id) JOIN l USING (doc_id)),
total AS (SELECT query_id, sum(score) AS total FROM top GROUP BY 1),
worth AS (SELECT query_id, term, round(sum(score / total * tf / length * {_IDF}), 9) AS worth FROM told JOIN total USING (query_id) JOIN d USING (term), n GROUP BY ALL),
others AS (SELECT * FROM worth w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = w.query_id AND q.term = w.term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, term) <= {B.TERMS}),
asked AS MATERIALIZED (SELECT query_id, term, 1.0::DOUBLE AS weight, true AS own FROM q
  UNION ALL SELECT query_id, term, round({B.SHARE}::DOUBLE * worth / max(worth) OVER (PARTITION BY query_id), 9), false FROM others)"""
REWRITE_SQL = f"WITH {_REWRITE_SQL} SELECT query_id, term, weight, own FROM asked"
RANK_SQL = f"""WITH {_REWRITE_SQL},
s AS (SELECT a.query_id, t.doc_id, round(sum({_BM25} * a.weight), 9) AS raw, count(*) FILTER (own) AS n_terms FROM asked a JOIN t USING (term) JOIN d USING (term) JOIN l USING (doc_id), n GROUP BY ALL),
o AS (SELECT query_id, count(*) AS n_own FROM asked WHERE own GROUP BY 1),
r AS (SELECT query_id, doc_id, round({1 - B.COVERAGE}::DOUBLE * raw / max(raw) OVER (PARTITION BY query_id) + {B.COVERAGE}::DOUBLE * n_terms / n_own, 9) AS score FROM s JOIN o USING (query_id)),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM b WHERE rank <= 10"""


def temporal_errors(spark, sf_dir):
    """Every conversation's even turns as true times, found with errors of up to some seconds, some not at all."""
    s = X.segments(spark, sf_dir)
    n = F.col("seg_idx")
    key = F.col("video_id").alias("query_id")
    shift = F.pmod(F.xxhash64("video_id", "seg_idx"), F.lit(9000)) - 4500
    found = s.where(n % 3 < 2).select(key, (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))
    return B.temporal_error(found, s.where(n % 2 == 0).select(key, "start_ms", "end_ms"))


QUERIES = {"query_rewrite": (query_rewrite, REWRITE_SQL), "feedback_rank": (feedback_rank, RANK_SQL), "temporal_errors": (temporal_errors, None)}
