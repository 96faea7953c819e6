"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoreel.llm import codes, decontam, fingerprint, infill, langid, minhash, packing, quality, sharding, toxicity, urlfilter, vectors, warc
from chronoreel.llm._io import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, op: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(spark, read_table(spark, sf_dir, table))


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": _on("documents", langid.op1_language_id),
        "op2_sharding": _on("documents", sharding.op2_sharding),
        "op3_packing": _on("documents", packing.op3_packing),
        "op4_warc": _on("pages", warc.op4_warc),
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_url_filter": _on("pages", urlfilter.op6_url_filter),
        "op7_decontamination": decontam.op7_decontamination,
        "op8_fingerprint": _on("documents", fingerprint.op8_fingerprint),
        "op9_quality": quality.op9_quality,
        "op10_near_duplicates": _on("documents", minhash.op10_near_duplicates),
        "op11_embeddings": _on("embeddings", vectors.op11_embeddings),
        "op12_codes": _on("embeddings", codes.op12_codes),
        "op13_infill": _on("documents", infill.op13_infill),
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, max(page_id) AS first, count(*) AS n FROM p GROUP BY 1),
r AS (SELECT p.page_id, p.html, p.h, CASE WHEN f.n > 1 AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to FROM p JOIN f USING (html))
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) // (CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END)) % 32 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

_DECONTAM_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_NEAR_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
e AS (SELECT doc_id, unnest(s) AS s FROM l), n AS (SELECT doc_id, len(s) AS n FROM l),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN reach ON reach.id = n.doc_id GROUP BY n.doc_id, n.n"""

_INFILL_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:z], ''), '') AS mid, coalesce(array_to_string(w[z + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
_VECTORS_SQL = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.r AS a, a.vec_id AS i, b.r AS b, b.vec_id AS j FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1),
reach(r, root) AS (SELECT r, vec_id FROM v UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT r, min(root) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""


def _codes_sql(parts: int = 16, entries: int = 64) -> str:
    nearest = lambda books: (
        "SELECT p.r, p.p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.r, x.p, b.e, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i]))) AS d"
        f" FROM x JOIN {books} b ON b.p = x.p) p GROUP BY 1, 2"
    )
    mean = lambda books, assigned: (
        f"SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS x FROM"
        f" (SELECT a.p, a.e, i, CAST(floor(sum(x.x[i]) / count(*)) AS BIGINT) AS m FROM {assigned} a JOIN x ON x.r = a.r AND x.p = a.p, range(1, (SELECT max(len(x)) FROM x) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) m ON m.p = b.p AND m.e = b.e"
    )
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM x WHERE r <= {entries}), a0 AS MATERIALIZED ({nearest("b0")}),
b1 AS MATERIALIZED ({mean("b0", "a0")}), a1 AS MATERIALIZED ({nearest("b1")}),
b2 AS MATERIALIZED ({mean("b1", "a1")}), a2 AS MATERIALIZED ({nearest("b2")}),
c AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM k JOIN c USING (r) GROUP BY 1)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM k JOIN c USING (r) JOIN l ON l.label IS NOT DISTINCT FROM k.label"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables; the other queries rest on learned models, hashes or packing, and have tests instead."""
    return {"op4_warc": _WARC_SQL, "op7_decontamination": _DECONTAM_SQL, "op10_near_duplicates": _NEAR_SQL, "op11_embeddings": _VECTORS_SQL, "op12_codes": _codes_sql(), "op13_infill": _INFILL_SQL}
