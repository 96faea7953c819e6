"""Pairing with benchmark items covers all items, and keeps rows without one."""

import oracle
from pyspark.sql import functions as F

from chronoreel.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_all_items_are_paired(spark, sf_dir, tmp_path):
    """200 items of one word each: document n holds the word of item n mod 200, item 7 is missing, one number is null."""
    for name in oracle.TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    for name in ("benchmark", "documents"):
        (tmp_path / f"{name}.parquet").unlink()
    word = F.concat(F.lit("word"), (F.col("id") % 200).cast("string"))
    items = spark.range(200).where("id <> 7").select(F.col("id").alias("item_id"), word.alias("text"))
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(500).select(F.col("id").alias("doc_id"), word.alias("text")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'word' AS text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.overlap for r in QUERIES["keyword_overlap_all"](spark, str(tmp_path)).collect()}
    assert got == {n: float(n % 200 != 7) for n in range(500)} | {None: 0.0}
    con = oracle.connect(str(tmp_path))
    for name in ("keyword_overlap_all", "av_gate_all"):
        assert oracle.compare(con, QUERIES[name](spark, str(tmp_path)), SQL[name]) == ""
