"""Encoder input of all documents.  Merges and longest matches are outside SQL; tests hold them against other ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoreel.operators import encoders as E
from chronoreel.sources import fixtures as X


def _pairs(spark):
    import public_tokenizers

    return E.pair_tables(spark, public_tokenizers.path("word_bpe_49k.json"))


def encoder_byte_pairs(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return E.byte_pair_input(docs, *_pairs(spark), keep=["doc_id"]).select("doc_id", "n_tokens", "n_used", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def encoder_word_pieces(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = E.word_piece_input(docs, E.piece_table(_pairs(spark)[0]), keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", "n_used", F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.aggregate(E.attention_mask(F.col("ids")), F.lit(0), lambda s, x: s + x).alias("mask_sum"))


QUERIES = {"encoder_byte_pairs": (encoder_byte_pairs, None), "encoder_word_pieces": (encoder_word_pieces, None)}
