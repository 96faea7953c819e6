"""Encoder input for whole tables of texts: vocabularies are tables, texts go through tasks as Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.functions import tokens as K

#: Entries of a vocabulary or merges that may be broadcast.
MOST_ENTRIES = 1_000_000
PAIR_LENGTH, PIECE_LENGTH = 77, 512
#: Characters of a text that go to a task as one row, if there is a space to cut behind.
MOST_CHARS = 512
#: Documents returned as one batch.
RETURNED = 256


def pair_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(token, id) and (left, right, rank) of a byte pair vocabulary file, special tokens included."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    ids = {**model["model"]["vocab"], **{t["content"]: t["id"] for t in model["added_tokens"]}}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
    tokens, (left, right) = sorted(ids, key=lambda t: ids[t]), zip(*pairs, strict=True) if pairs else ((), ())
    return _table(spark, token=tokens, id=[ids[t] for t in tokens]), _table(spark, left=left, right=right, rank=range(len(pairs)))


def piece_table(pairs: DataFrame) -> DataFrame:
    """(token, id) of a word piece vocabulary by rule: the four marks, then each byte pair token that is whole characters, as
    a word's beginning and, behind ##, as its continuation, in the order of ids."""
    byte = {c: b for b, c in enumerate(K.byte_letters())}
    found = dict.fromkeys((K.PAD, K.UNKNOWN, K.CLS, K.SEP))
    for r in _bounded(pairs, "id"):
        token = r["token"].removesuffix(K.WORD_END)
        if not token or any(c not in byte for c in token):
            continue
        try:
            text = bytes(byte[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        found |= dict.fromkeys((text, f"##{text}"))
    return _table(pairs.sparkSession, token=found, id=range(len(found)))


def _table(spark: SparkSession, **columns: Any) -> DataFrame:
    """Rows of the driver as Arrow columns, strings and ints: no task with a Python worker of its own makes them."""
    types = {k: pa.int32() if k in ("id", "rank") else pa.string() for k in columns}
    return spark.createDataFrame(pa.table({k: pa.array(list(v), types[k]) for k, v in columns.items()}))


def _bounded(table: DataFrame, order: str) -> list:
    rows = table.orderBy(order).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of more than {MOST_ENTRIES} entries")
    return rows


def text_pieces(text: Column, most: int) -> Column:
    """A text's pieces in order, nothing left out: at most ``most`` characters and the space or line end behind them, or,
    where neither comes so soon, all up to it.  No word goes over such a cut, and nothing composes with what stands before it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}(?:[ \n]|\z)|.[^ \n]*+[ \n]?"), F.lit(0))


def _encoded(docs: DataFrame, text: str, make: Callable[[Any], Any], parts: Any, size: int, first: int, last: int, pad: int, keep: Sequence[str] | None) -> DataFrame:
    results = T._parse_datatype_string("n_tokens long, ids array<int>, n_used int").fields
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in results}]
    width = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make(shared.value)
        # of documents not yet returned: kept columns; number of ids and the first ids, the last document's so far
        heads: list[list[pa.Array]] = []
        counts: list[int] = []
        found: list[list[int]] = []

        def made() -> pa.RecordBatch:
            rows = [K.framed(ids, size, first, last, pad) for ids in found]
            columns = [pa.concat_arrays(c) for c in zip(*heads, strict=True)]
            columns += [pa.array(counts, pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, [*names, *(f.name for f in results)])

        for batch in batches:
            for i in range(0, batch.num_rows, RETURNED):
                part = batch.slice(i, RETURNED)
                begun = []
                for j, (at, piece) in enumerate(zip(*(c.to_pylist() for c in part.columns[width:]), strict=True)):
                    if not at:
                        begun.append(j)
                        counts.append(0)
                        found.append([])
                    ids = encoder.encode(piece or "")
                    counts[-1] += len(ids)
                    found[-1] += ids[: max(0, size - 2 - len(found[-1]))]
                heads.append([c.take(pa.array(begun, pa.int32())) for c in part.columns[:width]])
                if len(counts) > RETURNED:
                    rows = made()
                    yield rows.slice(0, len(counts) - 1)
                    heads, counts, found = [[c.slice(len(counts) - 1) for c in rows.columns[:width]]], counts[-1:], found[-1:]
        if counts:
            yield made()

    # names by place, as a document's columns may have any; what is kept goes with a document's first piece only
    pieces = F.posexplode_outer(text_pieces(F.col(text), MOST_CHARS)).alias("at", "piece")
    rows = docs.select(*names, pieces).toDF(*(f"c{i}" for i in range(width + 2)))
    begins = F.coalesce(F.col(f"c{width}"), F.lit(0)) == 0
    rows = rows.select(*(F.when(begins, F.col(f"c{i}")) for i in range(width)), f"c{width}", f"c{width + 1}")
    return rows.mapInArrow(work, T.StructType([*(docs.schema[c] for c in names), *results]))


def byte_pair_input(docs: DataFrame, vocabulary: DataFrame, merges: DataFrame, text: str = "text", size: int = PAIR_LENGTH, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or only its columns ``keep``, with n_tokens (ids of the whole text), ids (``size``: a start mark, what fits, an end
    mark, zeros) and n_used (those that are no padding).  A null or empty text is the two marks.  Columns named like a result are
    replaced.  A text goes to its task piece by piece; whoever needs it no more leaves it out of ``keep``."""
    ids = {r["token"]: r["id"] for r in _bounded(vocabulary, "id")}
    pairs = [(r["left"], r["right"]) for r in _bounded(merges, "rank")]
    return _encoded(docs, text, lambda p: K.BytePairs(*p), (ids, pairs), size, ids[K.START], ids[K.END], 0, keep)


def word_piece_input(docs: DataFrame, vocabulary: DataFrame, text: str = "text", size: int = PIECE_LENGTH, keep: Sequence[str] | None = None) -> DataFrame:
    """As ``byte_pair_input``, by word pieces.  The mask of a row is 1 for its first n_used ids."""
    ids = {r["token"]: r["id"] for r in _bounded(vocabulary, "id")}
    return _encoded(docs, text, K.WordPieces, ids, size, ids[K.CLS], ids[K.SEP], ids[K.PAD], keep)


def attention_mask(ids, pad: int = 0):
    """1 for each id that is no padding, else 0."""
    return F.transform(ids, lambda x: (x != pad).cast("int"))
