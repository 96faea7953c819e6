"""Fill-in-middle transformation over succinct rank and select.

A text's unit starts are one bitvector over its UTF-8 bytes, its code point starts another.  Both are packed,
eight bytes' bits in a byte, with a directory of the bits before each block.  The total of the first is the
number of units, select on two ranks gives the byte cuts, and rank of the second at a cut counts characters.
Everything happens where a row is read: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import free_name
from chronoreel.llm._text import buffers, chunks, tidied

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain at random, and of the others that begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20
#: Packed bytes of a block: 512 bits, whose number of ones fits 16 bits.
BLOCK = 64
#: Bytes of a text whose bits are made at once, a multiple of a block's.
SPAN = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: bytes that begin a code point
_BEGINS = np.ones(256, dtype=bool)
_BEGINS[0x80:0xC0] = False
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class Bits:
    """A packed bitvector with a directory of ones before each block."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        filled = np.zeros(-(-len(packed) // BLOCK) * BLOCK, dtype=np.uint8)
        filled[: len(packed)] = _ONES[packed]
        self.before = np.concatenate([[0], np.cumsum(filled.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))])
        self.total = int(self.before[-1])

    def rank(self, i: int) -> int:
        """Ones before place i."""
        byte, bit = divmod(i, 8)
        block = byte // BLOCK
        inside = int(_ONES[self.packed[block * BLOCK : byte]].sum())
        return int(self.before[block]) + inside + (bin(int(self.packed[byte]) >> (8 - bit)).count("1") if bit else 0)

    def select(self, k: int) -> int:
        """The place of the one with k ones before it, for k below the total."""
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        left = k - int(self.before[block])
        ones = np.cumsum(_ONES[self.packed[block * BLOCK : (block + 1) * BLOCK]])
        byte = int(np.searchsorted(ones, left, side="right"))
        left -= int(ones[byte - 1]) if byte else 0
        places = np.flatnonzero(np.unpackbits(self.packed[block * BLOCK + byte : block * BLOCK + byte + 1]))
        return 8 * (block * BLOCK + byte) + int(places[left])


def boundaries(data: np.ndarray) -> tuple[Bits, Bits]:
    """Starts of units (runs of A-Z and a-z, or one other character) and of code points.  Bits are made a span at a time,
    so besides the text a quarter of its size is held."""
    units, points = [], []
    for a in range(0, len(data), SPAN):
        part = data[a : a + SPAN]
        letter, begins = _LETTER[part], _BEGINS[part]
        follows = np.empty(len(part), dtype=bool)
        follows[0] = a > 0 and bool(_LETTER[data[a - 1]])
        follows[1:] = letter[:-1]
        units.append(np.packbits(begins & ~(letter & follows)))
        points.append(np.packbits(begins))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.uint8)
    return Bits(joined(units)), Bits(joined(points))


def cut(data: np.ndarray, draws: tuple[int, int]) -> tuple[int, int, int, int, int]:
    """(units, byte cuts, characters of prefix and of middle) of a text for two draws."""
    units, points = boundaries(data)
    n = units.total
    low, high = sorted(d % (n + 1) for d in draws)
    at = [units.select(k) if k < n else len(data) for k in (low, high)]
    ranks = [points.rank(x) if x < len(data) else points.total for x in at]
    return n, at[0], at[1], ranks[0], ranks[1] - ranks[0]


def draws(key: Column, seed: int = 1) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of the seed and the key; a null key is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


RESULTS = "n long, form string, prefix_chars long, middle_chars long, output string"


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Cuts depend on ``key`` and ``seed`` alone, so repeated rows get equal results, as do rows with a null key and one text.
    A null or empty text has no units and an empty plain output; a text that holds a sentinel stays plain whatever its
    draw.  A text is cut whole, however long; the row, its output and a quarter of it as bits are held.  Other columns
    pass through; those named like a result are replaced.  An empty table gives an empty one.
    """
    fields = T._parse_datatype_string(RESULTS).fields
    results = {f.name for f in fields}
    private = [free_name(f"draw_{i}", *docs.columns) for i in range(5)]
    own = {c: c for c in docs.columns if c.lower() not in results}
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*own, body.alias(private[4]), *(d.alias(n) for d, n in zip(draws(F.col(key), seed), private, strict=False)))
    schema = T.StructType([*(docs.schema[c] for c in own), *fields])
    marks = [s.encode() for s in sentinels]

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(own)
        for batch in batches:
            data, offsets = buffers(batch.column(width))
            h = [batch.column(width + 1 + i).to_pylist() for i in range(4)]
            for i, j in chunks(offsets, SPAN):
                out: list[tuple] = []
                for k in range(i, j):
                    part = data[offsets[k] : offsets[k + 1]]
                    n, a, z, before, between = cut(part, (h[0][k], h[1][k]))
                    raw = part.tobytes()
                    if not raw or h[2][k] % 100 >= 100 - plain or any(m in raw for m in marks):
                        out.append((n, "plain", None, None, raw))
                        continue
                    p, s, m = marks
                    if h[3][k] % 100 < suffix_first:
                        out.append((n, "spm", before, between, b"".join((s, raw[z:], p, raw[:a], m, raw[a:z]))))
                    else:
                        out.append((n, "psm", before, between, b"".join((p, raw[:a], s, raw[z:], m, raw[a:z]))))
                made = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                made.append(pa.array([r[4] for r in out], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:width]), *made], [*own, *(f.name for f in fields)])

    return rows.mapInArrow(work, schema)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text from which ``transform`` made an output.  A text that is cut holds no sentinel, and a sentinel begins with
    a character that it holds nowhere else, so each is found at its first occurrence."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        a = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(a) + len(second) + 1, F.length(body))
        b = F.substring_index(rest, m, 1)
        return a, b, F.substring(rest, F.length(b) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    late_suffix, late_prefix, late_middle = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)


def op13_infill(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract columns for ``documents``."""
    done = transform(documents.select("doc_id", "text"))
    output, form = F.col("output"), F.col("form")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restore(output, form), 256).alias("restored_sha256"))
