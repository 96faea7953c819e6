"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the words of a block of items; training words stream through
it and the longest match ending at each word is tracked.  Wherever ``window`` words (or a
whole shorter item) match, those words are hit.  Items are dealt to blocks of a bounded
number of words; every block is scanned in a pass of its own, so what is broadcast never
grows beyond BLOCK_WORDS however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import Scratch, free_name, read_table
from chronoreel.llm._text import NOT_ALNUM, Words, buffers, chunks, tidied

WINDOW = 10
#: Item words in one automaton: about 100 MB of states on the driver and in a worker.
BLOCK_WORDS = 200_000
#: A document that keeps less than this share of its words is dropped whole.
MAX_COVERAGE = 0.5

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest_match", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("byte_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.size[last] + 1 == self.size[q] else self._split(last, c, q)
                continue
            new, p = self._state(self.size[last] + 1, {}, 0), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[new] = q if self.size[p] + 1 == self.size[q] else self._split(p, c, q)
            last = new

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = length = 0
        moves, link, size = self.next, self.link, self.size
        for c in words:
            to = moves[state].get(c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = moves[state].get(c)
            if to is None:
                yield 0, 0
            else:
                state, length = to, length + 1
                yield state, length


class ItemIndex:
    """The automaton of a block of items, and which items' windows each state stands for.  Words are numbered by their
    bytes; their hashes only rule out words that no item has."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.hashes = np.unique(word_hashes(list(self.number)))
        numbered = [(name, [self.number[w] for w in words]) for name, words in items if words]
        self.shortest = min([window, *(len(w) for _, w in numbered)], default=window)
        self.automaton = auto = SuffixAutomaton()
        for _, words in numbered:
            auto.add(words)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, words in numbered:
            states = list(auto.walk(words))
            if len(words) < window:
                self.short.setdefault(self._exact(states[-1][0], len(words)), []).append((len(words), name))
            for state, length in states:
                if length >= window:
                    self.items.setdefault(self._exact(state, window), set()).add(name)
        #: the nearest suffix state that is a whole short item, -1 if none
        self.shorter = [-1] * len(auto.size)
        for state in sorted(range(1, len(auto.size)), key=auto.size.__getitem__):
            up = auto.link[state]
            self.shorter[state] = up if up in self.short else self.shorter[up]

    def _exact(self, state: int, size: int) -> int:
        """The state of the match's last ``size`` words."""
        link, sizes = self.automaton.link, self.automaton.size
        while sizes[link[state]] >= size:
            state = link[state]
        return state

    def scan(self, words: Words, first: int, end: int) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word spans (merged, half open), items and the longest match in words ``first`` to ``end``, a document."""
        found: set[str] = set()
        spans: list[tuple[int, int]] = []
        longest = 0
        if end - first < self.shortest or not len(self.hashes):
            return spans, found, longest
        hashes = words.hash[first:end]
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        edges = np.flatnonzero(np.diff(self.hashes[at] == hashes, prepend=False, append=False))
        runs = [(a, z) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if z - a >= self.shortest]
        for a, z in runs:
            numbers = [self.number.get(w, -1) for w in words.bytes_of(first + a, first + z)]
            for i, (state, length) in enumerate(self.automaton.walk(numbers), a + 1):
                longest = max(longest, length)
                reach = 0
                if length >= self.window:
                    found |= self.items[self._exact(state, self.window)]
                    reach = self.window
                if self.short and length:
                    up = state if state in self.short else self.shorter[state]
                    while up != -1:
                        for size, name in self.short[up]:
                            if size <= length:
                                found.add(name)
                                reach = max(reach, size)
                        up = self.shorter[up]
                if reach:
                    start = i - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found, longest


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that ``Words`` gives to these words."""
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    return Words(data, np.array([0, len(data)]), NOT_ALNUM).hash


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """Items as (key as string, lower-cased words)."""

    @tidied
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            parts = (Words(data, offsets[i : i + 2], NOT_ALNUM) for i in range(batch.num_rows))
            words = [w.bytes_of(0, len(w.start)) for w in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, type=pa.list_(pa.binary()))], ["item", "words"])

    return items.select(F.col(key).cast("string").alias("item"), F.col(text)).mapInArrow(split, "item string, words array<binary>")


def item_blocks(spark: SparkSession, items: DataFrame, key: str, text: str, window: int, block_words: int) -> Iterator[ItemIndex]:
    """Automata of all items, each of about ``block_words`` words or of one longer item.  Repeated rows are one; rows of
    one id with unlike texts are dealt by both."""
    words = Scratch(spark, "benchmark").save(item_words(items, key, text).where("item is not null and size(words) > 0").distinct(), "words")
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for b in range(blocks):
        part = words.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()
        yield ItemIndex([(r.item, [bytes(w) for w in r.words]) for r in part], window)


def scan(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, found: str = "found"
) -> DataFrame:
    """``docs`` with a struct column ``found``: n_words, n_hit, longest_match, items (sorted ids as strings of items
    with an occurring window), spans (merged half-open word ranges) and byte_spans of the hit words.

    Words are runs of 0-9, A-Z lower-cased, a-z and non-ASCII characters.  A window is ``window`` words of an item in
    a row, or all words of a shorter item; items without words, or with a null id, never occur.  Null texts have no
    words.  All other columns pass through untouched; one named like ``found`` is replaced.  No items or documents is no
    error.
    """
    spark = docs.sparkSession
    docs = docs.drop(found) if found != text else docs
    names = docs.columns
    scratch = Scratch(spark, "decontam")
    out = docs
    blocks = item_blocks(spark, items, item_key, item_text, window, block_words)
    for i, index in enumerate(blocks):
        if i:
            out = scratch.save(out, f"block-{i}")
        out = _pass(out, spark.sparkContext.broadcast(index), text, names, found)
    return out


def _pass(df: DataFrame, index, text: str, names: list[str], found: str) -> DataFrame:
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(found, FOUND)])

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(names.index(text)))
            before = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * batch.num_rows
            rows = []
            for i, j in chunks(offsets):
                words = Words(data, offsets[i : j + 1], NOT_ALNUM)
                for k in range(i, j):
                    a, z = words.first[k - i], words.first[k - i + 1]
                    spans, items, longest = index.value.scan(words, int(a), int(z))
                    if old := before[k]:
                        spans = _merge(spans + [tuple(x) for x in old["spans"]])
                        items, longest = items | set(old["items"]), max(longest, old["longest_match"])
                    origin = int(offsets[k] - offsets[i])
                    at = [(int(words.start[a + s]) - origin, int(words.start[a + e - 1] + words.length[a + e - 1]) - origin) for s, e in spans]
                    rows.append({"n_words": int(z - a), "n_hit": sum(e - s for s, e in spans), "longest_match": longest, "items": sorted(items), "spans": spans, "byte_spans": at})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rows, type=ARROW_FOUND)], [*names, found])

    return df.mapInArrow(work, schema)


ARROW_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("longest_match", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.list_(pa.int64()))),
        ("byte_spans", pa.list_(pa.list_(pa.int64()))),
    ]
)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """``docs`` without the hit spans; documents with over ``max_coverage`` of their words hit are dropped whole.
    Columns stay as they are, with ``n_chars``, where there is one, counted anew for changed texts."""
    name = free_name("__found", *docs.columns)
    hit = scan(docs, items, text=text, found=name, **options)
    hit = hit.where(F.col(f"{name}.n_hit") <= F.col(f"{name}.n_words") * F.lit(max_coverage))
    spans = F.col(f"{name}.byte_spans")
    raw = F.encode(F.col(text), "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x[1]))
    ends = F.concat(F.transform(spans, lambda x: x[0]), F.array(F.octet_length(text).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.decode(F.substring(raw, x["s"].cast("int") + 1, (x["e"] - x["s"]).cast("int")), "UTF-8"))
    changed = F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col(text))
    out = hit.withColumn(text, changed)
    if "n_chars" in docs.columns and dict(docs.dtypes)["n_chars"] in ("bigint", "int"):
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for ``documents`` against ``benchmark``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("found")
    return scan(docs, read_table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"),
    )
