"""Hierarchical multi-length packing of tokenised documents.

Documents are tokenised and packed where they are read: every task works through its own
rows in windows of a bounded number of tokens, so nothing is shuffled and a lost task is
simply run again.  In a window

1. documents of the longest context or more give whole sequences of that length; what is
   left of them, and every shorter document, is routed to the smallest context that holds it;
2. tiers are packed from the longest down, one leading fragment a sequence;
3. gaps are filled from shorter tiers, the largest fragment that fits first, and the last
   gap by cutting a fragment;
4. what no tier can fill is laid end to end and carried to the next window; at a task's end
   it is cut at powers of two, so no sequence needs padding;
5. sequences are dealt to step groups of equal numbers of tokens, longest first.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._text import buffers, tidied

CONTEXTS = (512, 1024, 2048, 4096)
EOS = 2
#: Tokens that a task holds at once; the longest document comes on top.
WINDOW_TOKENS = 1 << 20
STEP_TOKENS = 1 << 18
#: Bytes of words and ids that a worker remembers; beyond, it forgets all but KEPT_WORDS.
CACHED_BYTES = 112 << 20
#: As much for a worker that many stages share, which keeps the first words, the commonest, from task to task.
SHARED_BYTES, KEPT_WORDS = 32 << 20, 40_000
#: What a remembered word costs besides its characters and ids.
_ENTRY_BYTES = 180
#: Longer words are not remembered.
LONGEST_CACHED = 64
#: Texts and characters that are encoded together, one text at least.
TEXTS, CHARACTERS = 64, 1 << 19
#: ASCII marks that the tokenizer keeps together after letters; an apostrophe may open a contraction, "<" a special token.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context int, step_group long"


def _size(words, ids) -> int:
    return sum(map(len, words)) + sum(map(len, ids)) + _ENTRY_BYTES * len(words)


def _letters(word: str) -> bool:
    """Whether the tokenizer sees letters throughout: lower-casing may turn a letter into a letter and a mark, and normal
    form C takes some letters apart."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordTokenizer:
    """Ids of whole texts, with each distinct white-space-separated word encoded once.

    The tokenizer never joins across spaces and line feeds, so a text's ids are its words' ids in turn.  Nor does it
    join letters and the marks behind them, so a word's ids are those of its letters and of its marks.
    Texts with its special tokens' opening are encoded word by word without lower-casing or stripping.
    """

    def __init__(self, path: str, cache_bytes: int = CACHED_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: the same merges for words of a-z alone, which need no normalising and no splitting but at spaces
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache_bytes, self.known = cache_bytes, {}
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """All but the first ``keep`` words of those remembered, which are the commonest: they were met first."""
        self.known: dict[str, bytes] = dict(islice(self.known.items(), keep))
        self.held = _size(self.known, self.known.values())

    def _learn_each(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = np.array(e.ids, dtype="<u4").tobytes()

    def _learn_together(self, tokenizer, words: list[str]) -> list[str]:
        """Learns words of letters, a hundred a call; returns those whose ends aren't clear."""
        unclear = []
        for i in range(0, len(words), 100):
            part = words[i : i + 100]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                unclear += part
                continue
            whole, a = ids.tobytes(), 0
            for word, z in zip(part, (4 * stops).tolist(), strict=True):
                self.known[word] = whole[a:z]
                a = z
        return unclear

    def _resolve(self, missing: list[str]) -> None:
        """Plain letters give one word each, whose last id is one of ``ends``: many share a call."""
        known = self.known
        letters = {w for w in missing if _letters(w)}
        marked, other = [], set()
        for word in missing:
            if word not in letters:
                stem = word.rstrip(_MARKS)
                if _letters(stem):
                    marked.append((word, stem, word[len(stem) :]))
                else:
                    other.add(word)
        letters.update(s for _, s, _ in marked if s not in known)
        other.update(t for _, _, t in marked if t not in known)
        plain = [w for w in letters if w.isascii() and w.islower()]
        other.update(self._learn_together(self.bare, plain))
        other.update(self._learn_together(self.tokenizer, list(letters.difference(plain))))
        if other:
            self._learn_each(list(other))
        for word, stem, tail in marked:
            known[word] = known[stem] + known[tail]
        self.held += _size(missing, map(known.__getitem__, missing))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.held > self.cache_bytes:
            self.forget(KEPT_WORDS)
        split = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") if t else [] for t in texts]
        known = self.known
        missing = [w for w in set().union(*split) if w not in known]
        if missing:
            self._resolve(missing)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in missing:
            if len(word) > LONGEST_CACHED:
                del known[word]
        return out


class _Pool:
    """Fragments (document, start) by length.  The lengths that occur are bits of one number, so the largest below a
    bound is found without a search among fragments."""

    def __init__(self):
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.lengths = self.tokens = 0

    def add(self, length: int, doc: int, start: int) -> None:
        self.of.setdefault(length, []).append((doc, start))
        self.lengths |= 1 << length
        self.tokens += length

    def largest(self, most: int) -> int:
        """The largest length up to ``most``; 0 if there is none."""
        return max((self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def smallest(self) -> int:
        return (self.lengths & -self.lengths).bit_length() - 1

    def take(self, length: int) -> tuple[int, int]:
        doc, start = self.of[length].pop()
        if not self.of[length]:
            self.lengths ^= 1 << length
        self.tokens -= length
        return doc, start

    def rest(self) -> list[tuple[int, int, int]]:
        return [(d, s, n) for n in sorted(self.of) for d, s in self.of[n]]


class _Pieces:
    """Sequences under way: each is a list of (document, start, length)."""

    def __init__(self, contexts: tuple[int, ...]):
        self.contexts = contexts

    def plan(self, fragments: list[tuple[int, int, int]], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
        """Sequences of exactly a context's length, and what is left over: fewer tokens than the
        longest context; none if last."""
        longest, done, pool = self.contexts[-1], [], _Pool()
        for doc, start, length in fragments:
            while length >= longest:
                done.append([(doc, start, longest)])
                start, length = start + longest, length - longest
            if length:
                pool.add(length, doc, start)
        open_ended: list[tuple[int, int, int]] = []
        for tier in range(len(self.contexts) - 1, -1, -1):
            size, below = self.contexts[tier], self.contexts[tier - 1] if tier else 0
            while (length := pool.largest(size)) > below:
                if tier == 0 and pool.tokens < size:
                    break
                sequence, gap = [(*pool.take(length), length)], size - length
                while gap and pool.lengths:
                    n = pool.largest(gap)
                    if not n:
                        n = pool.smallest()
                        d, s = pool.take(n)
                        sequence.append((d, s, gap))
                        pool.add(n - gap, d, s + gap)
                        gap = 0
                        break
                    if n > below and tier:
                        n = pool.largest(below)
                        if not n:
                            break
                    sequence.append((*pool.take(n), n))
                    gap -= n
                if gap:
                    open_ended += sequence
                else:
                    done.append(sequence)
        return self._end_to_end(open_ended + pool.rest(), done, last)

    def _end_to_end(self, rest, done, last):
        """Cut what is laid end to end into longest contexts; if last, the remainder at powers of two."""
        longest, total = self.contexts[-1], sum(n for _, _, n in rest)
        sizes = [longest] * (total // longest)
        if last:
            sizes += [1 << b for b in range(longest.bit_length() - 1, -1, -1) if total % longest >> b & 1]
        rest = rest[::-1]
        for size in sizes:
            sequence = []
            while size:
                d, s, n = rest.pop()
                take = min(n, size)
                sequence.append((d, s, take))
                size -= take
                if n > take:
                    rest.append((d, s + take, n - take))
            done.append(sequence)
        return done, rest[::-1]


def _step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence: longest first, each to the group with the fewest tokens."""
    heap = [(0, g) for g in range(max(1, -(-sum(lengths) // step_tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, group = heapq.heappop(heap)
        out[i] = group
        heapq.heappush(heap, (load + lengths[i], group))
    return out


def pack(
    df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", contexts: tuple[int, ...] = CONTEXTS, eos: int = EOS, window_tokens: int = WINDOW_TOKENS, step_tokens: int = STEP_TOKENS, cache_bytes: int = CACHED_BYTES
) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset, context, step_group) of all rows.

    ``ids`` are the piece's little-endian unsigned 32-bit ids.  ``contexts`` are rising powers of two, each twice
    or more the one before.  A document is its text's ids and then ``eos``; a null or empty text is ``eos`` alone.
    Each id lies in exactly one piece, each sequence is one context or, at a task's end, a smaller power of two
    long.  Repeated rows and equal or null keys are packed row by row; an empty table gives no pieces.  A
    sequence's id holds the task's number and a count, so ids are unique in one run.  Only the named columns are read.
    """
    kind = df.schema[key].dataType
    columns = {x.name: x for x in T._parse_datatype_string(PIECES)}
    schema = T.StructType([T.StructField(key, kind), *columns.values()])
    tail = bytes(np.array([eos], dtype="<u4"))

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, planner = _tokenizer(tokenizer_path, cache_bytes), _Pieces(contexts)
        base = TaskContext.get().partitionId() << 32
        made = groups = held = 0
        keys: dict[int, object] = {}
        ids: dict[int, bytes] = {}
        fragments: list[tuple[int, int, int]] = []
        row = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, groups, held, fragments
            done, fragments = planner.plan(fragments, last)
            lengths = [sum(n for _, _, n in s) for s in done]
            group = _step_groups(lengths, step_tokens)
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            for i, sequence in enumerate(done):
                offset = 0
                for d, s, n in sequence:
                    for name, value in zip(out, (keys[d], s, n, ids[d][4 * s : 4 * (s + n)], len(ids[d]) // 4, base + made, offset, lengths[i], base + groups + group[i]), strict=True):
                        out[name].append(value)
                    offset += n
                made += 1
            groups += max(group, default=-1) + 1
            held = sum(n for _, _, n in fragments)
            keep = {d for d, _, _ in fragments}
            for d in list(ids):
                if d not in keep:
                    del ids[d], keys[d]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=t) for f, t in zip(schema.fields, arrow, strict=True)], [f.name for f in schema.fields])

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            for part in _parts(batch):
                for value, encoded in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    keys[row], ids[row] = value, encoded + tail
                    n = len(ids[row]) // 4
                    fragments.append((row, 0, n))
                    held += n
                    row += 1
                    if held >= window_tokens:
                        yield from flush(False)
        if fragments:
            yield from flush(True)
        if cache_bytes <= SHARED_BYTES:
            words.forget(KEPT_WORDS)

    return df.select(F.col(key), F.col(text)).mapInArrow(work, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, TEXTS at most and CHARACTERS, or one longer text."""
    _, offsets = buffers(batch.column(1))
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(offsets, offsets[i] + CHARACTERS, side="right")) - 1
        j = min(batch.num_rows, i + TEXTS, max(i + 1, j))
        yield batch.slice(i, j - i)
        i = j


_loaded: dict[tuple[str, int], WordTokenizer] = {}


def _tokenizer(path: str, cache_bytes: int) -> WordTokenizer:
    """One for each worker."""
    if (path, cache_bytes) not in _loaded:
        _loaded[path, cache_bytes] = WordTokenizer(path, cache_bytes)
    return _loaded[path, cache_bytes]


def public_pieces(documents: DataFrame, cache_bytes: int = SHARED_BYTES) -> DataFrame:
    """Pieces of ``documents`` with their ids and the ids' checksum, by the public word-level BPE.  With ``SHARED_BYTES`` or less
    to remember words in, what a worker remembers beyond the commonest words ends with a task."""
    import public_tokenizers

    pieces = pack(documents, public_tokenizers.path("word_bpe_49k.json"), cache_bytes=cache_bytes)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


def op3_packing(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract columns for ``documents``, with the public word-level BPE."""
    return public_pieces(documents, CACHED_BYTES).drop("ids")
