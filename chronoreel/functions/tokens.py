"""Encoder input: byte pairs merged by rank, and word pieces by longest match.  Helpers of one text; Spark deals the rows."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterable

import regex

#: Words and their ids that one encoder remembers.
REMEMBERED = 100_000
#: Longer words are not remembered, so that what is remembered is mostly small.
LONGEST = 32

# What byte pairs are formed within, and the ranges of ideographs that stand alone.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
START, END, UNKNOWN, PAD, CLS, SEP = "<|startoftext|>", "<|endoftext|>", "[UNK]", "[PAD]", "[CLS]", "[SEP]"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """A visible character for each byte: itself if it is one in Latin-1, else the next free one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = (chr(256 + i) for i in range(256))
    return [chr(b) if b in seen else next(other) for b in range(256)]


def lowered(text: str) -> str:
    """Each character's own lower case, whatever stands around it."""
    return text.lower() if text.isascii() else text.replace("Σ", "σ").lower()


class _Remembering:
    """Ids by word, with a bounded memory: when it is full, all is forgotten."""

    def __init__(self):
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self._ids(word)
            if len(word) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def _ids(self, word: str) -> list[int]:
        raise NotImplementedError


class BytePairs(_Remembering):
    """Byte pair encoding of words: symbols are a linked list, candidates a heap by rank, then place.  Which characters are
    letters or digits is told by the regex module's tables; those not assigned there are neither."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        super().__init__()
        self.vocabulary = vocabulary
        letters = byte_letters()
        self.inner = [vocabulary.get(c, -1) for c in letters]
        self.final = [vocabulary.get(c + WORD_END, -1) for c in letters]
        #: (left, right) as one number to (rank, merged)
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b, both = (vocabulary.get(x) for x in (left, right, left + right))
            if None not in (a, b, both):
                self.ranks.setdefault(a << 32 | b, (rank, both))
        self.special = {s: vocabulary[s] for s in (START, END) if s in vocabulary}
        self._split = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self._word = regex.compile(WORD)

    def _ids(self, word: str) -> list[int]:
        raw = word.encode()
        symbols = [*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(*r, i) for i in range(n - 1) if (r := ranks.get(symbols[i] << 32 | symbols[i + 1]))]
        heap = [(rank, i, both, symbols[i], symbols[i + 1]) for rank, both, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, both, left, right = heapq.heappop(heap)
            j = after[i]
            # a candidate is stale once one of its symbols has been merged
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = both, -2
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(symbols[a] << 32 | symbols[b])):
                    heapq.heappush(heap, (r[0], a, r[1], symbols[a], symbols[b]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; the spelled-out start and end marks are the marks themselves."""
        out: list[int] = []
        at = 0
        for mark in self._split.finditer(text):
            out += self._plain(text[at : mark.start()])
            out.append(self.special[mark[0]])
            at = mark.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self._word.findall(lowered(text if text.isascii() else unicodedata.normalize("NFC", text))):
            out += self.word(word)
        return out


class WordPieces(_Remembering):
    """Words in lower case, each ideograph and mark alone, taken apart by longest match; a byte that nothing matches is
    unknown, and what follows goes on inside the word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary))
        alone = "".join(f"{chr(a)}-{chr(z)}" for a, z in IDEOGRAPHS)
        marks = r"!-/:-@\[-`{-~\p{P}"
        space = r"\t-\r \x85\p{Z}"
        self._word = regex.compile(rf"[{alone}]|[{marks}]|[^{space}{alone}{marks}]+")

    def words(self, text: str) -> list[str]:
        text = text.replace("\0", "").replace("�", "")
        # the one letter whose lower case has two characters counts as its first
        return [w if w.isascii() and w.islower() else lowered(w.replace("İ", "i")) for w in self._word.findall(text)]

    def _ids(self, word: str) -> list[int]:
        out, at, mark, find = [], 0, "", self.vocabulary.get
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                if (value := find(mark + word[at:end])) is not None:
                    out.append(value)
                    at = end
                    break
            else:
                out += [self.vocabulary[UNKNOWN]] * len(word[at].encode())
                at += 1
            mark = "##"
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words(text):
            out += self.word(word)
        return out


def framed(ids: list[int], size: int, first: int, last: int, pad: int) -> tuple[list[int], int]:
    """``size`` ids: a mark, as many ids as fit, a mark, padding; and how many are no padding."""
    kept = ids[: size - 2]
    return [first, *kept, last, *[pad] * (size - 2 - len(kept))], len(kept) + 2
