"""Brute-force versions."""

import random
import re

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed: int, words: int, syllables: str = "an er the ou st in th on") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(syllables.split(), k=r.randint(1, 3))) for _ in range(words))


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components_of(rows, k, percent):
    """Smallest id reachable over links of similarity, by comparing all pairs."""
    sets, parent = {}, {}
    for i, text in rows:
        sets.setdefault(i, shingles(text, k))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def contamination(text, items, n):
    """(words, hit places, item ids) of a text by looking for every window."""
    words = ITEM_WORD.findall(lower_ascii(text))
    windows = {}
    for item, body in items:
        own = ITEM_WORD.findall(lower_ascii(body))
        for i in range(max(1, len(own) - n + 1)) if own else []:
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(item))
    hit, found = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if ids := windows.get(tuple(words[i : i + size])):
                hit |= set(range(i, i + size))
                found |= ids
    return words, hit, found
