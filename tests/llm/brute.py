"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import re
from collections import defaultdict

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text: str | None) -> str:
    return (text or "").translate(_UPPER)


def shingles(text: str | None) -> set:
    words = SPACES.findall(lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def jaccard_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """Size of the set and component of every document, by counting shared shingles of all pairs that share one."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window=10):
    """Words, hit words and item ids of every document."""
    patterns = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lower(text))
        n = min(len(words), window)
        for i in range(len(words) - n + 1 if n else 0):
            patterns[tuple(words[i:i + n])].add(str(item))
    sizes = {len(p) for p in patterns}
    out = {}
    for i, text in rows:
        words = ALNUM.findall(lower(text))
        hit, named = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                found = patterns.get(tuple(words[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    named |= found
        out[i] = (len(words), len(hit), sorted(named))
    return out


def repeats(rows, window=35):
    """Words and kept words of every row, rows counted one by one."""
    texts = [SPACES.findall(t or "") for _, t in rows]
    seen = defaultdict(int)
    for words in texts:
        for k in range(len(words) - window + 1):
            seen[tuple(words[k:k + window])] += 1
    out = []
    for (i, _), words in zip(rows, texts):
        gone = set()
        for k in range(len(words) - window + 1):
            if seen[tuple(words[k:k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(words), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return out
