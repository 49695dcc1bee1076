"""Plain counterparts of the operators for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w for w in BLANK.split(text or "") if w]


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def jaccard_components(rows: list[tuple], percent: int = 80) -> list[tuple]:
    """(key, set size, smallest key of the component) for (key, text) rows, comparing all pairs that share a shingle."""
    sets = [shingles(text) for _, text in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for token in s:
            where[token].append(i)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    shared = defaultdict(int)
    for group in where.values():
        for n, i in enumerate(group):
            for j in group[:n]:
                shared[j, i] += 1
    for (j, i), common in shared.items():
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[top(i)] = top(j)
    lowest: dict = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lowest[top(i)] = min(key, lowest.get(top(i), key))
    return [(key, len(sets[i]), lowest.get(top(i))) for i, (key, _) in enumerate(rows)]


def edits_within(item: list[str], text: list[str]) -> int:
    """Fewest word edits between the item and any stretch of the text."""
    cost = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        new = [i]
        for j, other in enumerate(text, 1):
            new.append(min(cost[j - 1] + (word != other), cost[j] + 1, new[j - 1] + 1))
        cost = new
    return min(cost)


def leaks(docs: list[tuple], items: list[tuple], rate: float) -> dict[tuple, int]:
    out = {}
    for doc, text in docs:
        for item, passage in items:
            words_of = passage.split()
            edits = edits_within(words_of, text.split())
            if edits <= int(rate * len(words_of) + 1e-9):
                out[doc, item] = edits
    return out


def repeated_words(w: list[str], width: int = 5) -> int:
    where = defaultdict(list)
    for i in range(len(w) - width + 1):
        where[tuple(w[i:i + width])].append(i)
    return len({i + k for group in where.values() if len(group) > 1 for i in group for k in range(width)})
