"""Plain versions of the operators, as slow as they are simple."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def gram_set(text: str, n: int = 2) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def similar_pairs(rows: list[tuple[int, str]], t: float) -> dict[tuple[int, int], float]:
    sets = [(d, gram_set(x)) for d, x in {(d, x) for d, x in rows if d is not None and x is not None}]
    out: dict[tuple[int, int], float] = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and x and y and (j := len(x & y) / len(x | y)) >= t - 1e-12:
                key = (min(a, b), max(a, b))
                out[key] = max(out.get(key, 0), round(j, 6))
    return out


def groups(pairs) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root)}


def not_least(rows: list[tuple[int, str]], t: float) -> set[int]:
    """Identifiers that aren't the least of a group of texts that similar pairs connect."""
    texts = sorted({(d, x) for d, x in rows if d is not None and words(x)})
    sets = [gram_set(x) for _, x in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t - 1e-12]
    return {texts[k][0] for k, root in groups(pairs).items() if texts[k][0] != texts[root][0]}


def repeats(text: str | None, least: int = 6) -> tuple[float, int]:
    """(covered fraction of the words' bytes, longest repeat in words)."""
    w = words(text)
    covered, longest = [False] * len(w), 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                for s in (i, j):
                    covered[s : s + k] = [True] * k
    size = [len(x.encode()) for x in w]
    return (sum(s for s, c in zip(size, covered) if c) / sum(size) if w else 0.0), longest


def maximal_repeats(text: str | None, least: int = 6) -> int:
    """Distinct word sequences of ``least`` words or more that occur twice and could be made longer on neither side without losing an occurrence."""
    w = words(text)
    found: dict[tuple, list[int]] = {}
    for i in range(len(w)):
        for j in range(i + least, len(w) + 1):
            found.setdefault(tuple(w[i:j]), []).append(i)
    many = 0
    for x, at in found.items():
        before = {w[i - 1] if i else None for i in at}
        after = {w[i + len(x)] if i + len(x) < len(w) else None for i in at}
        many += len(at) > 1 and (len(before) > 1 or None in before) and (len(after) > 1 or None in after)
    return many


def license_blocks(text: str | None, templates: dict[str, str], t: float, most: int) -> list[tuple[int, int, str, float]]:
    """(line, lines, template, containment) of all blocks of at most ``most`` lines that match, and hold no shorter one that does."""
    lines = [] if text is None else [set(words(x)) for x in text.lower().split("\n")]
    out = []
    for name, template in templates.items():
        own = set(words(template))
        need = -(-round(t * len(own) * 1000) // 1000)
        hit = {(i, n): len(own & set().union(*lines[i : i + n])) for i in range(len(lines)) for n in range(1, min(most, len(lines) - i) + 1)}
        for (i, n), common in hit.items():
            if own and common >= need and all(hit.get(x, 0) < need for x in ((i, n - 1), (i + 1, n - 1))):
                out.append((i, n, name, round(common / len(own), 6)))
    return out


def links(rows: list[tuple[int, str]], t: float) -> dict[tuple[int, int], int]:
    """(doc_id, class): number of similar or equal texts of other documents."""
    entries = sorted({(d, gram_set(x)) for d, x in rows if d is not None and words(x)}, key=lambda e: (e[0], sorted(e[1])))
    pairs = [(i, j) for i in range(len(entries)) for j in range(i + 1, len(entries)) if len(entries[i][1] & entries[j][1]) / len(entries[i][1] | entries[j][1]) >= t - 1e-12]
    root = groups(pairs)
    least: dict[int, int] = {}
    for k, (d, _) in enumerate(entries):
        least[root.get(k, k)] = min(least.get(root.get(k, k), d), d)
    out: dict[tuple[int, int], int] = {}
    for i, j in pairs:
        for x, y in ((i, j), (j, i)):
            if entries[x][0] != entries[y][0]:
                key = (entries[x][0], least[root[x]])
                out[key] = out.get(key, 0) + 1
    return out


def merged(v: dict[tuple[int, int], int], symbols: list[int]) -> list[int]:
    """One word's byte-pair merges, the pair of lowest rank first, from the left."""
    while True:
        found = [(v[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in v]
        if not found:
            return symbols
        low, i = min(found)
        symbols = symbols[:i] + [low] + symbols[i + 2 :]


def best_split(costs: dict[bytes, int], word: bytes) -> tuple[int, int]:
    best = [(0, 0)] + [(10**15, 0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in costs and best[i][0] < 10**15:
                best[j] = min(best[j], (best[i][0] + costs[word[i:j]], best[i][1] + 1))
    return best[-1]


def language_model(texts: list[str | None], exact: bool = False):
    """log2 probabilities of texts under their own bigrams, with counts as their levels' middles."""
    uni, bi = Counter(), Counter()
    for x in texts:
        w = words(x)
        uni.update(w)
        bi.update(zip(w, w[1:]))
    import math

    mid = lambda c: 0.0 if not c else (3.0 * 2 ** (c.bit_length() - 1) - 1) / 2
    n, kinds = sum(uni.values()), len(uni)
    base = lambda w: (mid(uni[w]) + 1) / (n + kinds)

    def score(x):
        w = words(x)
        total = 0.0
        for k, b in enumerate(w):
            total += math.log2(base(b) if not k else 0.7 * min(1, mid(bi[w[k - 1], b]) / max(mid(uni[w[k - 1]]), 1)) + 0.3 * base(b))
        return len(w), total

    return [score(x) for x in texts]
