"""Plain single-process versions of the operators, to compare results with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
from xxhash import xxh64_intdigest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least_reachable(ids: list, links: list[tuple]) -> dict:
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def substring_dedup(texts: dict, window: int = 35) -> dict:
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    starts = Counter(tuple(w[i:i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for key, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[key] = (len(w), sum(gone), sha256(kept.encode()).hexdigest())
    return out


def simhash(text: str | None, shingle: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    counts = [0] * 64
    for gram in grams:
        h = xxh64_intdigest(gram.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if counts[bit] * 2 > len(grams))


def simhash_components(texts: dict, most: int = 3) -> dict:
    prints = {i: simhash(t) for i, t in texts.items()}
    by_print = defaultdict(list)
    for i, p in prints.items():
        by_print[p].append(i)
    distinct = np.array(sorted(by_print), dtype=np.uint64)
    links = [(min(v), x) for v in by_print.values() for x in v]
    for k, one in enumerate(distinct):
        for other in distinct[k + 1:][np.bitwise_count(distinct[k + 1:] ^ one) <= most]:
            links.append((by_print[int(one)][0], by_print[int(other)][0]))
    least = least_reachable(list(texts), links)
    return {i: (f"{prints[i]:016x}", least[i]) for i in texts}
