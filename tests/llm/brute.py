"""Plain versions of the operators, for small fixtures."""

import math
import zlib
from collections import defaultdict


def words(text):
    return (text or "").encode().lower().split()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(docs, size, percent=80):
    """docs: {doc_id: text} -> {doc_id: component}, by an inverted index over all shingles."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    first, links, by = {}, [], defaultdict(list)
    for i in sorted(sets):
        if sets[i]:
            if sets[i] in first:
                links.append((i, first[sets[i]]))
            else:
                first[sets[i]] = i
    for i in first.values():
        met = defaultdict(int)
        for s in sets[i]:
            for j in by[s]:
                met[j] += 1
            by[s].append(i)
        links += [(i, j) for j, n in met.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
    return components(docs, links)


def mix(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """rows: (doc_id, source, size) -> ({source: target}, sizes): sharing again and again what is over a source's limit."""
    size = defaultdict(int)
    for _, s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = {}, share * sum(size.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
            open_.remove(s)
    return target, size


def log10(x):
    return math.log10(x)
