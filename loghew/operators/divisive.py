"""The graph method: divisive clustering of similarity graphs, stars, re-clustering, merging.

Removing the lightest edges one by one passes through exactly the components of a maximum
spanning forest cut from its lightest edge on, so a group needs one sort and a sweep.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNS = set("!#$%&()*+,-./:;<=>?@[\\]^_{|}~")


def weights(words: list[list[str]]) -> np.ndarray:
    """Symmetric weighted Hamming matrix (upper triangle from the earlier row), three digits half-even."""
    n = len(words)
    wide = max(map(len, words), default=0)
    ids: dict[str, int] = {}
    codes = np.full((n, wide), -1)
    for i, w in enumerate(words):
        codes[i, : len(w)] = [ids.setdefault(t, len(ids)) for t in w]
    out = np.zeros((n, n))
    for i in range(n):
        m = len(words[i])
        if m:
            w = np.arange(m, 0, -1)
            same = (codes[i + 1 :, :m] == codes[i, :m]) @ w
            out[i, i + 1 :] = np.round(same / (m * (m + 1) / 2), 3)
    return out + out.T


def components(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for x in range(n):
        out.setdefault(root(x), []).append(x)
    return list(out.values())


def divide(w: np.ndarray) -> list[list[int]]:
    """The partition of the highest weighted modularity among those that cutting lightest edges gives; the first of equal ones."""
    n = len(w)
    a, b = np.nonzero(np.triu(w, 1))
    order = np.lexsort([b, a, w[a, b]])[::-1]  # heaviest first: the reverse of removal
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    m, degree = w.sum() / 2, w.sum(axis=1)
    links = [dict(zip(np.flatnonzero(row).tolist(), row[row > 0].tolist())) for row in w]
    q = -float(((degree / (2 * m)) ** 2).sum())
    deg = degree.tolist()
    merges, scores = [], [q]
    for i in order.tolist():
        x, y = root(int(a[i])), root(int(b[i]))
        if x == y:
            continue
        if len(links[x]) < len(links[y]):
            x, y = y, x
        between = links[x].pop(y, 0.0)
        links[y].pop(x, None)
        for z, v in links[y].items():
            links[x][z] = links[x].get(z, 0.0) + v
            links[z][x] = links[z].pop(y) + links[z].get(x, 0.0)
        q += between / m - 2 * deg[x] * deg[y] / (2 * m) ** 2
        deg[x] += deg[y]
        up[y] = x
        merges.append((int(a[i]), int(b[i])))
        scores.append(q)
    best, top = 0, -np.inf
    for k in range(len(merges) - 1, -1, -1):  # the whole graph itself is no candidate; fewer cuts come first
        if scores[k] > top + 1e-12:
            best, top = k, scores[k]
    return components(n, merges[:best])


def cluster(words: list[list[str]], nodes: list[int], gate: float = 0.8, most: int = 10_000, least: float = 0.75, pair: float = 0.5) -> list[tuple[list[int], bool]]:
    """(nodes, whether a merge may take it) of one length group."""
    work, out = [nodes], []
    while work:
        own = work.pop()
        if len(own) == 1:
            out.append((own, False))
            continue
        w = weights([words[i] for i in own])
        edges = int((w > 0).sum() // 2)
        density = 2 * edges / (len(own) * (len(own) - 1))
        if gate < density <= 1.0 and edges >= most:
            a, b = np.nonzero(np.triu(w >= least, 1))
            out += [([own[i] for i in c], True) for c in components(len(own), list(zip(a.tolist(), b.tolist())))]
            continue
        alone = np.flatnonzero(w.sum(axis=1) == 0)
        out += [([own[i]], False) for i in alone.tolist()]
        a, b = np.nonzero(np.triu(w, 1))
        rest = []
        for c in components(len(own), list(zip(a.tolist(), b.tolist()))):
            if len(c) == 2:
                both = [own[i] for i in c]
                out += [([x], False) for x in both] if w[c[0], c[1]] < pair else [(both, False)]
            elif len(c) > 2:
                rest += c
        if not rest:
            continue
        for c in divide(w[np.ix_(rest, rest)]):
            part = [own[rest[i]] for i in c]
            if len(part) > 3 and len(part) < len(own):
                work.append(part)
            else:
                out.append((part, True))
    return out


def starred(rows: list[list[str]]) -> list[str]:
    return [c[0] if len(set(c)) == 1 else "*" for c in zip(*rows)]


def word_class(word: str) -> str:
    letters, digits = sum(ch.isalpha() for ch in word), sum(ch.isdigit() for ch in word)
    return "*" if letters == 1 or digits == 1 or all(ch.isdigit() or ch in SIGNS for ch in word) else word


def vague(t: list[str]) -> bool:
    return bool(t) and (set(t) == {"*"} or (t.count("*") == len(t) - 1 and len(t) > 3))


def abstract(words: list[list[str]]) -> list[int]:
    """Group of each event of one length group; every event is in exactly one."""
    final: list[tuple[list[int], bool]] = []
    work = cluster(words, list(range(len(words))))
    while work:
        nodes, ok = work.pop(0)
        if len(nodes) > 1 and vague(starred([words[i] for i in nodes])):
            again = cluster(words, nodes)
            if len(again) > 1:  # else no progress: keep it
                work = again + work
                continue
        final.append((nodes, ok))
    final.sort(key=lambda x: min(x[0]))
    kept: list[list] = []
    for nodes, ok in final:
        t = starred([words[i] for i in nodes])
        for other in kept:
            if not (ok and other[1] and t and len(t) == len(other[2])):
                continue
            parent, child = (other[2], t) if other[2].count("*") >= t.count("*") else (t, other[2])
            if all(p == q or p == "*" or word_class(p) == word_class(q) for p, q in zip(parent, child)):
                other[0] += nodes
                other[2] = [p if p == q else "*" for p, q in zip(parent, child)]
                break
        else:
            kept.append([list(nodes), ok, t])
    out = [0] * len(words)
    for g, (nodes, _, _) in enumerate(kept):
        for i in nodes:
            out[i] = g
    return out


def graph_method(events: DataFrame) -> DataFrame:
    """event_id, group of unique events; a group of equal message length is one task, on its unique messages."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        found = abstract([m.split() for m in rows["message"]])
        return pd.DataFrame({"event_id": rows["event_id"], "group": [f"{n}/{g}" for n, g in zip(rows["message_length"], found)]})

    return events.select("event_id", "message_length", "message").groupBy("message_length").applyInPandas(run, "event_id long, group string")
