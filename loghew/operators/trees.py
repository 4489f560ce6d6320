"""Order-dependent methods: prefix tree, hierarchical merging, longest common subsequence.

Each runs in line order inside a group that the method itself keeps apart (source and
length), on unique messages; parallelism comes from the groups.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import removed_patterns

WILD = "<*>"


class PrefixTree:
    """Templates of one message length under their first tokens, `layers` of them; '*' stands for tokens with digits and for what finds no room.

    A line looks for its tokens' children, else the '*' child; a line that reaches no leaf, or
    no template there that is similar enough, becomes a template of its own. A node has at
    most `most` children, the last of them '*'.
    """

    def __init__(self, similarity: float = 0.5, most: int = 100, layers: int = 1):
        self.similarity, self.most, self.layers = similarity, most, layers
        self.children: dict[tuple[str, ...], set[str]] = {}  # of each inner node, known by its path
        self.leaves: dict[tuple[str, ...], list[int]] = {}
        self.templates: list[list[str]] = []

    def sought(self, words: list[str]) -> tuple[str, ...] | None:
        path: tuple[str, ...] = ()
        for w in words[: self.layers]:
            known = self.children.get(path, ())
            if w not in known and "*" not in known:
                return None
            path += (w if w in known else "*",)
        return path

    def room(self, words: list[str]) -> tuple[str, ...]:
        path: tuple[str, ...] = ()
        for w in words[: self.layers]:
            known = self.children.setdefault(path, set())
            full = len(known) + ("*" not in known) >= self.most
            if w not in known and (full or any(ch.isdigit() for ch in w)):
                w = "*"
            known.add(w)
            path += (w,)
        return path

    def add(self, words: list[str]) -> int:
        best, score = -1, (-1.0, -1)
        for t in self.leaves.get(self.sought(words), ()):
            template = self.templates[t]
            same = sum(a == b != "*" for a, b in zip(template, words))
            own = (same / len(words) if words else 1.0, template.count("*"))
            if own > score:
                best, score = t, own
        if best >= 0 and score[0] >= self.similarity:
            self.templates[best] = [a if a == b else "*" for a, b in zip(self.templates[best], words)]
            return best
        self.templates.append(list(words))
        self.leaves.setdefault(self.room(words), []).append(len(self.templates) - 1)
        return len(self.templates) - 1

    def lines(self) -> list[tuple[int, str]]:
        """(depth, text) of the tree's nodes and templates, in order."""

        def under(path: tuple[str, ...]):
            for t in self.leaves.get(path, ()):
                yield len(path), " ".join(self.templates[t])
            for w in sorted(self.children.get(path, ())):
                yield len(path), w
                yield from under((*path, w))

        return list(under(()))


@dataclass(frozen=True)
class DrainParameters:
    """similarity: least share of agreeing places; most: children of a node; depth: with root, length and leaf; patterns: replacements before."""

    similarity: float = 0.5
    most: int = 100
    depth: int = 4
    patterns: tuple[tuple[str, str], ...] = ()


def drain(events: DataFrame, similarity: float = 0.5, most: int = 100, depth: int = 4, patterns: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """event_id, group of unique events, in order of first line within a message length.

    depth counts the root, the length and the leaf besides the token layers; patterns are
    replaced before the message is read.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        tree = PrefixTree(similarity, most, max(0, depth - 3))
        return pd.DataFrame({"event_id": rows["event_id"], "group": [f"{n}/{tree.add(m.split())}" for n, m in zip(rows["length"], rows["message"])]})

    message = removed_patterns(F.col("message"), list(patterns))
    rows = events.select("event_id", message.alias("message"), F.size(F.filter(F.split(message, " "), lambda t: t != "")).alias("length"))
    return rows.groupBy("length").applyInPandas(run, "event_id long, group string")


def align(a: list[str], b: list[str], match: int = 10, mismatch: int = 1, gap: int = 0) -> tuple[list[str], list[str]]:
    """Local alignment with '-' for gaps; of equal paths the diagonal, then the one that takes b's token, then the one that takes a's."""
    n, m = len(a), len(b)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    back = [[0] * (m + 1) for _ in range(n + 1)]
    top, at = 0, (0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d = score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch)
            u, left = score[i - 1][j] + gap, score[i][j - 1] + gap
            s = max(0, d, u, left)
            score[i][j] = s
            back[i][j] = 0 if s == 0 else 1 if s == d else 3 if s == left else 2
            if s >= top:
                top, at = s, (i, j)
    x, y, (i, j) = [], [], at
    while i and j and back[i][j]:
        step = back[i][j]
        x.append(a[i - 1] if step != 3 else "-")
        y.append(b[j - 1] if step != 2 else "-")
        i, j = i - (step != 3), j - (step != 2)
    return x[::-1], y[::-1]


def merged(a: list[str], b: list[str]) -> list[str]:
    """The aligned pair with the wild mark where they differ."""
    x, y = align(a, b)
    return [p if p == q else WILD for p, q in zip(x, y)]


def distance(a: list[str], b: list[str], k: float = 1.0) -> float:
    longest = max(len(a), len(b))
    return 1.0 - k * sum(p == q for p, q in zip(a, b)) / longest if longest else 0.0


def logmine(events: DataFrame, most: float = 0.001, levels: int = 2, widen: float = 100.0) -> DataFrame:
    """event_id, group: greedy clusters by distance, then their merged patterns clustered at a wider distance.

    Distances compare place by place, so lines of unlike length differ by their length
    alone; the groups are the message lengths, which keeps each bounded.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        words = [m.split() for m in rows["message"]]
        groups = [[i] for i in range(len(words))]
        patterns, limit = list(words), most
        for _ in range(levels):
            leaders: list[int] = []
            joined: list[list[int]] = []
            for i, pattern in enumerate(patterns):
                to = next((g for g, x in enumerate(leaders) if distance(patterns[x], pattern) <= limit), None)
                if to is None:
                    leaders.append(i)
                    joined.append([i])
                else:
                    joined[to].append(i)
            new = []
            for members in joined:
                p = patterns[members[0]]
                for i in members[1:]:
                    p = p if p == patterns[i] else merged(p, patterns[i])
                new.append(p)
            groups = [[e for i in members for e in groups[i]] for members in joined]
            patterns, limit = new, limit * widen
        of = {e: g for g, members in enumerate(groups) for e in members}
        return pd.DataFrame({"event_id": rows["event_id"], "group": [f"{n}/{of[i]}" for i, n in enumerate(rows["message_length"])]})

    return events.select("event_id", "message_length", "message").groupBy("message_length").applyInPandas(run, "event_id long, group string")


def common_words(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


class Subsequences:
    """Streaming templates: a line joins the object with the longest common subsequence, at least half its length."""

    def __init__(self, share: float = 0.5):
        self.share = share
        self.objects: list[list[str]] = []

    def add(self, words: list[str]) -> int:
        best, length, found = -1, 0, []
        own = Counter(words)
        for i, o in enumerate(self.objects):
            if len(o) <= length or (Counter(o) & own).total() <= length:  # no longer sequence is possible
                continue
            c = common_words(o, words)
            if len(c) > length:
                best, length, found = i, len(c), c
        if best >= 0 and length >= self.share * len(words):
            self.objects[best] = found
            return best
        self.objects.append(list(words))
        return len(self.objects) - 1


def spell(events: DataFrame, share: float = 0.5, block: str = "message_length") -> DataFrame:
    """event_id, group by longest common subsequence, blocked so that no group holds a whole source."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        s = Subsequences(share)
        return pd.DataFrame({"event_id": rows["event_id"], "group": [f"{n}/{s.add(m.split())}" for n, m in zip(rows["block"], rows["message"])]})

    return events.select("event_id", F.col(block).alias("block"), "message").groupBy("block").applyInPandas(run, "event_id long, group string")
