"""Streams of log lines: templates online by prefix tree or common subsequence, and counts in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trees import PrefixTree, Subsequences

OUT = "source string, length int, line_id long, template_id long, template string"


def _templates(lines: DataFrame, state_type: str, load, save, idle: int | None) -> DataFrame:
    """State is kept by source and length; without lines for `idle` seconds it goes (None: never)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made = load(state.get if state.exists else None)
        rows = pd.concat(list(frames)).sort_values("line_id")
        ids = [made.add(m.split()) for m in rows["message"]]
        state.update(save(made))
        if idle is not None:
            state.setTimeoutDuration(idle * 1000)
        found = made.templates if isinstance(made, PrefixTree) else made.objects
        yield pd.DataFrame({"source": key[0], "length": key[1], "line_id": rows["line_id"], "template_id": ids, "template": [" ".join(found[i]) for i in ids]})

    keyed = lines.withColumn("length", F.size(F.split("message", " ")))
    return keyed.groupBy("source", "length").applyInPandasWithState(step, OUT, state_type, "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def stream_templates(lines: DataFrame, similarity: float = 0.5, most: int = 100, depth: int = 4, idle: int | None = None) -> DataFrame:
    """(source, length, line_id, template_id, template) of a stream (source, line_id, message), by prefix tree."""

    def load(held) -> PrefixTree:
        tree = PrefixTree(similarity, most, max(0, depth - 3))
        for path, leaf in zip(*held[:2]) if held else ():
            path = tuple(path)
            tree.leaves[path] = [int(x) for x in leaf]
            for i, w in enumerate(path):
                tree.children.setdefault(path[:i], set()).add(w)
        tree.templates = [list(t) for t in held[2]] if held else []
        return tree

    def save(tree: PrefixTree) -> tuple:
        return [list(p) for p in tree.leaves], list(tree.leaves.values()), tree.templates

    return _templates(lines, "paths array<array<string>>, leaves array<array<long>>, templates array<array<string>>", load, save, idle)


def stream_subsequences(lines: DataFrame, share: float = 0.5, idle: int | None = None) -> DataFrame:
    """(source, length, line_id, template_id, template) of a stream (source, line_id, message), by longest common subsequence."""

    def load(held) -> Subsequences:
        made = Subsequences(share)
        made.objects = [list(o) for o in held[0]] if held else []
        return made

    return _templates(lines, "objects array<array<string>>", load, lambda made: (made.objects,), idle)


def windowed_counts(rows: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of key in tumbling windows; rows later than `late` behind the newest are dropped by the watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
