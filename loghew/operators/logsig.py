"""Term-pair signatures: pairs, seeded local search into k groups, signatures."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import tokens


def term_pairs(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, w1, w2, n: ordered pairs of a line's tokens, each line counting a pair once a place pair; equal messages are counted first."""
    t = lines.groupBy(*keys, "message").agg(F.count("*").alias("times")).withColumn("t", tokens("message"))
    after = lambda x, j: F.transform(F.slice("t", j + 2, F.size("t")), lambda y: F.struct(x.alias("w1"), y.alias("w2")))
    return t.select(*keys, "times", F.explode(F.flatten(F.transform("t", after))).alias("p")).groupBy(*keys, "p.w1", "p.w2").agg(F.sum("times").alias("n"))


def signatures(lines: DataFrame, group: str) -> DataFrame:
    """group, signature: the most frequent sequence (first line of equal ones) of the words that half the group's lines hold; equal messages are counted first."""
    t = lines.groupBy(group, "message").agg(F.count("*").alias("times"), F.min("line_id").alias("first_line")).withColumn("t", tokens("message"))
    size = t.groupBy(group).agg(F.sum("times").alias("lines"))
    often = t.select(group, "times", F.explode(F.array_distinct("t")).alias("w")).groupBy(group, "w").agg(F.sum("times").alias("n")).join(size, group).where(F.col("n") >= F.ceil(F.col("lines") / 2))
    words = often.groupBy(group).agg(F.collect_set("w").alias("often"))  # at most twice the words of a line, as each is in half of them
    kept = t.join(words, group).withColumn("signature", F.array_join(F.filter("t", lambda w: F.array_contains("often", w)), " ")).where("signature <> ''")
    counts = kept.groupBy(group, "signature").agg(F.sum("times").alias("n"), F.min("first_line").alias("first_line"))
    best = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "first_line"))
    return counts.withColumn("r", best).where("r = 1").select(group, "signature")


def local_search(messages: list[str], weights: list[int], k: int, seeds: list[int]) -> list[int]:
    """Group of each message: in order, each moves to the group whose potential gains most, until none moves.

    The gain counts the message's lines as joined: for each of its pairs 3 times the square of
    the pair's share in the new group, with them, less that in the old one; the first of equal
    groups wins, and the old one, rated alike, keeps a message that gains nowhere more. A
    search that comes back to an earlier state stops there, as it would go round for ever.
    """
    ids: dict[tuple[str, str], int] = {}
    pairs = [np.array([ids.setdefault(p, len(ids)) for p in combinations(m.split(), 2)], np.int64) for m in messages]
    group = [s % k for s in seeds]
    held, sizes = np.zeros((k, len(ids))), np.zeros(k)
    for g, p, w in zip(group, pairs, weights):
        sizes[g] += w
        np.add.at(held[g], p, w)
    seen = {tuple(group)}
    while True:
        before = list(group)
        for i, (p, w) in enumerate(zip(pairs, weights)):
            own = group[i]
            share = ((held[:, p] + w) / (sizes[:, None] + w)) ** 2 - (held[own, p] / sizes[own]) ** 2
            gains = 3 * share.sum(axis=1)
            best = int(gains.argmax())
            if best != own and gains[best] > max(0.0, gains[own]):
                sizes[own] -= w
                sizes[best] += w
                np.add.at(held[own], p, -w)
                np.add.at(held[best], p, w)
                group[i] = best
        state = tuple(group)
        if group == before or state in seen:
            return group
        seen.add(state)


@dataclass(frozen=True)
class Parameters:
    """groups: at most this many a length; key: the column that keeps searches apart."""

    groups: int = 10
    key: str = "message_length"


def logsig(events: DataFrame, k: int, key: str = "message_length") -> DataFrame:
    """event_id, group: a seeded search over unique messages within each length, `k` groups a length at most."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        kk = min(k, len(rows))
        found = local_search(rows["message"].tolist(), rows["n"].tolist(), kk, rows["seed"].tolist())
        return pd.DataFrame({"event_id": rows["event_id"], "group": [f"{n}/{g}" for n, g in zip(rows[key], found)]})

    rows = events.select("event_id", key, "message", F.size("members").alias("n"), F.pmod(F.xxhash64("event_id"), F.lit(1 << 30)).alias("seed"))
    return rows.groupBy(key).applyInPandas(search, "event_id long, group string")
