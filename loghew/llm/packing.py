"""Harmonic packing of documents into token sequences of one capacity.

A piece of length r belongs to class k = capacity // r, and a bin of class k holds exactly
k pieces, so every worker fills the bins of each class by counting alone. Documents may be
cut: whole sequences go first, and a rest whose class would waste more than `slack` of a
bin is cut at the next reciprocal slot, capacity // (k + 1), until its last part fits.
What a worker leaves open is filled across workers, in groups of one class of some thousand
pieces, until each class is one group; the rest, under k pieces a class however large the
input, is packed best-fit by one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shards, small_batches, stored
from .kernels import slices
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, sequence_id long, offset long, ids array<int>"
COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]
ARROW = pa.schema(COLUMNS)
ACROSS, LAST = 1 << 60, 1 << 61


def cuts(length: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(size, class) of a document's pieces, in order."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k * rest >= capacity * (1 - slack):
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


class Bins:
    """Open bins by class (and group); add() gives a full bin's pieces with their offsets."""

    def __init__(self, base: int):
        self.open: dict[tuple[int, int], list] = defaultdict(list)
        self.next = base

    def add(self, piece: tuple, k: int, group: int = 0) -> list[tuple]:
        rows = self.open[k, group]
        rows.append(piece)
        if len(rows) < k:
            return []
        self.open[k, group] = []
        return self.close(rows)

    def close(self, rows: list) -> list[tuple]:
        at, out = 0, []
        for r in rows:
            out.append((*r[:6], self.next, at, *r[8:]))
            at += r[2]
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        return [r for k in sorted(self.open) for r in self.open[k]]


def batches_of(rows: list[tuple]):
    for a in range(0, len(rows), 4096):
        part = list(zip(*rows[a : a + 4096]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(part, COLUMNS)], schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, slack: float = 1 / 64, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, class, sequence_id, offset, ids.

    Documents are encoded without special tokens and ended by end_id; the pieces of a
    sequence lie gapless from offset 0. Without `with_ids` ids is null.

    Edge cases: a null text counts as empty (its one id is end_id); a null doc_id stays
    null; repeated rows are packed once each; long texts are encoded whole; an empty table
    gives no rows; further columns are ignored. Reruns over the same files agree.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def local(batches):
        own_encoder, bins = encoder(tokenizer), Bins(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, "text", 1 << 20):
            ids, off = own_encoder.ids(batch.column("text"))
            ids = np.insert(ids, off[1:], end_id).astype("<u4")
            off = (off + np.arange(len(off))).tolist()
            raw, rows = memoryview(ids.tobytes()), []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1], off[1:]):
                at = a
                for size, k in cuts(b - a, capacity, slack):
                    own = ids[at : at + size].astype(np.int32) if with_ids else None
                    rows += bins.add((doc_id, at - a, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), b - a, k, None, None, own), k)
                    at += size
            yield from batches_of(rows)
        yield from batches_of(bins.rest())

    def across(level):
        def run(batches):
            bins = Bins(ACROSS | level << 52 | TaskContext.get().partitionId() << 32)
            for batch in batches:
                rows = []
                for r, group in zip(zip(*(batch.column(n).to_pylist() for n, _ in COLUMNS)), batch.column("group").to_pylist()):
                    rows += bins.add(r, r[5], group)
                yield from batches_of(rows)
            yield from batches_of(bins.rest())

        return run

    def last(batches):
        rows = [r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n, _ in COLUMNS))]
        rows.sort(key=lambda r: (-r[2], r[0] is not None, r[0] or 0, r[1], r[3]))
        space: dict[int, list[list]] = defaultdict(list)
        for r in rows:
            left = next((s for s in range(r[2], capacity + 1) if space[s]), None)
            own = space[left].pop() if left is not None else []
            own.append(r)
            space[(capacity if left is None else left) - r[2]].append(own)
        bins = Bins(LAST)
        yield from batches_of([r for s in sorted(space) for own in space[s] for r in bins.close(own)])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    done = stored(text.mapInArrow(local, SCHEMA), "pieces")
    parts = [done.where(F.col("sequence_id").isNotNull())]
    for level in range(256):
        open_ = done.where(F.col("sequence_id").isNull())
        most = open_.groupBy("class").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // (4 * capacity))
        group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(groups, 1))).alias("group")
        dealt = open_.select("*", group).repartition(shards(docs, 64), "class", "group").sortWithinPartitions("class", "group", "doc_id", "start", "ids_crc32")
        done = stored(dealt.mapInArrow(across(level), SCHEMA), "pieces")
        parts.append(done.where(F.col("sequence_id").isNotNull()))
        if groups <= 1:
            break
    parts.append(done.where(F.col("sequence_id").isNull()).repartition(1).mapInArrow(last, SCHEMA))
    return reduce(DataFrame.unionByName, parts)
