"""One-permutation MinHash fingerprints with optimal densification and packed low bits."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, shards, small_batches, stored
from .kernels import MULTIPLIERS, U, Words, mix, slices

EMPTY = np.uint64(2**64 - 1)


def sketch(column: pa.Array, k: int, bins: int, bits: int) -> np.ndarray:
    """Packed fingerprints, one row of bins * bits / 8 bytes a text; texts without words give zeros.

    Every shingle hash is used once: its upper part picks the bin, its lower part competes
    there. An empty bin takes the value of the first nonempty bin on a random walk that is
    the same for all texts (optimal densification), so equal sets agree and the estimate
    keeps its variance.
    """
    h, off = Words(column, lower=True).shingles(k)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    low = np.full(n * bins, EMPTY)
    np.minimum.at(low, doc * bins + (h >> U(32) & U(bins - 1)).astype(np.int64), mix(h * MULTIPLIERS[100]) >> U(1))
    low = low.reshape(n, bins)
    full = low != EMPTY
    d, b = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt, out = 0, low.copy()
    while len(d):
        attempt += 1
        to = (mix((b.astype(np.uint64) + U(1)) * MULTIPLIERS[101] + np.array([attempt], np.uint64) * MULTIPLIERS[102]) % U(bins)).astype(np.int64)
        hit = full[d, to]
        out[d[hit], b[hit]] = low[d[hit], to[hit]]
        d, b = d[~hit], b[~hit]
    code = (mix(out) & U((1 << bits) - 1)).astype(np.uint8)
    code[~full.any(axis=1)] = 0
    planes = (code[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(n, bins * bits), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray, bins: int, bits: int) -> np.ndarray:
    """Similarity estimate from two rows of fingerprints, corrected for low bits that agree by chance."""
    differ = np.unpackbits(a ^ b, axis=1).reshape(len(a), bins, bits).any(axis=2)
    same = 1 - differ.mean(axis=1)
    chance = 2.0**-bits
    out = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), out)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RESULT_TYPE = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
EDGE = "did long, th long, tie long, text string, waits boolean"
EDGE_TYPE = [("did", pa.int64()), ("th", pa.int64()), ("tie", pa.int64()), ("text", pa.string()), ("waits", pa.bool_())]
TYPE = pa.schema([*RESULT_TYPE, *EDGE_TYPE])


def blank(texts: list[str]) -> np.ndarray:
    return np.array([not t.strip(" \t\n\v\f\r") for t in texts], bool)


def described(ids: list[int], texts: list[str], following: list[str], k: int, bins: int, bits: int, edit: int) -> pa.RecordBatch:
    """The result rows of texts, given the text after each."""
    cuts = [len(t) // edit for t in texts]
    edited = [t[: len(t) - c] + f[:c] for t, f, c in zip(texts, following, cuts)]
    every = texts + [f for i, f in enumerate(following) if i + 1 == len(texts) or f is not texts[i + 1]]
    place, at = [], len(texts)
    for i, f in enumerate(following):
        if i + 1 < len(texts) and f is texts[i + 1]:
            place.append(i + 1)
        else:
            place.append(at)
            at += 1
    own, of_edited = sketch(pa.array(every, pa.string()), k, bins, bits), sketch(pa.array(edited, pa.string()), k, bins, bits)
    none, none_e, n = blank(every), blank(edited), len(texts)
    after = np.array(place)
    fields = [
        pa.array([None if d == NULL_ID else d for d in ids], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(["" if none[i] else own[i].tobytes().hex() for i in range(n)]),
        pa.array(["" if none_e[i] else of_edited[i].tobytes().hex() for i in range(n)]),
        pa.array(likeness(own[:n], of_edited, none[:n], none_e, bins, bits)),
        pa.array(likeness(own[:n], own[after], none[:n], none[after], bins, bits)),
    ]
    return pa.RecordBatch.from_arrays([*fields, *(pa.nulls(n, t) for _, t in EDGE_TYPE)], schema=TYPE)


def fingerprint(docs: DataFrame, k: int = 5, bins: int = 256, bits: int = 4, edit: int = 4) -> DataFrame:
    """doc_id, n_chars, fingerprints of each text and of its edited text, likeness to that and to the next text.

    The edited text's last floor(n_chars / edit) code points are the first as many of the
    next document by doc_id (after the last: the first). Documents are dealt by ranges of
    their ids; inside a range each has its successor beside it. A range's first and last
    document go on to the next level, where they are dealt by ranges again, until one range
    is left, whose last document is followed by its first.

    Edge cases: null texts are empty; texts without words have an empty fingerprint, alike
    to each other (1) and to no other (0); a null doc_id sorts first and stays null; rows
    that share a doc_id are ordered by a hash of the text, and rows equal in both follow each
    other; a lone document is its own next; an empty table gives no rows; further columns
    are ignored.
    """
    small_batches(docs.sparkSession)

    def level(alone: bool):
        def run(batches):
            first = last = None  # rows (did, th, tie, text, waits); the last one's successor is not seen yet
            for batch in slices(batches, "text", 1 << 19):
                rows = list(zip(*(batch.column(c).to_pylist() for c, _ in EDGE_TYPE)))
                first = first or rows[0]
                if last:
                    rows.insert(0, last)
                last = rows[-1]
                at = [i for i in range(len(rows) - 1) if rows[i][4]]
                if at:
                    yield described([rows[i][0] for i in at], [rows[i][3] for i in at], [rows[i + 1][3] for i in at], k, bins, bits, edit)
            if alone:
                if last and last[4]:
                    yield described([last[0]], [last[3]], [first[3]], k, bins, bits, edit)
            elif last:
                edges = [last] if first[:3] == last[:3] else [(*first[:4], False), last]
                fields = [pa.array(c, t) for c, (_, t) in zip(zip(*edges), EDGE_TYPE)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(edges), t) for _, t in RESULT_TYPE), *fields], schema=TYPE)

        return run

    names = [c for c, _ in RESULT_TYPE]
    rows = keyed(docs).select("did", "th", F.monotonically_increasing_id().alias("tie"), "text", F.lit(True).alias("waits"))
    parts, done = shards(docs, 16), []
    while True:
        dealt = rows.repartitionByRange(parts, "did", "th", "tie") if parts > 1 else rows.repartition(1)
        got = dealt.sortWithinPartitions("did", "th", "tie").mapInArrow(level(parts == 1), f"{RESULT}, {EDGE}")
        if parts == 1:
            done.append(got.select(*names))
            return reduce(DataFrame.unionByName, done)
        got = stored(got, "fingerprints")
        done.append(got.where("waits is null").select(*names))
        rows, parts = got.where("waits is not null").select(*(c for c, _ in EDGE_TYPE)), -(-parts // 256)
