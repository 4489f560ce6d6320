"""Suffix-array dedup on bytes: repeats of 100 bytes, found by external induced sorting.

The scan of repeats settles stretches of windows that come again whole, told by two 64-bit
hashes; those that share an anchor but differ are shards of short strings, whose suffixes
induced.suffixes sorts, with common-prefix values, in files of the task. Neighbours with a
common prefix of a window's length or more hold the same window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NULL_ID, dropped, shards, stored
from .induced import BLOCK, Column, suffixes
from .kernels import BYTE_CODE, buffers, segments
from .repeats import ROW_TYPE, ROWS, SPAN_TYPE, SPANS, Repeats, by_slot, column, emit, firsts, hash_slot, merged, pack, records, rows_of, unpack

STRING = {"did": "i8", "th": "i8", "st": "i4", "nw": "i4"}
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def bytes_of(column, covered: bool = False):
    raw, off = buffers(column)
    return (len(raw) if covered else BYTE_CODE[raw]), off


def joined(blocks: Iterator[tuple], size: int) -> Iterator[tuple]:
    """The same tuples in blocks of about size rows."""
    held, n = [], 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= size:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def settle(loads: Iterator[bytes], length: int, held: int, limit: int) -> Iterator[dict[str, np.ndarray]]:
    """The windows of a shard that an earlier place holds as well, as spans, block by block."""
    text, places = Column(np.uint8), {k: Column(kind) for k, kind in STRING.items()} | {"start": Column(np.int64)}
    for load in loads:
        x = unpack(load, **STRING)
        size = x["nw"].astype(np.int64) + length - 1
        total = int(size.sum())
        ended = np.zeros(total + len(size), np.uint8)
        ended[segments(np.cumsum(size + 1) - size - 1, size)] = np.frombuffer(load, np.uint8, total, len(load) - total) + np.uint8(1)  # 0 is the end mark, so U+0000 becomes 1; UTF-8 has no byte 254 or 255
        places["start"].append(text.n + np.cumsum(size + 1) - size - 1)
        for k, v in x.items():
            places[k].append(v)
        text.append(ended)
    if not text.n:
        return
    start, did, th, st = (places[k].view() for k in ("start", "did", "th", "st"))
    carry = None  # of a group that may go on, the earliest place
    for at, lcp in joined(suffixes(text, length, held, limit), BLOCK):
        same = lcp >= length
        if carry is not None:
            at, same = np.concatenate([carry, at]), np.concatenate([[False], same])
        same[0] = False
        member = same | np.append(same[1:], True)
        group, at = np.cumsum(~same)[member], at[member]
        row = np.searchsorted(start, at, "right") - 1
        place = [did[row], th[row], st[row] + (at - start[row])]
        order, first, later = firsts([group], place)
        carry = at[order[first][-1:]]
        late = order[later]
        if len(late):
            d, t, s = (p[late] for p in place)
            yield merged({"did": d, "th": t, "st": s.astype("i4"), "n": np.full(len(late), length, "i4")}, False)


def dedup_bytes(docs: DataFrame, length: int = 100, gram: int = 32, held: int = 64 << 20, limit: int = 1 << 20) -> DataFrame:
    """Each document without the bytes that lie in an earlier repeated string of `length` bytes.

    Texts are UTF-8 bytes; a match never crosses documents. A byte goes when a string of
    `length` (up to 254) bytes over it also starts earlier: in a smaller doc_id, or earlier
    in the same document. Overlaps count and strings are judged on the input. `held` bounds
    the bytes a queue of a shard keeps in memory, `limit` the names sorted there; the rest
    goes to files of the task.

    Edge cases: a null text counts as empty; a null doc_id sorts first and stays null; rows
    equal in doc_id and text are one document, returned once a row; rows that share only
    the doc_id are ordered by a hash of the text; an empty table gives no rows; further
    columns are ignored. Kept bytes may cut a character, so they are binary.
    """

    repeats = Repeats(docs, bytes_of, length, gram, sources=False)
    anchors = shards(docs, 2)  # a usual shard's names then fit in memory

    def split(docs: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return ROW_TYPE.empty_table()
        texts, row = rows_of(docs, rows)
        raw, off = buffers(texts)
        o = {k: column(rows, k) for k in STRING}
        out = []
        for slot, own in by_slot(hash_slot(column(rows, "mh").view("u8"), anchors)):
            size = o["nw"][own].astype(np.int64) + length - 1
            out.append((slot, pack(**{k: o[k][own] for k in STRING}) + raw[segments(off[row[own]] + o["st"][own], size)].tobytes()))
        return pa.Table.from_batches(list(emit(out)), ROW_TYPE)

    def close(batches):
        for c in settle((x for b in batches for x in b.column("load").to_pylist()), length, held, limit):
            yield from records(c, SPAN_TYPE)

    def result(batch, covered, doc):
        raw, _ = buffers(batch.column("text"))
        gone = np.concatenate([[0], np.cumsum(covered)])
        opens = covered.copy()
        opens[1:] &= ~covered[:-1]
        inner = doc[:-1][doc[:-1] < len(covered)]
        opens[inner] = covered[inner]
        spans = np.concatenate([[0], np.cumsum(opens)])
        left = raw[~covered].tobytes()
        to = (doc - gone[doc]).tolist()
        kept = [left[a:b] for a, b in zip(to[:-1], to[1:])]
        ids = [None if d == NULL_ID else d for d in batch.column("did").to_pylist()]
        counts = [pa.array(np.diff(v), pa.int64()) for v in (doc, gone[doc], spans[doc])]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())], schema=ARROW)

    found = repeats.scan()
    strings = repeats.with_texts(repeats.open(found), split, ROWS).select("slot", "load").repartition(anchors, "slot")
    spans = stored(repeats.spans(found).unionByName(strings.mapInArrow(close, SPANS)), "spans")
    dropped(found)
    return repeats.removed(spans, result, RESULT, ARROW)
