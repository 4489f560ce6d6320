"""Repeated windows across a corpus: anchors, stretches of windows and the first place of each.

Every window of `length` units (words or bytes) is dealt by its anchor, the least hashed gram
inside it, so equal windows have equal anchors. Consecutive windows of a document with one
anchor form a stretch, which travels as one small record, not as its windows:

1. scan: stretches of each chunk of documents, equal ones of a chunk settled there, are dealt
   by the hash of the whole stretch (no anchor gathers in one task); of equal ones the
   earliest is kept, and later ones are copies of it;
2. of the kept ones those whose anchor has several stay open: they may share windows. The
   caller resolves them, with their texts;
3. copies that go on from each other, in document and source, are joined to spans;
4. the spans of each document are joined with its text.

A record is sent once per chunk and stretch, whatever the number of copies in the chunk, and
no step makes pairs. Documents are ordered by (did, th); see common.keyed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, shards, small_batches, stored
from .kernels import U, mix, prefix, ranges, slices, window_argmin

CHUNK = 1 << 19
HELD = 12
#: A packed record of many rows, or an open stretch.
ROWS = "slot int, load binary, mh long, did long, th long, st int, nw int"
FIELDS = [("slot", pa.int32()), ("load", pa.binary()), ("mh", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("st", pa.int32()), ("nw", pa.int32())]
ROW_TYPE = pa.schema(FIELDS)
#: n units from st of a document equal those from fst of an earlier place.
SPANS = "did long, th long, st int, n int, fdid long, fth long, fst int"
SPAN_TYPE = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("st", pa.int32()), ("n", pa.int32()), ("fdid", pa.int64()), ("fth", pa.int64()), ("fst", pa.int32())])
COPY, OPEN = 0, 1


def pack(**columns: np.ndarray) -> bytes:
    """Columns as byte planes, so that the shuffle's compression finds the empty high bytes."""
    n = len(next(iter(columns.values())))
    parts = [np.int64(n).tobytes()]
    for a in columns.values():
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T).tobytes())
    return b"".join(parts)


def unpack(load: bytes, **kinds: str) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(load, np.int64, 1)[0]), 8, {}
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(load, np.uint8, n * size, at).reshape(size, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        at += n * size
    return out


def gathered(loads: list[bytes], **kinds: str) -> dict[str, np.ndarray]:
    parts = [unpack(x, **kinds) for x in loads]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, v) for k, v in kinds.items()}


PATH = {"mh": "u8", "sh": "u8", "did": "i8", "th": "i8", "st": "i4", "nw": "u2"}
CUTS = {"did": "i8", "th": "i8", "st": "i4", "n": "i4"}
SOURCES = {"fdid": "i8", "fth": "i8", "fst": "i4"}


def paths(codes: np.ndarray, doc: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The stretches of documents given as unit codes; doc: each document's offsets."""
    none = {k: np.zeros(0, v) for k, v in PATH.items()} | {"doc": np.zeros(0, np.int64)}
    if len(codes) < length:
        return none
    c = prefix(codes)
    at = np.arange(len(codes) - gram + 1)
    g = ranges(c, at, at + gram)
    m = window_argmin(g, length - gram + 1)
    valid = np.ones(len(m) + 1, bool)
    tail = doc[1:, None] - np.arange(1, length)[None, :]
    tail = tail[(tail >= doc[:-1, None]) & (tail < len(m))]
    valid[tail] = False
    valid[-1] = False
    change = np.ones(len(m), bool)
    change[1:] = (m[1:] != m[:-1]) | ~valid[: len(m) - 1]
    start = np.flatnonzero(valid[:-1] & change)
    if not len(start):
        return none
    stop = np.flatnonzero(valid[:-1] & ~(valid[1:] & np.concatenate([~change[1:], [False]]))) + 1
    d = np.searchsorted(doc, start, "right") - 1
    return {"mh": g[m[start]], "sh": ranges(c, start, stop + length - 1), "st": (start - doc[d]).astype("i4"), "nw": (stop - start).astype("u2"), "doc": d}


def firsts(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, later): rows sorted by keys, then place; which sorted rows open a key, and which come later in place than their key's first."""
    order = np.lexsort([*reversed(place), *reversed(keys)])
    n = len(order)
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    later = np.zeros(n, bool)
    for p in place:
        s = p[order]
        later |= s != s[lead]
    return order, new, later


def by_slot(slots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, its rows), slot by slot."""
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    edges = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1], [True]])) if len(slots) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(slots[a]), order[a:b]


def hash_slot(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix(h) >> U(40)) * U(n) >> U(24)).astype(np.int32)  # anchors are minima of hashes, so they are hashed again


def doc_slot(x: dict, n: int) -> np.ndarray:
    return np.mod(x["did"] ^ x["th"], n).astype(np.int32)


def emit(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 64):
        part = rows[a : a + 64]
        none = [pa.nulls(len(part), t) for _, t in FIELDS[2:]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary()), *none], schema=ROW_TYPE)


def records(columns: dict[str, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Plain rows; what columns lack is null."""
    n = len(next(iter(columns.values())))
    for a in range(0, n, 1 << 14):
        size = min(1 << 14, n - a)
        yield pa.RecordBatch.from_arrays([pa.array(columns[k][a : a + size].astype(t.to_pandas_dtype()), t) if k in columns else pa.nulls(size, t) for k, t in zip(schema.names, schema.types)], schema=schema)


def merged(c: dict[str, np.ndarray], sources: bool) -> dict[str, np.ndarray]:
    """Spans that touch or overlap, with one offset to one source, as one."""
    keys = [c["did"], c["th"]]
    if sources:
        keys += [c["fdid"], c["fth"], c["fst"].astype(np.int64) - c["st"]]
    order = np.lexsort([c["st"], *reversed(keys)])
    st, end = c["st"][order].astype(np.int64), (c["st"].astype(np.int64) + c["n"])[order]
    new = np.ones(len(order), bool)
    new[1:] = st[1:] > end[:-1]
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    head = np.flatnonzero(new)
    out = {k: v[order][head] for k, v in c.items()}
    out["n"] = (np.maximum.reduceat(end, head) - st[head] if len(head) else end).astype("i4")
    return out


def prime(n: int) -> int:
    while any(n % p == 0 for p in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class Repeats:
    """units(column) -> (codes, doc offsets). sources: keep where each copy comes from."""

    def __init__(self, docs: DataFrame, units: Callable, length: int, gram: int, sources: bool):
        self.units, self.length, self.gram, self.sources = units, length, gram, sources
        small_batches(docs.sparkSession)
        self.docs = keyed(docs)
        if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
            self.docs = self.docs.withColumn("th", F.lit(0).cast("long"))  # unique ids need no text hash, and a zero costs no bytes
        self.anchors = shards(docs, 8)
        self.slots = prime(shards(docs, 4))

    def scan(self) -> DataFrame:
        """Step 1: packed copies by document slot, and open stretches."""
        units, length, gram, anchors, slots = self.units, self.length, self.gram, self.anchors, self.slots
        sources = self.sources
        cut_kinds = CUTS | SOURCES if sources else CUTS

        def copies(x: dict, order: np.ndarray, new: np.ndarray, later: np.ndarray) -> dict[str, np.ndarray]:
            late = order[later]
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[later]]
            own = {"did": x["did"][late], "th": x["th"][late], "st": x["st"][late], "n": x["nw"][late].astype("i4") + (length - 1)}
            return own | {"fdid": x["did"][first], "fth": x["th"][first], "fst": x["st"][first]} if sources else own

        def settle(x: dict) -> tuple[np.ndarray, dict]:
            order, new, later = firsts([x["mh"], x["sh"]], [x["did"], x["th"], x["st"]])
            return order[new], copies(x, order, new, later)

        def chunk(batches):
            held: list[dict] = []

            def flush():
                x = {k: np.concatenate([h[k] for h in held]) for k in PATH}
                held.clear()
                kept, c = settle(x)
                x = {k: v[kept] for k, v in x.items()}
                rows = [(slot, bytes([OPEN]) + pack(**{k: x[k][own] for k in PATH})) for slot, own in by_slot(hash_slot(x["mh"] ^ x["sh"], anchors))]
                if len(c["did"]):  # copies inside the chunk; dealt out evenly, they only pass through
                    rows.append((int(c["did"][0] % anchors), bytes([COPY]) + pack(**c)))
                return emit(rows)

            for batch in slices(batches, "text", CHUNK):
                codes, doc = units(batch.column("text"))
                p = paths(codes, doc, length, gram)
                d = p.pop("doc")
                did, th = (np.asarray(batch.column(k)) for k in ("did", "th"))
                if len(d):
                    held.append(p | {"did": did[d].astype("i8"), "th": th[d].astype("i8")})
                if len(held) >= HELD:
                    yield from flush()
            if held:
                yield from flush()

        def join(batches):
            loads, rows = [], []
            for batch in batches:
                for load in batch.column("load").to_pylist():
                    if load[0] == COPY:
                        c = unpack(load[1:], **cut_kinds)
                        rows += [(slot, pack(**{k: v[own] for k, v in c.items()})) for slot, own in by_slot(doc_slot(c, slots))]
                        if len(rows) >= 512:
                            yield from emit(rows)
                            rows = []
                    else:
                        loads.append(load[1:])
            if loads:
                x = gathered(loads, **PATH)
                loads.clear()
                kept, c = settle(x)
                rows += [(slot, pack(**{k: v[own] for k, v in c.items()})) for slot, own in by_slot(doc_slot(c, slots))]
                yield from records({"mh": x["mh"][kept].view("i8"), **{k: x[k][kept] for k in ("did", "th", "st", "nw")}}, ROW_TYPE)
            yield from emit(rows)

        return stored(self.docs.mapInArrow(chunk, ROWS).repartition(anchors, "slot").mapInArrow(join, ROWS), "stretches")

    def open(self, found: DataFrame) -> DataFrame:
        """Step 2: (mh, did, th, st, nw) of the stretches that share an anchor with others."""
        kept = found.where("mh is not null").select("mh", "did", "th", "st", "nw")
        shared = stored(kept.groupBy("mh").count().where("count > 1").select("mh"), "anchors")  # of known size, so that a few are broadcast
        return kept.join(shared, "mh", "left_semi")

    def spans(self, found: DataFrame) -> DataFrame:
        """Step 3: the copies of whole stretches."""
        kinds, sources = CUTS | SOURCES if self.sources else CUTS, self.sources

        def run(batches):
            loads = [x for b in batches for x in b.column("load").to_pylist()]
            if loads:
                yield from records(merged(gathered(loads, **kinds), sources), SPAN_TYPE)

        return found.where("load is not null").select("slot", "load").repartition(self.slots, "slot").mapInArrow(run, SPANS)

    def with_texts(self, rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """fn(documents, rows) for each document slot; rows have did and th."""
        slot = F.pmod(F.col("did").bitwiseXOR(F.col("th")), F.lit(self.slots)).cast("int")
        left = self.docs.withColumn("slot", slot).groupBy("slot")
        return left.cogroup(rows.withColumn("slot", slot).groupBy("slot")).applyInArrow(fn, schema)

    def removed(self, spans: DataFrame, result: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
        """Step 4: result(batch of documents, covered: mask over units, units' doc offsets) for each document slot."""
        units = self.units

        def finish(docs: pa.Table, rows: pa.Table) -> pa.Table:
            if not docs.num_rows:
                return arrow.empty_table()
            docs = docs.combine_chunks()
            c = {k: column(rows, k) for k in CUTS}
            order = np.lexsort([c["th"], c["did"]])
            c = {k: v[order] for k, v in c.items()}
            edge = np.flatnonzero(np.concatenate([[True], (c["did"][1:] != c["did"][:-1]) | (c["th"][1:] != c["th"][:-1]), [True]])) if len(order) else np.zeros(1, int)
            own = {(int(c["did"][a]), int(c["th"][a])): (a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())}
            out = []
            for batch in slices(docs.to_batches(), "text", 4 * CHUNK):
                covered, doc = units(batch.column("text"), covered=True)
                change = np.zeros(covered + 1, np.int32)
                for i, k in enumerate(zip(batch.column("did").to_pylist(), batch.column("th").to_pylist())):
                    if k in own:
                        a, b = own[k]
                        s = c["st"][a:b] + doc[i]
                        np.add.at(change, s, 1)
                        np.add.at(change, s + c["n"][a:b], -1)
                out.append(result(batch, np.cumsum(change[:-1]) > 0, doc))
            return pa.Table.from_batches(out, arrow)

        return self.with_texts(spans.select("did", "th", "st", "n"), finish, schema)


def column(rows: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, rows.schema.field(name).type.to_pandas_dtype()), *(np.asarray(c) for c in rows.column(name).chunks)])


def rows_of(docs: pa.Table, rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """(texts that rows name, each row's text among them); of equal documents one serves."""
    docs = docs.combine_chunks()
    key = {k: i for i, k in enumerate(zip(docs.column("did").to_pylist(), docs.column("th").to_pylist()))}
    row = np.array([key[k] for k in zip(column(rows, "did").tolist(), column(rows, "th").tolist())], np.int64)
    used, row = np.unique(row, return_inverse=True)
    return docs.column("text").take(pa.array(used)).combine_chunks(), row
