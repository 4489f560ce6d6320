"""numpy kernels over the bytes of many texts at once: words, hashes, minimizers.

Texts come as one byte buffer with offsets (an Arrow string column), so no Python
object is made per document or word. Hashes are 64 bit: polynomial prefix sums over
random byte codes, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
MULTIPLIERS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)

#: ASCII white space: the separators of words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums C of a sequence of 64-bit codes, so that any range's hash is a difference."""
    out = np.zeros(len(codes) + 1, np.uint64)
    up, _ = powers(len(codes) + 1)
    np.cumsum(codes * up[:-1], out=out[1:])
    return out


def ranges(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of the sequence behind c; its length counts too."""
    _, down = powers(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def segments(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, in batches of about size bytes of the column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of many texts: byte ranges, hashes and each document's range of words."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, off = buffers(column)
        self.raw, self.off = raw, off
        n = len(raw)
        gap = SPACE[raw]
        first, last = ~gap, ~gap
        if n:
            edge = np.zeros(n + 1, bool)
            edge[off] = True  # a document ends where the next starts
            first[1:] &= gap[:-1] | edge[1:-1]
            last[:-1] &= gap[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, off)  # words of document d: doc[d] to doc[d + 1]
        self.hash = ranges(prefix(BYTE_CODE[LOWER[raw] if lower else raw]), self.start, self.end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, each document's offsets): k-word shingles; a shorter text counts whole, an empty one not at all."""
        h, doc = self.hash, self.doc
        counts = np.diff(doc)
        grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            grams += h[j : j + len(grams)] * MULTIPLIERS[j]
        grams = mix(grams)
        short = (counts > 0) & (counts < k)
        sizes = np.where(short, 1, np.maximum(0, counts - k + 1))
        off = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(off[-1]) + np.repeat(doc[:-1] - off[:-1], sizes)
        out = grams[np.minimum(at, max(0, len(grams) - 1))] if len(grams) else np.zeros(len(at), np.uint64)
        if short.any():
            c = prefix(h)
            d = np.flatnonzero(short)
            out[off[d]] = ranges(c, doc[d], doc[d + 1])
        return out, off


def sets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment, and their offsets."""
    n = len(off) - 1
    out = hashes.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[off[:-1][off[:-1] < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[off] if n else np.zeros(1, np.int64)


#: Low bits of a value that hold its place in window_argmin.
PLACE = 24


def window_argmin(grams: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the least value among grams[i : i + width]; the leftmost of equals.

    The bits of a value above the lowest PLACE order it. More than 2**PLACE values go in
    blocks that overlap by width - 1.
    """
    n, most = len(grams), 1 << PLACE
    if n > most:
        return np.concatenate([window_argmin(grams[a : a + most], width) + a for a in range(0, n - width + 1, most - width + 1)])
    low = U(most - 1)
    m = (grams & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    return (m & low).astype(np.int64)
