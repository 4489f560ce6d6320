"""Suffix and common-prefix arrays by external induced sorting.

The text is many strings, each ended by a 0; end marks count as distinct, ordered by place.
Text, positions, names, queues and results are files of the task, read and written by blocks,
so the memory in use depends on the bounds `held` and `limit`, not on the text. The steps:

1. the S* positions, local minima of the text's runs, are found block by block;
2. the S* substrings are named: a bucket of at most `limit` of them is sorted in memory,
   a larger one is dealt to smaller buckets on disk by its next sign;
3. unless all names differ, the string of names is itself sorted by induction (order()),
   level by level, until at most `limit` names are left, which are ranked in memory;
4. the sorted S* suffixes induce all L suffixes, ascending, and these all S suffixes,
   descending. Each priority queue is keyed by (first sign, order of induction): tuples of
   one sign leave in the order they came. On bytes a tuple holds a suffix and its
   common-prefix value with the tuple before it, which is 1 + the least value between
   their sources.

Only common prefixes up to `most` matter, so suffixes that agree beyond it may come in any order.
"""

from __future__ import annotations

import heapq
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np

U = np.uint64
BLOCK = 1 << 18


class Column:
    """An array in a file: appended to, then read as a view."""

    def __init__(self, kind):
        self.kind, self.n = np.dtype(kind), 0
        self.file = tempfile.TemporaryFile()

    def append(self, a: np.ndarray) -> None:
        np.ascontiguousarray(a, self.kind).tofile(self.file)
        self.n += len(a)

    def view(self) -> np.ndarray:
        self.file.flush()
        return np.asarray(np.memmap(self.file, self.kind, "r", shape=(self.n,))) if self.n else np.zeros(0, self.kind)

    def blocks(self) -> Iterator[np.ndarray]:
        v = self.view()
        for a in range(0, self.n, BLOCK):
            yield np.array(v[a : a + BLOCK])


class Store:
    """Tuples by range, in order of arrival; beyond `held` bytes in memory they wait in a file."""

    def __init__(self, ranges: int, held: int):
        self.held, self.now, self.file, self.size = held, 0, None, 0
        self.parts: list[list] = [[] for _ in range(ranges)]
        self.places = [array("q") for _ in range(ranges)]  # of the parts in the file: place and length
        self.taken = [0] * ranges

    def push(self, r: int, *columns: np.ndarray) -> None:
        self.parts[r].append(columns)
        self.now += sum(c.nbytes + 128 for c in columns)
        if self.now > self.held:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.size)
        for parts, places in zip(self.parts, self.places):
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)] if len(parts) > 1 else parts[0]
                self.kinds = [c.dtype for c in columns]
                places.extend((self.size, len(columns[0])))
                for c in columns:
                    np.ascontiguousarray(c).tofile(self.file)
                    self.size += c.nbytes
                parts.clear()
        self.now = 0

    def read(self, r: int, i: int) -> tuple[np.ndarray, ...]:
        at, n = self.places[r][2 * i : 2 * i + 2]
        self.file.seek(at)
        return tuple(np.fromfile(self.file, kind, n) for kind in self.kinds)

    def take(self, r: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The range's tuples, which leave the store, as many at once as wait and make a block; what is pushed meanwhile comes last."""
        while True:
            got, n = [], 0
            while n < BLOCK:
                if 2 * self.taken[r] < len(self.places[r]):
                    self.taken[r] += 1
                    got.append(self.read(r, self.taken[r] - 1))
                elif self.parts[r]:
                    got += self.parts[r]
                    self.now -= sum(c.nbytes + 128 for columns in self.parts[r] for c in columns)
                    self.parts[r] = []
                else:
                    break
                n = sum(len(columns[0]) for columns in got)
            if not got:
                return
            yield got[0] if len(got) == 1 else tuple(np.concatenate(c) for c in zip(*got))

    def look(self, r: int, backward: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """The range's tuples, which stay; backward: the last first, each part reversed."""
        held = list(self.parts[r])
        n = len(self.places[r]) // 2
        for i in range(n + len(held) - 1, -1, -1) if backward else range(n + len(held)):
            columns = self.read(r, i) if i < n else held[i - n]
            yield tuple(c[::-1] for c in columns) if backward else columns


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number; text is padded by at least eight."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))[at].astype(np.uint64)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes a and b, at most `most`; it ends before an end mark."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, most, 8):
        x, y = words_at(text, a[live] + k), words_at(text, b[live] + k)
        same = (x == y) & ((x - U(0x0101010101010101)) & ~x & U(0x8080808080808080) == 0)
        part = ~same
        who = live[part]
        for j in range(8):
            u, v = text[a[who] + k + j], text[b[who] + k + j]
            who = who[(u == v) & (u != 0)]
            out[who] += 1
        live = live[same]
        out[live] = k + 8
        if not len(live):
            break
    return np.minimum(out, most)


def refine(rank: np.ndarray, key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Split tied groups by key. rank: place of the group's first member; rows: all members of tied groups. Returns the rows still tied."""
    by = np.lexsort([key, rank[rows]])
    order, k = rows[by], key[by]
    r = rank[order]
    group = np.concatenate([[True], r[1:] != r[:-1]])
    new = group | np.concatenate([[True], k[1:] != k[:-1]])
    n = np.arange(len(order))
    place = r + n - np.maximum.accumulate(np.where(group, n, 0))
    rank[order] = place[np.maximum.accumulate(np.where(new, n, 0))]
    alone = new & np.concatenate([new[1:], [True]])
    return order[~alone]


def star_positions(text: np.ndarray, n: int) -> Column:
    """All end marks, and the starts of runs lower than both their neighbours."""
    out = Column(np.int64)
    starts, heads = np.zeros(0, np.int64), np.zeros(0, text.dtype)  # the last two runs so far
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        part = np.array(text[a:b])
        edge = np.ones(b - a, bool)
        edge[1:] = part[1:] != part[:-1]
        if a:
            edge[0] = part[0] != text[a - 1]
        new = np.flatnonzero(edge)
        starts, heads = np.concatenate([starts, new + a]), np.concatenate([heads, part[new]])
        low = (heads[1:-1] < heads[:-2]) & (heads[1:-1] < heads[2:]) & (heads[1:-1] != 0)
        out.append(np.sort(np.concatenate([starts[1:-1][low], np.flatnonzero(part == 0) + a])))
        starts, heads = starts[-2:], heads[-2:]
    return out


class Names:
    """Sorts and names the S* substrings of a text; each runs to the next S* sign, and of two where one starts the other the longer is smaller."""

    def __init__(self, text: np.ndarray, star: np.ndarray, most: int, limit: int):
        self.text, self.star, self.most, self.limit = text, star, most, limit
        self.bytes = text.dtype == np.uint8
        self.order, self.count = Column(np.int64), 0
        self.pairs = Store(-(-len(star) // BLOCK), 64 * limit)
        self.end = np.iinfo(np.int64).max
        self.sort()

    def left(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Signs of each substring from depth on; those beyond `most` don't count."""
        at = self.star[rows]
        size = self.star[np.minimum(rows + 1, len(self.star) - 1)] - at + 1
        size[self.text[at] == 0] = 1
        return np.minimum(size, self.most) - depth

    def sign(self, rows: np.ndarray, depth: int) -> np.ndarray:
        left = self.left(rows, depth)
        return np.where(left > 0, self.text[np.minimum(self.star[rows] + depth, len(self.text) - 1)].astype(np.int64), self.end)

    def emit(self, rows: np.ndarray, new: np.ndarray) -> None:
        """Substrings in order; new: its name differs from the one before."""
        names = self.count + np.cumsum(new)
        self.count = int(names[-1])
        self.order.append(rows)
        block = rows // BLOCK
        by = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(block[by]) != 0, [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = by[a:b]
            self.pairs.push(int(block[own[0]]), rows[own], names[own].astype(np.uint32))

    def in_memory(self, rows: np.ndarray, depth: int) -> None:
        n = len(rows)
        rank, tied = np.zeros(n, np.int64), np.arange(n)
        while len(tied):
            left = self.left(rows[tied], depth)
            if (left <= 0).all():
                break
            if self.bytes:
                w = words_at(self.text, np.minimum(self.star[rows[tied]] + depth, len(self.text) - 9))
                shift = (U(8) * (U(8) - np.clip(left, 0, 8).astype(np.uint64))) & U(63)
                key = np.where(left <= 0, ~U(0), np.where(left < 8, w | ((U(1) << shift) - U(1)), w))
            else:
                key = self.sign(rows[tied], depth)
            tied = refine(rank, key, tied)
            depth += 8 if self.bytes else 1
        by = np.argsort(rank, kind="stable")
        r = rank[by]
        self.emit(rows[by], np.concatenate([[True], r[1:] != r[:-1]]))

    def sort(self) -> None:
        n = len(self.star)
        if n <= self.limit:
            rows = np.arange(n)
            ends = self.text[self.star] == 0
            self.emit(rows[ends], np.ones(int(ends.sum()), bool))
            if not ends.all():
                self.in_memory(rows[~ends], 0)
            return
        todo = self.dealt((np.arange(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)), np.arange(0, n, max(1, n // 4096)), 0)
        while todo:
            store, r, n, depth, sign = todo.pop()
            blocks = (columns[0] for columns in store.take(r))
            if sign == 0 and depth == 1:  # end marks differ from each other
                for rows in blocks:
                    self.emit(rows, np.ones(len(rows), bool))
            elif sign == self.end or depth >= self.most:  # all equal
                for i, rows in enumerate(blocks):
                    new = np.zeros(len(rows), bool)
                    new[0] = i == 0
                    self.emit(rows, new)
            elif n <= self.limit:
                self.in_memory(np.concatenate(list(blocks)), depth)
            else:
                sample = np.concatenate([columns[0][:: max(1, n // 4096)] for columns in store.look(r)])
                todo += self.dealt(blocks, sample, depth)

    def dealt(self, blocks: Iterator[np.ndarray], sample: np.ndarray, depth: int) -> list[tuple[Store, int, int, int, int | None]]:
        """Smaller buckets, the last first: for each of some signs those that have it, and those between."""
        sample = np.sort(self.sign(sample, depth))
        signs = np.unique(sample[np.linspace(0, len(sample) - 1, 256).astype(int)])
        if depth == 0:
            signs = np.union1d(signs, [0])
        n = np.zeros(2 * len(signs) + 1, np.int64)
        store = Store(len(n), 64 * self.limit)
        for rows in blocks:
            k = self.sign(rows, depth)
            at = np.searchsorted(signs, k)
            to = 2 * at + (signs[np.minimum(at, len(signs) - 1)] == k)
            by = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(to[by]) != 0, [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                store.push(int(to[by[a]]), rows[by[a:b]])
                n[to[by[a]]] += b - a
        return [(store, t, int(n[t]), depth + t % 2, int(signs[t // 2]) if t % 2 else None) for t in np.flatnonzero(n)[::-1].tolist()]

    def string(self) -> Column:
        """The names in order of place, ended by 0."""
        out = Column(np.uint32)
        for a in range(0, len(self.star), BLOCK):
            part = np.zeros(min(BLOCK, len(self.star) - a), np.uint32)
            for rows, names in self.pairs.take(a // BLOCK):
                part[rows - a] = names
            out.append(part)
        out.append(np.zeros(1))
        return out


def sorted_stars(text: np.ndarray, n: int, most: int, held: int, limit: int) -> Iterator[np.ndarray]:
    """S* positions in order of their suffixes."""
    positions = star_positions(text, n)
    star = positions.view()
    names = Names(text, star, most, limit)
    rows = names.order.blocks() if names.count == len(star) else order(names.string(), most, held, limit)
    for block in rows:
        yield star[block]


def order(names: Column, most: int, held: int, limit: int) -> Iterator[np.ndarray]:
    """The positions of a string of names (the last, 0, only ends it) in order of their suffixes."""
    n, text = names.n, names.view()
    if n <= max(limit, 3):
        rank, tied, step = np.zeros(n, np.int64), np.arange(n), 1
        tied = refine(rank, np.array(text).astype(np.int64), tied)
        while len(tied):
            tied = refine(rank, rank[np.minimum(tied + step, n - 1)].copy(), tied)
            step *= 2
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        yield out[1:]
        return
    pick = np.sort(np.array(text[:: max(1, n // 65536)]).astype(np.int64))
    pick = pick[:: max(1, int(len(pick) * limit / (4 * n)))]
    often = pick[1:][pick[1:] == pick[:-1]]
    bounds = np.unique(np.concatenate([[0], pick, often + 1]))  # a frequent name is a range of its own
    large, small = Store(len(bounds), held), Store(len(bounds), held)

    def scan(seeds, down: bool, out: Store) -> None:
        queue = Store(len(bounds), held)
        now: dict[int, list] = {}
        heap: list[int] = []
        current = -1

        signs, places = [], []

        def leave(r: int) -> None:
            if signs:
                out.push(r, np.array(signs, np.uint32), np.array(places, np.int64))
                signs.clear()
                places.clear()

        def send(c: int, at: np.ndarray, seed: bool) -> None:
            prev = at[at > 0] - 1
            sign = text[prev].astype(np.int64)
            ok = (sign < c if seed else sign <= c) if down else sign >= c
            ok &= sign != 0
            prev, sign = prev[ok], sign[ok]
            r = np.searchsorted(bounds, sign, "right") - 1
            for x in np.unique(r).tolist():
                own = r == x
                if x == current:
                    for s, p in zip(sign[own].tolist(), prev[own].tolist()):
                        if s not in now:
                            now[s] = []
                            heapq.heappush(heap, -s if down else s)
                        now[s].append(p)
                else:
                    queue.push(x, sign[own].astype(np.uint32), prev[own])

        waiting = next(seeds, None)
        for r in range(len(bounds) - 1, -1, -1) if down else range(len(bounds)):
            alone = r + 1 < len(bounds) and bounds[r + 1] == bounds[r] + 1
            if alone:  # one name: its tuples pass through block by block
                c = int(bounds[r])
                for sign, at in queue.take(r):
                    out.push(r, sign, at)
                    send(c, at, False)
            else:
                current = r
                for sign, at in queue.take(r):
                    for s, p in zip(sign.tolist(), at.tolist()):
                        now.setdefault(s, []).append(p)
                heap[:] = [-s if down else s for s in now]
                heapq.heapify(heap)
            while True:
                lead = (-heap[0] if down else heap[0]) if heap else None
                here = waiting is not None and np.searchsorted(bounds, waiting[0], "right") - 1 == r
                if here and (lead is None or (waiting[0] > lead if down else waiting[0] < lead)):
                    send(waiting[0], waiting[1], True)
                    waiting = next(seeds, None)
                elif lead is not None:
                    own = now[lead]
                    done = 0  # what a name induces of itself is added, and sent in the next turn
                    while done < len(own):
                        at = np.array(own[done:], np.int64)
                        done = len(own)
                        send(lead, at, False)
                    signs += [lead] * len(own)
                    places += own
                    del now[lead]
                    heapq.heappop(heap)
                else:
                    break
                if len(signs) > BLOCK:
                    leave(r)
            leave(r)
            current = -1

    def by_sign(blocks):
        for at in blocks:
            sign = text[at]
            cut = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1], [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield int(sign[a]), at[a:b]

    def falling():
        for r in range(len(bounds) - 1, -1, -1):
            for _, at in large.look(r, backward=True):
                yield at

    scan(by_sign(sorted_stars(text, n, most, held, limit)), False, large)
    scan(by_sign(falling()), True, small)

    def one_range(r):
        """L suffixes of each name, then its S suffixes."""
        a, b = large.look(r), small.look(r, backward=True)
        if r + 1 < len(bounds) and bounds[r + 1] == bounds[r] + 1:
            yield from (at for _, at in a)
            yield from (at for _, at in b)
            return
        parts = [*a, *b]
        if parts:
            sign, at = (np.concatenate([p[i] for p in parts]) for i in range(2))
            yield at[np.argsort(sign, kind="stable")]

    for r in range(len(bounds)):
        yield from one_range(r)


def induce(text: np.ndarray, seeds: Iterator[tuple], down: bool, held: int, most: int) -> Store:
    """One scan over bytes: the suffixes of each byte, in the order of the scan (ascending for L, descending, with `down`, for S).

    seeds: (byte, suffixes, common prefixes, first of its byte) in that order.
    """
    queue, out = Store(256, held), Store(256, held)
    pending = np.zeros(256, np.uint8)

    def send(byte: int, at: np.ndarray, lcp: np.ndarray, seed: bool) -> None:
        before = np.minimum(pending, lcp.min())
        prev = np.maximum(at - 1, 0)
        sign = text[prev]
        ok = (at > 0) & (sign != 0) & ((sign < byte if seed else sign <= byte) if down else sign >= byte)
        row = np.flatnonzero(ok)
        if not len(row):
            pending[:] = before
            return
        to = sign[row]
        by = np.argsort(to, kind="stable")
        row, to = row[by], to[by]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        seen = np.append(lcp, np.uint8(255))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            c, r = int(to[a]), row[a:b]
            low = np.minimum.reduceat(seen, np.concatenate([[0], r + 1]))  # [0, r0], (r0, r1], ..., the rest
            got = low[:-1]
            got[0] = min(got[0], pending[c])
            before[c] = low[-1]
            queue.push(c, at[r] - 1, np.minimum(got, most - 1) + np.uint8(1))
        pending[:] = before

    waiting = next(seeds, None)
    for byte in range(255, 0, -1) if down else range(256):
        last = None
        for at, lcp in queue.take(byte):
            if last is None:
                lcp = lcp.copy()
                lcp[0] = 0
            out.push(byte, at, lcp)
            send(byte, at, lcp, False)
            last = at[-1:]
        while waiting is not None and waiting[0] == byte:
            _, at, lcp, first = waiting
            if first:
                lcp = lcp.copy()
                lcp[0] = 0 if last is None else common(text, last, at[:1], most)[0]
            send(byte, at, lcp, True)
            waiting = next(seeds, None)
    return out


def falling(store: Store, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A byte's tuples the other way round: a value belongs to the later of two."""
    carry = np.uint8(0)
    for at, lcp in store.look(byte, backward=True):
        yield at, np.concatenate([[carry], lcp[:-1]]).astype(np.uint8)
        carry = lcp[-1]


def suffixes(text: Column, most: int, held: int = 64 << 20, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffixes in order without the end marks, common prefix of each with the one before it, at most `most` <= 254).

    text: uint8, each string ended by 0, no byte 255. held: bytes of tuples a queue keeps in
    memory; limit: S* substrings or names sorted in memory at once.
    """
    n = text.n
    if not n:
        return
    text.append(np.zeros(most + 16))
    raw = text.view()

    def stars():
        previous, seen = None, -1
        for at in sorted_stars(raw, n, most, held, limit):
            lcp = np.zeros(len(at), np.uint8)
            lcp[1:] = common(raw, at[:-1], at[1:], most)
            if previous is not None:
                lcp[0] = common(raw, previous, at[:1], most)[0]
            previous = at[-1:]
            sign = raw[at]
            cut = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1], [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield int(sign[a]), at[a:b], lcp[a:b], int(sign[a]) != seen
                seen = int(sign[a])

    large = induce(raw, stars(), False, held, most)

    def down():
        for byte in range(255, 0, -1):
            for i, (at, lcp) in enumerate(falling(large, byte)):
                yield byte, at, lcp, i == 0

    small = induce(raw, down(), True, held, most)
    for byte in range(1, 256):
        last = None
        for at, lcp in large.look(byte):
            yield at, lcp
            last = at[-1:]
        for i, (at, lcp) in enumerate(falling(small, byte)):
            if i == 0:
                lcp[0] = 0 if last is None else common(raw, last, at[:1], most)[0]
            yield at, lcp


def suffix_array(strings: np.ndarray, most: int, held: int = 64 << 20, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """suffixes() of an array, as two arrays."""
    text = Column(np.uint8)
    text.append(strings)
    got = [*suffixes(text, most, held, limit), (np.zeros(0, np.int64), np.zeros(0, np.uint8))]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
