"""Byte-level BPE over many texts at once.

The texts of a batch are cut into pre-tokens by array operations on code points (the
splitting rule of byte-level BPE: contractions, words, numbers, other signs, each with one
space before it, and runs of white space); every distinct pre-token is encoded once by the
`tokenizers` library and its ids are gathered for all places. The tokenizer's added tokens are
cut out first and keep their own ids. Ids equal those of encoding each whole text.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .kernels import MULTIPLIERS, U, buffers, mix, segments

OTHER, LETTER, NUMBER, BLANK, UNKNOWN = range(5)
_classes = np.full(0x110000, UNKNOWN, np.uint8)
_blank = regex.compile(r"\s")


def classes(points: np.ndarray) -> np.ndarray:
    out = _classes[points]
    if (out == UNKNOWN).any():
        for p in np.unique(points[out == UNKNOWN]).tolist():
            kind = unicodedata.category(chr(p))[0]
            _classes[p] = BLANK if _blank.match(chr(p)) else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        out = _classes[points]
    return out


def pre_tokens(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where a pre-token starts; off: the documents' offsets."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(points)
    blank = kind == BLANK
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = edge[:-1], edge[1:]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= first
    after_space = np.zeros(n, bool)
    after_space[1:] = points[:-1] == 0x20
    after_space &= ~first
    start = new & (blank | ~after_space)
    leads = np.zeros(n, bool)  # the last blank of a run that text follows stands alone or joins that text
    leads[:-1] = blank[:-1] & ~blank[1:]
    start |= leads & ~last
    marks = np.flatnonzero(start & (points == 0x27))
    if len(marks):  # 's 't 'm 'd 're 've 'll split off from what follows
        stop = off[np.searchsorted(off, marks, "right")]
        one = np.where(marks + 1 < stop, points[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(marks + 2 < stop, points[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = short | long
        start[marks[hit] + 1] = False
        then = marks[hit] + np.where(short[hit], 2, 3)
        start[then[then < stop[hit]]] = True
    return np.flatnonzero(start)


#: Bytes encoded at once.
PIECE = 1 << 21
SHORT = 16
SLOT = np.dtype([("a", "u8"), ("b", "u8"), ("at", "u4"), ("count", "u2"), ("size", "u2")])


def byte_letters() -> np.ndarray:
    """The code point that stands for each byte in a byte-level vocabulary: its own if printable, else the next one from 256 on."""
    own = [0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD for b in range(256)]
    return np.array([b if own[b] else 256 + b - sum(own[:b]) for b in range(256)], "<u4")


BYTE_LETTERS = byte_letters()


def first_bytes(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """min(size, 8) bytes from each place as one number, zeros behind; raw is padded by eight."""
    word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))[at]
    return word & ~U(0) >> (U(8) * (U(8) - np.clip(size, 1, 8).astype(np.uint64)))


class Encoder:
    """ids(column) -> (ids, document offsets). most: distinct pre-tokens remembered."""

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = said["pre_tokenizer"] or {}
        if said["model"]["type"] != "BPE" or said["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.own = {"".join(map(chr, BYTE_LETTERS[list(t.encode())])): i for t, i in added.items()}
        self.split = self.tokenizer.model.tokenize
        self.most = most
        self.forget(most)

    def forget(self, most: int) -> None:
        self.table = np.zeros(1 << (2 * most - 1).bit_length(), SLOT)
        self.room, self.known = most, 0
        self.long: dict[bytes, tuple[int, int]] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, letters: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, number of ids) of pre-tokens that lie one after the other in `letters`, a sign for each byte."""
        ends = np.cumsum(sizes).tolist()
        words = [letters[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        got = [[self.own[w]] if w in self.own else [t.id for t in self.split(w)] for w in words]
        new = np.array([i for ids in got for i in ids], np.uint32)
        count = np.fromiter(map(len, got), np.int64, len(got))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(count) - count
        self.used += len(new)
        return at, count

    def find(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The table's slot of each pre-token; -1 for unknown ones."""
        last = len(self.table) - 1
        out, live, slot = np.full(len(a), -1), np.arange(len(a)), (h & U(last)).astype(np.int64)
        while len(live):
            held = self.table[slot]
            hit = (held["a"] == a[live]) & (held["b"] == b[live]) & (held["size"] == size[live])
            out[live[hit]] = slot[hit]
            go = ~hit & (held["size"] != 0)
            live, slot = live[go], slot[go] + 1 & last
        return out

    def insert(self, a, b, size, h, at, count) -> None:
        """Distinct pre-tokens, none of them known."""
        last = len(self.table) - 1
        live, slot = np.arange(len(a)), (h & U(last)).astype(np.int64)
        while len(live):
            free = np.flatnonzero(self.table["size"][slot] == 0)
            to, first = np.unique(slot[free], return_index=True)
            row = live[free[first]]
            held = np.empty(len(row), SLOT)
            held["a"], held["b"], held["size"], held["at"], held["count"] = a[row], b[row], size[row], at[row], count[row]
            self.table[to] = held
            rest = np.ones(len(live), bool)
            rest[free[first]] = False
            live, slot = live[rest], slot[rest] + 1 & last
        self.known += len(a)

    def short(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = first_bytes(raw, start, size)
        b = first_bytes(raw, start + np.maximum(size - 8, 0), size)
        h = mix(a * MULTIPLIERS[5] + mix(b * MULTIPLIERS[6] + size.astype(np.uint64)))
        slot = self.find(a, b, size, h)
        while len(miss := np.flatnonzero(slot < 0)):
            _, first = np.unique(h[miss], return_index=True)  # another pre-token of the same hash waits for the next round
            if self.known + len(first) > self.room:
                self.forget(max(self.most, 2 * len(first)))
                slot[:] = -1
                continue
            row = miss[first]
            letters = BYTE_LETTERS[raw[segments(start[row], size[row])]].tobytes().decode("utf-32-le")
            self.insert(a[row], b[row], size[row], h[row], *self.learn(letters, size[row]))
            slot[miss] = self.find(a[miss], b[miss], size[miss], h[miss])
        return self.table["at"][slot].astype(np.int64), self.table["count"][slot].astype(np.int64)

    def place(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, number of ids) of each pre-token."""
        wide = np.flatnonzero(size > SHORT)
        if not len(wide):
            return self.short(raw, start, size)
        near = np.flatnonzero(size <= SHORT)
        at, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        if self.used > 64 * self.most:
            self.forget(self.most)
        at[near], count[near] = self.short(raw, start[near], size[near])
        for i, s, n in zip(wide.tolist(), start[wide].tolist(), size[wide].tolist()):
            word = raw[s : s + n].tobytes()
            got = self.long.get(word)
            if got is None:
                x, c = self.learn(BYTE_LETTERS[raw[s : s + n]].tobytes().decode("utf-32-le"), np.array([n]))
                got = (int(x[0]), int(c[0]))
                if n <= 64 and len(self.long) < self.most // 4:
                    self.long[word] = got
            at[i], count[i] = got
        return at, count

    def added_places(self, text: str, off: np.ndarray) -> np.ndarray:
        """(start, end) of the added tokens in each document."""
        if self.added is None or not self.added.search(text):
            return np.zeros((0, 2), np.int64)
        spans = [m.span() for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in self.added.finditer(text, a, b)]
        return np.array(spans, np.int64).reshape(-1, 2)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids up to each offset) of texts given as bytes and offsets."""
        text = raw.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the first byte of each code point
        off = np.searchsorted(lead, off)
        places = self.added_places(text, off)
        start = pre_tokens(points, np.sort(np.concatenate([off, places.ravel()])))
        if len(places):  # an added token is one pre-token
            start = start[np.searchsorted(places[:, 0], start, "left") <= np.searchsorted(places[:, 1], start, "right")]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        first = lead[start]
        size = np.diff(np.append(first, len(raw)))
        at, count = self.place(np.concatenate([raw, np.zeros(8, np.uint8)]), first, size)
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.flat[segments(at, count)], ends[np.searchsorted(start, off)]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = buffers(column)
        if len(raw) <= PIECE:
            return self.encode(raw, off)
        # a space between two ASCII letters starts a pre-token, and no added token spans it
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        safe = np.flatnonzero((raw[1:-1] == 0x20) & letter[raw[:-2]] & letter[raw[2:]]) + 1
        if self.added is not None and any(" " in t for t in self.own):
            safe = safe[:0]
        out, ends, done, at = [], np.zeros(len(off), np.int64), 0, 0
        safe = np.union1d(safe, off[1:-1])
        while at < len(raw):
            i = np.searchsorted(safe, at + PIECE, "right") - 1
            if i < 0 or safe[i] <= at:
                i = np.searchsorted(safe, at, "right")
            to = int(safe[i]) if i < len(safe) and at + PIECE < len(raw) else len(raw)
            lo, hi = np.searchsorted(off, [at, to])
            inner = np.concatenate([[0], off[lo:hi] - at, [to - at]])
            ids, n = self.encode(raw[at:to], inner)
            ends[lo:hi] = done + n[1:-1]
            out.append(ids)
            done, at = done + len(ids), to
        ends[off == len(raw)] = done
        return np.concatenate(out), ends


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker process: what one task learned serves the next."""
    return Encoder(path)
