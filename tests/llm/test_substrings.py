"""Substring dedup on words and bytes, and the suffix sorter, against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from loghew.llm.byte_dedup import dedup_bytes
from loghew.llm import induced, kernels
from loghew.llm.induced import suffix_array
from loghew.llm import substring_dedup
from loghew.llm.substring_dedup import dedup_words

SCHEMA = "doc_id long, text string, did string"


def brute(rows, split, length):
    """{doc_id: (units, units kept, spans)}; rows: distinct ids."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    units = {d: split(t or "") for d, t in rows}
    seen, cut = set(), {d: set() for d in units}
    for d, u in units.items():
        for s in range(len(u) - length + 1):
            k = tuple(u[s : s + length])
            if k in seen:
                cut[d].update(range(s, s + length))
            seen.add(k)
    return {d: (u, [x for i, x in enumerate(u) if i not in cut[d]], sum(i in cut[d] and i - 1 not in cut[d] for i in range(len(u)))) for d, u in units.items()}


def cases():
    rnd = random.Random(5)
    words = [f"w{i}é" for i in range(60)]
    passage = " ".join(rnd.choices(words, k=70))
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 120)))) for i in range(30)]
    rows += [(100 + i, f"{' '.join(rnd.choices(words, k=9))}\t{passage[rnd.randint(0, 60):]}  {' '.join(rnd.choices(words, k=9))}") for i in range(25)]
    rows += [(200 + i, rows[3][1] + " x") for i in range(5)] + [(300, None), (301, ""), (None, passage), (302, "ha " * 400), (303, "a" * 900), (304, "ha " * 401)]
    rnd.shuffle(rows)
    return rows


def test_words_against_brute_force(spark):
    rows = cases()
    got = {r.doc_id: r for r in dedup_words(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()}
    want = brute(rows, lambda t: t.encode().split(), 20)
    assert got.keys() == want.keys()
    for d, (u, kept, _) in want.items():
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(u), len(u) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_bytes_against_brute_force(spark):
    rows = cases()
    got = {r.doc_id: r for r in dedup_bytes(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()}
    want = brute(rows, lambda t: t.encode(), 100)
    assert got.keys() == want.keys()
    for d, (u, kept, spans) in want.items():
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(u), len(u) - len(kept), spans, hashlib.sha256(bytes(kept)).hexdigest())


@pytest.mark.parametrize("fn", [dedup_words, dedup_bytes])
def test_empty_table_and_repeated_rows(spark, fn):
    assert fn(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"k{i}" for i in range(200))
    got = fn(spark.createDataFrame([(1, text, ""), (1, text, ""), (1, text + " z", ""), (2, text, "")], SCHEMA)).orderBy("doc_id", "n_removed").collect()
    assert [r.doc_id for r in got] == [1, 1, 1, 2]
    # two rows equal in id and text are one document; which of the id's two texts comes first, their hashes say
    assert got[-1].n_removed > 0 and [r.n_removed > 0 for r in got[:3]] in ([False, False, True], [False, True, True])
    firsts = {r.kept_sha256 for r in got if not r.n_removed}
    assert len(firsts) == 1


def sorted_as_they_should(texts, most, held, limit):
    joined = b"".join(t + b"\0" for t in texts)
    ends = [i for i, c in enumerate(joined) if not c]
    suffix = {i: joined[i:e] for e, a in zip(ends, [0, *[x + 1 for x in ends]]) for i in range(a, e)}
    order, lcp = suffix_array(np.frombuffer(joined, np.uint8), most, held, limit)
    assert sorted(order.tolist()) == sorted(suffix)
    got = [suffix[i][:most] for i in order.tolist()]  # what agrees so far may come in any order
    assert got == sorted(got)
    for k in range(1, len(got)):
        a, b = got[k - 1], got[k]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("held, limit, block", [(0, 2, 16), (60, 5, 7), (200, 20, 64), (1 << 20, 1 << 20, 1 << 18)])
def test_suffix_array(monkeypatch, held, limit, block):
    """Small limits make buckets, queues and levels of names go to disk many times over."""
    monkeypatch.setattr(induced, "BLOCK", block)
    rnd = random.Random(held)
    for _ in range(25):
        texts = [bytes(rnd.choices(b"ab!z"[: rnd.randint(1, 4)], k=rnd.randint(0, 80))) for _ in range(rnd.randint(1, 9))]
        sorted_as_they_should(texts + texts[:3], 20, held, limit)


def text_of(seed, n):
    rnd = random.Random(seed)
    words = [bytes(rnd.choices(b"abcdefghij ", k=rnd.randint(2, 9))) for _ in range(300)]
    return [b" ".join(rnd.choices(words, k=400)) for _ in range(n)]


def test_suffix_array_of_levels(monkeypatch):
    levels, order = [], induced.order
    monkeypatch.setattr(induced, "order", lambda names, *a: levels.append(names.n) or order(names, *a))
    monkeypatch.setattr(induced, "BLOCK", 1024)
    texts = text_of(1, 12)
    sorted_as_they_should(texts + texts[:4], 100, 50_000, 500)
    assert len(levels) >= 3 and all(b < 0.6 * a for a, b in zip(levels, levels[1:]))


def test_memory_does_not_grow_with_the_shard(monkeypatch):
    monkeypatch.setattr(induced, "BLOCK", 1 << 12)
    peaks = []
    for n in (12, 60):
        text = induced.Column(np.uint8)
        for t in text_of(n, n):
            text.append(np.frombuffer(t + b"\0", np.uint8))
        tracemalloc.start()
        rows = sum(len(at) for at, _ in induced.suffixes(text, 100, 1 << 16, 1 << 12))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == text.n - 116 - n
    assert peaks[1] < 2.5 * peaks[0]  # five times the text; the first still fits some bounds


def test_bytes_with_nul_against_brute_force(spark):
    rnd = random.Random(9)
    letters = "abcdefgh "
    passage = "".join(rnd.choices(letters, k=60)) + "\0" + "".join(rnd.choices(letters, k=50)) + "\0\0"
    rows = [(i, "".join(rnd.choices(letters, k=40)) + passage[rnd.randint(0, 9):] + "".join(rnd.choices(letters, k=40))) for i in range(25)]
    rows += [(50, passage), (51, "\0" * 300), (52, "\0" * 301 + "x"), (53, "\0")]
    got = {r.doc_id: r for r in dedup_bytes(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()}
    for d, (u, kept, spans) in brute(rows, lambda t: t.encode(), 100).items():
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(u), len(u) - len(kept), spans, hashlib.sha256(bytes(kept)).hexdigest())


@pytest.mark.parametrize("n", [64, 65, 127, 500, 640])
def test_window_argmin_beyond_its_places(monkeypatch, n):
    monkeypatch.setattr(kernels, "PLACE", 6)
    grams = np.random.Generator(np.random.PCG64(n)).integers(0, 40, n, dtype=np.uint64) << np.uint64(6)  # many equals
    for width in (1, 2, 9, 13):
        got = kernels.window_argmin(grams, width)
        assert got.tolist() == [i + int(np.argmin(grams[i : i + width])) for i in range(n - width + 1)]


def test_window_argmin_of_a_long_text():
    grams = np.random.Generator(np.random.PCG64(3)).integers(0, 2**63, (1 << 24) + 300, dtype=np.uint64)
    got = kernels.window_argmin(grams, 69)
    assert len(got) == len(grams) - 68 and got[-1] >= len(grams) - 69
    at = np.arange(len(got) - 400, len(got))
    assert got[at].tolist() == [i + int(np.argmin(grams[i : i + 69] >> np.uint64(24))) for i in at.tolist()]


def test_long_text_and_its_copy(spark):
    """A passage at the end of a text beyond 2**24 bytes comes again."""
    rnd = random.Random(8)
    passage = " ".join(f"p{rnd.random()}" for _ in range(60))
    long = " ".join(f"{i:x}{i * 7919 % 1000003:x}" for i in range(1_560_000)) + "! " + passage
    assert len(long) > 1 << 24
    rows = spark.createDataFrame([(1, long, ""), (2, "a b " + passage + " c", "")], SCHEMA)
    assert {r.doc_id: r.n_removed for r in dedup_bytes(rows).drop("kept").collect()} == {1: 0, 2: len(passage) + 1}  # the space before is equal as well
    assert {r.doc_id: r.n_removed for r in dedup_words(rows).drop("kept_text").collect()} == {1: 0, 2: 60}


def test_words_are_compared_before_they_go(spark, monkeypatch):
    """Hashes that all collide remove nothing but what is equal."""
    monkeypatch.setattr(substring_dedup, "ranges", lambda c, a, b: np.zeros(len(a), np.uint64))
    rows = [(i, " ".join(f"{'s' if j < 6 else f't{i}'}{j}" for j in range(40))) for i in range(6)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    assert all(r.n_removed == 0 for r in dedup_words(docs).collect())


def test_paths_of_the_graph(spark):
    """Edges a-b-c of two documents, which part after c: one path to there, cut at the node that branches."""
    edge = [("ab", "a", "b"), ("bc", "b", "c"), ("cd", "c", "d"), ("ce", "c", "e")]
    ids = {x: i for i, x in enumerate(sorted({x for r in edge for x in r}))}
    walks = {1: ["ab", "bc", "cd"], 2: ["ab", "bc", "ce"], 3: ["ab", "bc", "cd"], 4: ["ce"]}
    of = {r[0]: r for r in edge}
    rows = [(*(ids[x] for x in of[e]), d, 0, i) for d, w in walks.items() for i, e in enumerate(w)]
    got = substring_dedup.paths(spark.createDataFrame(rows, substring_dedup.EDGE)).collect()
    names = {i: x for x, i in ids.items()}
    assert {names[r.e]: (r.fdid, r.fst, r["head"]) for r in got} == {"ab": (1, 0, 0), "bc": (1, 1, 0), "cd": (1, 2, 2), "ce": (2, 2, 2)}
    spans = substring_dedup.walks(spark.createDataFrame(rows, substring_dedup.EDGE), substring_dedup.paths(spark.createDataFrame(rows, substring_dedup.EDGE)), 5).collect()
    assert sorted((r.did, r.st, r.n, r.fdid, r.fst) for r in spans) == [(2, 0, 6, 1, 0), (3, 0, 6, 1, 0), (3, 2, 5, 1, 2), (4, 0, 5, 2, 2)]
