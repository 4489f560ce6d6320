"""The corpus operators against brute force, round trips and held-out accuracy; odd tables for all."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loghew.llm import jpeg
from loghew.llm.fingerprints import fingerprint
from loghew.llm.html_text import Rules, extract, main_text
from loghew.llm.language import identify
from loghew.llm.mixing import mix_sources
from loghew.llm.near_dedup import near_groups
from loghew.llm.packing import cuts, pack
from loghew.llm.queries import tokenizer
from loghew.llm.secrets import find_secrets
from loghew.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None, "x", "y", "z") for d, t, lang, s in rows], DOCS)


def prose(seed, n, words="the of and to in is on by it or".split()):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) + rnd.choice(["", "a", "er", "ing", "tion"]) for _ in range(n))


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n ", "en", "a"), (4, "one", "en", None), (4, "one", "en", None), (None, "two words", None, "b"), (5, "x" * 30_000, "de", "b"), (6, prose(1, 3000), "en", "b")]
OPERATORS = {
    "near": lambda d: near_groups(d),
    "pack": lambda d: pack(d, tokenizer(), 64),
    "mix": lambda d: mix_sources(d),
    "fingerprint": lambda d: fingerprint(d),
    "secrets": lambda d: find_secrets(d),
    "media": lambda d: jpeg.media_digests(d),
    "language": lambda d: identify(d, per_label=20),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(spark, name):
    got = OPERATORS[name](table(spark, ODD)).collect()
    if name != "pack":
        assert len(got) == len(ODD)
    assert {r.doc_id for r in got} == {r[0] for r in ODD}
    assert OPERATORS[name](table(spark, [])).count() == 0


def jaccard_groups(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids, up = sorted(sets), {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("small", [2, 32])
def test_near_groups(spark, monkeypatch, small):
    monkeypatch.setattr("loghew.llm.near_dedup.SMALL", small)
    if small < 16:  # many blocks a family
        monkeypatch.setattr("loghew.llm.near_dedup.MEMBERS", 64)
        monkeypatch.setattr("loghew.llm.near_dedup.ASKING", 16)
    rnd, rows = random.Random(small), []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(120)]
        for copy in range(9):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
                w[rnd.randrange(120)] = f"x{rnd.random()}"
            rows.append((len(rows), " ".join(w).upper() if copy == 3 else " ".join(w)))
    got = near_groups(table(spark, [(d, t, "en", "a") for d, t in rows]), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard_groups(rows, 3, 85)


def test_encoder_equals_library():
    e = Encoder(tokenizer(), most=40)
    texts = ["", "don't 'tis 's's ''s I'll", "  a  b \n\n c\t\td  ", "x \n y", " 12ab３½ ²é", "日本語 テスト", "l'été d'un", "<|endoftext|> hi", "🙂 ok!!", prose(3, 200)]
    ids, off = e.ids(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    rows = [(i, prose(i, random.Random(i).randint(0, 400)), "en", "a") for i in range(60)]
    got = pack(table(spark, rows), tokenizer(), 256).collect()
    e = Encoder(tokenizer())
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for d, t, *_ in rows:
        pieces = sorted(by[d], key=lambda r: r.start)
        want = [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert [i for p in pieces for i in p.ids] == want and all(p.doc_tokens == len(want) for p in pieces)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sum(r.length for r in got) > 0.97 * 256 * len(sequences)
    assert sum(n for n, _ in cuts(5000, 1024, 1 / 64)) == 5000


def test_mixing(spark):
    rows = [(i, prose(i, random.Random(i).randint(1, 60)), "en", s) for i, s in enumerate(["a"] * 40 + ["b"] * 90 + ["c"] * 30 + [None] * 20)]
    got = mix_sources(table(spark, rows)).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += int(r["size"])
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    left, free, want = 1.5 * sum(size.values()), dict(zip(["a", "b", "c", None], [5, 2, 1, 5])), {}
    while free:
        part = left / sum(free.values())
        over = [s for s, w in free.items() if w * part > 2 * size[s]]
        for s in over or list(free):
            want[s] = 2 * size[s] if over else free[s] * part
        left -= sum(2 * size[s] for s in over)
        free = {s: w for s, w in free.items() if s in over} if not over else {s: w for s, w in free.items() if s not in over}
        if not over:
            break
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1 for s in size)
    again = mix_sources(table(spark, rows)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_secrets_places(spark):
    text = 'é 🙂 Password = "abcdef12" x token=abc api_key:\'ZZZZZZ9\' AKIA' + "A1" * 9 + " " + "0f" * 14 + " akia"
    rows = [(1, text, "en", "a"), (2, "token=sharedvalue", "en", "a"), (3, "token=sharedvalue", "en", "b"), (4, "token=sharedvalue", "en", "c"), (5, "key Ab3" + "xY7" * 8, "en", "c")]
    got = {r.doc_id: r for r in find_secrets(table(spark, rows)).collect()}
    want = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            want.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for rank, (kind, p, least) in enumerate([("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)], 1):
        want += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[0]) >= least]
    base = ",".join(w[2] for w in sorted(want))
    assert got[1].spans == base and got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex, got[2].n_copied, got[1].n_live) == (2, 1, 1, 1, 4)
    assert got[5].spans.startswith("owned:4:")


def test_jpeg_round_trip():
    rnd = np.random.Generator(np.random.PCG64(1))
    payloads = [np.full(64, 255, np.uint8), np.zeros(64, np.uint8), *(rnd.integers(0, 256, 64 * n, dtype=np.uint8) for n in (1, 2, 3, 7, 50, 300))]
    files = [jpeg.encode(p) for p in payloads]
    for p, (image, blocks) in zip(payloads, jpeg.decode(files)):
        assert jpeg.payload(image, blocks) == p.tobytes()
        assert jpeg.thumbnail(image, blocks).shape == (image.height // 8, image.width // 8)
    with pytest.raises(ValueError):
        jpeg.parse(b"no image")


def test_fingerprint_contract(spark):
    rows = [(i * 3, prose(i, 40 + i), "en", "a") for i in range(40)] + [(500, rows_text := prose(1, 41), "en", "a")]
    got = {r.doc_id: r for r in fingerprint(table(spark, rows)).collect()}
    order = sorted(rows)
    for i, (d, t, *_) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        cut = len(t) // 4
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and got[d].n_chars == len(t)
    assert got[500].fingerprint == got[3].fingerprint and rows_text


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><a href=x>Home</a></header><nav><a>m</a></nav>
<div class="cookie-notice">We use cookies on the site and that is all of it</div><article><h1>Head &amp; line</h1><p>First   part of
the story, and it is long enough to be told here in full.<p>Second<br>line &eacute;</p></article>
<section id="comments"><p>Nice one, I agree with all of it and then some.</p></section><footer>&copy; all</footer></body>"""


def test_html(spark):
    want = "Head & line\n\nFirst part of the story, and it is long enough to be told here in full.\n\nSecond line é"
    assert main_text(PAGE) == want and main_text(None) == main_text("") == main_text("<script>") == ""
    story = [" ".join(f"the tale of w{i}{j} and" for j in range(12)) for i in range(3)]
    plain = f"<div id=menu><ul><li><a>x</a><li><a>y</a></ul></div><div><h2>Title here</h2><p>{story[0]}</p><p>Short.</p><p>{story[1]}</p></div><div class=sidebar>{story[2]}</div>"
    assert main_text(plain) == f"Title here\n\n{story[0]}\n\nShort.\n\n{story[1]}"
    rows = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3), (None, "u", "<p", 3)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in extract(rows).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and got[2].text == "" and len(got) == 3
    assert extract(rows.limit(0)).count() == 0


def test_language_held_out(spark):
    words = {"en": "the of and thing with".split(), "de": "der und ung schaft mit".split(), "fr": "le et eau tion avec".split()}
    rows = [(i, prose(i, 60, words[c]), c, "a") for i, c in enumerate(["en", "de", "fr"] * 60)] + [(1000, "123 !!", "en", "a")]
    got = identify(table(spark, rows)).collect()
    truth = {d: c for d, _, c, _ in rows}
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert next(r for r in got if r.doc_id == 1000).lang_pred == "und"


def test_pipeline_stages(spark):
    words = {"en": "the of and thing with".split(), "de": "der und ung schaft mit".split()}
    rows = [(i, prose(i, 80, words[c]), c, s) for i, (c, s) in enumerate([("en", "a"), ("de", "b")] * 20)] + [(90, prose(0, 80, words["en"]), "en", "c"), (91, "...", "en", "a"), (92, None, None, None), (93, prose(93, 40, words["en"]) + " password=hunter2hunter2", "en", "a")]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, ""), name)
        left[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = lambda n: {r.doc_id for r in left[n]}
    assert ids("language") == {r[0] for r in rows} - {91, 92} and ids("near_duplicates") == ids("language") - {90}
    assert ids("secrets") == ids("near_duplicates") and "hunter2" not in next(r.text for r in left["secrets"] if r.doc_id == 93)
    assert sum(r.length for r in left["packing"]) == sum(r.doc_tokens for r in left["packing"] if r.start == 0)


def test_pipeline_redacts_live_values_only(spark):
    own, more = "Ab3" + "xY7" * 8, "Qr5" + "zT2" * 8
    rows = [
        (1, f"é 🙂 key {own} end", "en", "a"), (2, f"token=sharedvalue and password='hunter2hunter2' key {more}.", "en", "a"), (None, "x token=sharedvalue", "en", "b"),
        (None, f"y {own}", "en", "c"), (3, "token=sharedvalue", "en", "c"), (4, "secret: " + "0f" * 14 + "Z! AKIA" + "A1" * 9, "en", "a"), (5, None, "en", "a"),
    ]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.secrets(spark, docs, "").collect()
    want = [
        (1, "é 🙂 key [SECRET] end"), (2, "token=sharedvalue and password='[SECRET]' key [SECRET]."), (None, "x token=sharedvalue"),
        (None, "y [SECRET]"), (3, "token=sharedvalue"), (4, "secret: [SECRET]! [SECRET]"), (5, None),
    ]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (len(r.text) if "[SECRET]" in (r.text or "") else None) for r in got)


def test_pipeline_near_duplicates_of_shared_ids(spark):
    a, b, c, d, e = (prose(i, 90) for i in range(50, 55))
    rows = [(7, a, "en", "a"), (7, b, "en", "a"), (9, a + " x", "en", "b"), (10, b, "en", "c"), (None, c, "en", "a"), (None, d, "en", "b"), (None, d, "en", "c"), (11, d + " y", "en", "a"), (12, e, "en", "a"), (12, e, "en", "a")]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(7, a), (7, b), (None, c), (None, d), (12, e)], key=str)
    groups = near_groups(docs).collect()
    assert len(groups) == len(rows) and {r.doc_id: (r.component_id, r.kept) for r in groups if r.doc_id in (9, 10, 11)} == {9: (7, False), 10: (7, False), 11: (None, False)}


def test_html_names_are_hints():
    story = [" ".join(f"the tale of w{i}{j} and" for j in range(12)) for i in range(3)]
    whole = "\n\n".join(["T", *story])
    assert main_text(f"<div><h1 class='post-title'>T</h1>{''.join(f'<p>{s}</p>' for s in story)}</div>") == whole
    assert main_text(f"<div><h1>T</h1><p>{story[0]}</p><p class='text-muted'>{story[1]}</p><p>{story[2]}</p></div>") == whole
    assert main_text(f"<p class='text-a'>{story[0]}</p><p>Short.</p><p class='text-b'>{story[1]}</p>") == f"{story[0]}\n\nShort.\n\n{story[1]}"
    assert main_text(f"<div>{story[0]}</div><article><h1>T</h1><p>{story[1]}</p></article>") == f"T\n\n{story[1]}"


def test_encoder_knows_added_tokens():
    from tokenizers import Tokenizer

    e, fresh, end = Encoder(tokenizer()), Tokenizer.from_file(tokenizer()), "<|endoftext|>"
    texts = [f"a {end} hi", end, f"{end}{end}", f"a  {end}  b'{end}'s {end}", "a <|endof", "text|> b", f"x{end[:-1]}", f" {end}\n{end} \n", "plain", f"é🙂{end}日本 {end}"]
    ids, off = e.ids(pa.array(texts))
    assert ids[off[0] : off[1]].tolist() == [64, 220, 50256, 23105]
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_html_densities_decide():
    story = [" ".join(f"the tale of w{i}{j} and" for j in range(12)) for i in range(3)]
    bare = " ".join(f"kw{j} qx{j} zz{j}" for j in range(30))  # long, no stop words
    linked = f"<p><a href=u>{story[0]}</a></p>"
    page = f"<div class=sidebar><h1>T</h1><p>{story[0]}</p><p>Short.</p><p>{story[1]}</p></div><div><p>{bare}</p></div>{linked}"
    assert main_text(page) == f"T\n\n{story[0]}\n\nShort.\n\n{story[1]}"  # the name misleads: that container holds the prose
    assert main_text(page, Rules(links=9)) == f"T\n\n{story[0]}\n\nShort.\n\n{story[1]}\n\n{story[0]}"
    assert main_text(page, Rules(stop_low=0, stop_high=0)).split("\n\n")[-1] == bare
    assert main_text(page, Rules(stop_low=0.9, stop_high=0.9)) == "" and main_text(page, Rules(short=10**6)) == ""
    assert main_text(f"<div class=content>{bare}</div><div class=box><p>{story[0]}</p></div>") == story[0]  # as does a promising one
    assert main_text(f"<form id=page><h1>T</h1><p>{story[0]}</p><p>{story[2]}</p><nav>{story[1]}</nav></form>") == f"T\n\n{story[0]}\n\n{story[2]}"
    teasers = "<article><h2>One</h2></article>" * 2
    assert main_text(f"{teasers}<div><p>{story[0]}</p><p>{story[1]}</p></div>") == f"One\n\nOne\n\n{story[0]}\n\n{story[1]}"
    assert main_text(f"<p>{story[0]}</p><div class=comments>{' '.join(story * 3)}</div>") == story[0]
    table = "<p>aa | bb | cc | dd | ee | ff | gg | hh | ii | jj | kk | ll | mm | nn | oo | pp</p>"
    assert " | " in main_text(f"<article><p>{story[0]}</p>{table}<p>{story[1]}</p></article>")
    assert " | " not in main_text(f"<div><p>{story[0]}</p>{table}<p>{story[1]}</p></div>")
    assert main_text(f"<article><p>{story[0]}</p>{linked}</article>") == story[0]


def test_html_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", PAGE, "t", 1, 2), (1, "u", PAGE, "t", 1, 2), (None, None, None, None, None, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_blocks int, n_kept int")).collect()
    assert sorted(r.text for r in got) == ["", main_text(PAGE), main_text(PAGE)]
    long = "<article>" + "<p>the story of it and more</p>" * 30_000 + "</article>"
    assert main_text(long).count("the story") == 30_000


def test_secrets_of_many_repositories(spark):
    """One owner, but seven repositories: copied. The same value in two is live."""
    far, near = "Ab3" + "xY7" * 8, "Qr5" + "zT2" * 8
    rows = [(i, f"key {far} end", f"l{i}", "a") for i in range(7)] + [(10 + i, f"key {near} end", f"l{i}", "a") for i in range(2)]
    got = {r.doc_id: r for r in find_secrets(table(spark, rows)).collect()}
    assert all(got[i].spans == "" for i in range(7)) and all(got[10 + i].spans.startswith("owned:4:") and got[10 + i].found[0].repositories == 2 for i in range(2))


def test_secrets_of_a_text_with_very_many(spark):
    n = 60_000
    text = " ".join(f"é token=v{i:08d}" for i in range(n))
    began = time.time()
    got = find_secrets(table(spark, [(1, text, "en", "a")])).select("n_assign", "base_sha256").first()
    want = ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=v\d{8}", text))
    assert (got.n_assign, got.base_sha256) == (n, hashlib.sha256(want.encode()).hexdigest()) and time.time() - began < 60


def test_pivots_keep_expectations(spark):
    """Each of eight unequal items is settled at its words' share within four standard errors; the rest carries the others' mass."""
    from pyspark.sql import functions as F

    from loghew.llm.mixing import fold

    draws, rate, sizes = 20_000, 0.3, [3.0, 5.0, 8.0, 8.0, 13.0, 2.0, 9.0, 8.0]
    items = F.array(*(F.struct(F.lit(i).cast("long").alias("doc"), F.lit(s).alias("size"), F.lit(rate * s).alias("mass"), F.rand(40 + i).alias("u")) for i, s in enumerate(sizes)))
    folded = spark.range(draws).select(fold(items).alias("f"))
    words = folded.select(F.explode("f.done").alias("d")).select("d.doc", "d.words").union(folded.select("f.rest.doc", "f.rest.mass"))
    for r in words.groupBy("doc").agg(F.sum(F.col("words")).alias("w"), F.sum(F.col("words") ** 2).alias("w2")).collect():
        mean, want = r.w / draws, rate * sizes[r.doc]
        assert abs(mean - want) <= 4 * ((r.w2 / draws - mean**2) / draws) ** 0.5
    total = words.agg(F.sum("words")).first()[0]
    assert abs(total - draws * rate * sum(sizes)) < 1e-6 * total


def test_mixing_of_equal_rows_reruns(spark):
    rows = [(i % 7, "one two three four", "en", "a") for i in range(40)]
    docs = table(spark, rows).selectExpr("*", "monotonically_increasing_id() as extra")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    a, b = ({(r.extra, r.taken) for r in mix_sources(docs.repartition(n)).collect()} for n in (1, 4))
    assert a == b and len(a) == 40


def scalar_fingerprint(text, k=5, bins=256):
    """{bin: value} before densification, of one text, one shingle at a time."""
    from loghew.llm.kernels import MULTIPLIERS, U, Words, mix

    out = {}
    for h in Words(pa.array([text]), lower=True).shingles(k)[0]:
        low = int(mix(np.array([h * MULTIPLIERS[100]], np.uint64))[0] >> U(1))
        b = int(h >> U(32)) & (bins - 1)
        out[b] = min(out.get(b, low), low)
    return out


def test_fingerprints_against_a_scalar_version():
    from loghew.llm.fingerprints import likeness, sketch
    from loghew.llm.kernels import MULTIPLIERS, U, mix

    texts = [prose(i, n) for i, n in enumerate((6, 40, 200, 900))]
    got = sketch(pa.array(texts), 5, 256, 4)
    for row, text in zip(got, texts):
        held, codes = scalar_fingerprint(text), []
        for b in range(256):
            at, attempt = b, 0
            while at not in held:  # the first nonempty bin on this bin's walk
                attempt += 1
                at = int(mix(np.array([(b + 1) * int(MULTIPLIERS[101]) + attempt * int(MULTIPLIERS[102]) & 2**64 - 1], np.uint64))[0] % U(256))
            codes.append(int(mix(np.array([held[at]], np.uint64))[0]) & 15)
        assert row.tolist() == [codes[i] << 4 | codes[i + 1] for i in range(0, 256, 2)]
    rnd, off = random.Random(4), []
    for share in (0.0, 0.1, 0.3, 0.6, 1.0):
        a = [f"w{rnd.random()}" for _ in range(800)]
        b = a[: int(800 * (1 - share))] + [f"x{rnd.random()}" for _ in range(800 - int(800 * (1 - share)))]
        x, y = ({tuple(w[i : i + 5]) for i in range(796)} for w in (a, b))
        s = sketch(pa.array([" ".join(a), " ".join(b)]), 5, 256, 4)
        none = np.array([False])
        off.append(abs(likeness(s[:1], s[1:], none, none, 256, 4)[0] - len(x & y) / len(x | y)))
    assert max(off) < 0.13 and off[0] == 0  # four standard errors of 256 bins


def test_fingerprints_across_many_ranges(spark):
    rows = [(i * 3 % 101, prose(i, 20 + i % 13), "en", "a") for i in range(101)] + [(200, prose(9, 30), "en", "a")] * 5
    one = fingerprint(table(spark, rows).coalesce(1)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    many = fingerprint(table(spark, rows)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(many) == len(rows)
    order = sorted(rows)
    text = {d: (t, order[(i + 1) % len(order)][1]) for i, (d, t, *_) in enumerate(order)}
    for r in many:
        t, nxt = text[r.doc_id]
        cut = len(t) // 4
        if r.doc_id != 200:
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()


def bits(*codes):
    s = "".join(codes)
    s += "1" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")


def colour_jpeg(grey, width, height, interleaved=True):
    """4:2:0, flat blocks: grey is the luminance of each block, (down, across), in whole MCUs; categories 0 to 11 have four-bit codes."""
    dc = bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)])
    ac = bytes([0x10, 1, *[0] * 15, 0x00])

    def block(value, before):
        d = value - before
        size = abs(d).bit_length()
        return f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"

    down, across = grey.shape
    codes, last = [], 0
    order = [(y + j, x + i) for y in range(0, down, 2) for x in range(0, across, 2) for j in range(2) for i in range(2)] if interleaved else [(y, x) for y in range(-(-height // 8)) for x in range(-(-width // 8))]
    for n, (y, x) in enumerate(order):
        value = int(grey[y, x]) - 128
        codes.append(block(value, last))
        last = value
        if interleaved and n % 4 == 3:
            codes += [block(0, 0)] * 2
    s = jpeg.segment
    head = b"\xff\xd8" + s(0xE0, b"JFIF\0") + s(0xDB, b"\0" + bytes([8]) + b"\1" * 63) + s(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0") + s(0xC4, dc) + s(0xC4, ac)
    if interleaved:
        return head + s(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + bits(*codes) + b"\xff\xd9"
    n = -(-(-(-width // 2)) // 8) * -(-(-(-height // 2)) // 8)
    chroma = s(0xDA, b"\1\2\0\0\x3f\0") + bits(*[block(0, 0)] * n)
    return head + chroma + s(0xDA, b"\1\1\0\0\x3f\0") + bits(*codes) + b"\xff\xd9"


@pytest.mark.parametrize("interleaved", [True, False])
def test_jpeg_of_three_components(interleaved):
    rnd = np.random.Generator(np.random.PCG64(2))
    grey = rnd.integers(0, 256, (4, 6)).astype(np.uint8)
    image, blocks = jpeg.decode([colour_jpeg(grey, 41, 30, interleaved)])[0]
    assert (image.width, image.height) == (41, 30) and jpeg.payload(image, blocks) is None
    assert jpeg.thumbnail(image, blocks).tolist() == grey.tolist()


def test_damaged_media(spark):
    rnd = np.random.Generator(np.random.PCG64(3))
    whole = jpeg.encode(rnd.integers(0, 256, 64 * 9, dtype=np.uint8))
    cuts = [whole[:n] for n in (0, 1, 30, 60, 120, len(whole) - 30, len(whole) - 8, len(whole) - 2)]
    bent = [bytes([*whole[:i], whole[i] ^ 0xFF, *whole[i + 1 :]]) for i in (2, 25, 100, 110, 150, 170)]
    files = [whole, *cuts, *bent, None, whole, colour_jpeg(np.full((2, 2), 9, np.uint8), 16, 16)]
    rows = spark.createDataFrame([(i, 1, f) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in jpeg.read_media(rows).collect()}
    assert len(got) == len(files)
    fine = {0, len(files) - 2, len(files) - 1}
    for i, f in enumerate(files):
        r = got[i]
        if f is None:
            assert r.error is None and r.payload is None
        elif i in fine:
            assert r.error is None and r.feature and (r.payload is None) == (i == len(files) - 1)
        elif i <= len(cuts):
            assert r.error and r.payload is None and r.feature is None


def test_media_digests_of_texts(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x" * 64, "en", "a"), (4, "é🙂" * 50, "en", "a"), (5, "a" * 5000, "en", "a"), (6, "é🙂" * 50, "en", "a")]
    got = {r.doc_id: r for r in jpeg.media_digests(table(spark, rows)).collect()}
    for d, t, *_ in rows:
        own = (t or "").encode()
        held = own + b"\0" * (max(64, -(-len(own) // 64) * 64) - len(own))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(own), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]))
        media = jpeg.encode(np.frombuffer(held, np.uint8))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[4].feature == got[6].feature and got[1].feature == got[2].feature != got[5].feature


def test_sketches_screen_large_mixed_buckets(spark, monkeypatch):
    """One shared band, unlike documents and a few copies: every link is found, and no block's rows grow with its pairs."""
    monkeypatch.setattr("loghew.llm.near_dedup.BANDS", 1)
    monkeypatch.setattr("loghew.llm.near_dedup.ROWS", 1)
    monkeypatch.setattr("loghew.llm.near_dedup.SMALL", 2)
    rnd = random.Random(3)
    head = [f"h{i}" for i in range(30)]
    rows = [(i, " ".join(head + [f"x{rnd.random()}" for _ in range(20)])) for i in range(200)]
    rows += [(500 + i, t + f" z{i}") for i, t in rows[:40]]
    got = near_groups(table(spark, [(d, t, "en", "a") for d, t in rows]), 3, 85).collect()
    want = jaccard_groups(rows, 3, 85)
    same = sum(want[r.doc_id] == r.component_id for r in got)
    assert all(r.component_id in (r.doc_id, want[r.doc_id]) for r in got) and same >= 0.6 * len(got)  # one band of one row misses some by itself


def test_language_shortcut_and_gradients():
    """Fast is the network it abbreviates, and the gradients are those of the loss."""
    from loghew.llm import language

    rnd = np.random.Generator(np.random.PCG64(5))
    x = rnd.integers(0, 256, (90, language.WINDOW), dtype=np.uint8)
    y = rnd.integers(0, 3, 90)
    net = language.train(x, y, ["a", "b", "c"], steps=20)
    assert np.allclose(language.Fast(net).logits(x), language.forward(net, x)[0], atol=1e-4)
    net.tables = {w: t.astype(np.float64) for w, t in net.tables.items()}
    net.bias, net.dense, net.out = (v.astype(np.float64) for v in (net.bias, net.dense, net.out))
    params = [*(net.tables[w] for w in language.WIDTHS), net.bias, net.dense, net.out]
    grads = language.gradients(net, x, y)[1]
    for p, g in zip(params, grads):
        for i in np.argsort(-np.abs(g).ravel())[:4]:
            held, eps = p.flat[i], 1e-6
            p.flat[i] = held + eps
            up = language.gradients(net, x, y)[0]
            p.flat[i] = held - eps
            down = language.gradients(net, x, y)[0]
            p.flat[i] = held
            assert abs((up - down) / (2 * eps) - g.flat[i]) < 1e-3 * max(1e-2, abs(g.flat[i]))
