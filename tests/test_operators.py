"""Operators on hand-computed inputs, and properties of every method."""

import random

import pytest
from pyspark.sql import functions as F

from loghew.functions import text as X
from loghew.operators import divisive, events, graph, iplom, logsig, tagging, trees, truth
from loghew.plans.methods import METHODS, abstract
from loghew.sources import logs, sinks

LINES = [f"Jan 01 00:00:0{i % 10} host{i % 3} app: {m}" for i, m in enumerate(["open port 22", "open port 80", "close port 22 now", "close port 80 now", "user ann in", "user bob in"] * 3)]


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()[0]


def test_tokens(spark):
    assert one(spark, X.tokens("r"), r="  a b c\x1cd \t e ") == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("a,b,want", [("a b c", "a x c", 0.667), (" ".join("x" * 31), "x " * 0 + " ".join(["y"] * 30 + ["x"]), 0.002), ("a", "b", 0.0)])
def test_weighted_hamming(spark, a, b, want):
    assert one(spark, X.weighted_hamming(F.split("a", " "), F.split("b", " ")), a=a, b=b) == want


@pytest.mark.parametrize("word,want", [("22", "*"), ("eth0", "*"), ("a1", "*"), ("10.0.0.1", "*"), ("x=", "*"), ("foo", "foo"), ("ab12", "ab12"), ("'", "'")])
def test_generalize(spark, word, want):
    assert one(spark, X.generalize(F.col("w")), w=word) == want
    assert divisive.word_class(word) == want


def test_over_abstraction(spark):
    assert one(spark, X.over_abstracted(F.split("t", " ")), t="* * * a") and not one(spark, X.over_abstracted(F.split("t", " ")), t="* * a")


def test_asterisk(spark):
    rows = spark.createDataFrame([("g", ["a", "b", "c"]), ("g", ["a", "x", "c"]), ("h", ["a", "b"]), ("h", ["a", "b", "c"])], ["k", "t"])
    got = {r.k: r.template for r in events.asterisk(rows, ["k"], "t").collect()}
    assert got == {"g": "a * c", "h": "a b"}


def test_sql_functions(spark):
    X.register(spark)
    assert spark.sql("select weighted_hamming(array('a','b','c'), array('a','x','c'))").first()[0] == 0.667
    assert spark.sql("select pair_template(array('a','b'), array('a','c'))").first()[0] == ["a", "*"]
    assert [spark.sql(f"select generalize_word('{w}')").first()[0] for w in ("22", "eth0", "x=", "10.0.0.1", "foo", "ab12")] == ["*", "*", "*", "*", "foo", "ab12"]


def test_force_clusters_and_density(spark):
    ev = spark.createDataFrame([(i, 3) for i in range(4)], "event_id long, message_length int")
    e = spark.createDataFrame([(3, 0, 1, 0.8), (3, 1, 2, 0.75), (3, 2, 3, 0.7)], "message_length int, src long, dst long, weight double")
    assert sorted((r.event_id, r.cluster) for r in graph.clusters(ev, e).collect()) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    assert graph.density(ev, e).first().density == 0.5


def test_divide_two_triangles():
    import numpy as np

    w = np.zeros((6, 6))
    for a, b in [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]:
        w[a, b] = w[b, a] = 0.9
    w[2, 3] = w[3, 2] = 0.1
    assert sorted(map(sorted, divisive.divide(w))) == [[0, 1, 2], [3, 4, 5]]


def test_merging():
    groups = divisive.abstract([["open", "port", "22"], ["open", "port", "80"], ["open", "file", "foo"]])
    assert groups[0] == groups[1]


def test_prefix_tree():
    t = trees.PrefixTree()
    ids = [t.add(m.split()) for m in ("conn from a ok", "conn from b ok", "conn to c bad", "conn to d bad")]
    assert ids == [0, 0, 1, 1] and [" ".join(x) for x in t.templates] == ["conn from * ok", "conn to * bad"]


def test_prefix_tree_looks_under_the_star():
    t = trees.PrefixTree()
    assert [t.add(m.split()) for m in ("n1 up now ok", "host up now ok")] == [0, 0] and t.templates == [["*", "up", "now", "ok"]]
    assert t.lines() == [(0, "*"), (1, "* up now ok")]
    full = trees.PrefixTree(most=2)  # one token and the star
    assert [full.add(m.split()) for m in ("a x", "b x", "c y")] == [0, 1, 2] and full.children == {(): {"a", "*"}}
    deep = trees.PrefixTree(0.9, layers=2)
    assert [deep.add(m.split()) for m in ("a b 1", "a c 1", "a b 2")] == [0, 1, 2] and set(deep.leaves) == {("a", "b"), ("a", "c")}


def slow_prefix_tree(messages, similarity, most):
    """The published search, told as nested dictionaries: length, first token, templates."""
    root, out, templates = {}, [], []
    for words in map(str.split, messages):
        node = root.setdefault(len(words), {})
        leaf = node.get(words[0], node.get("*"))
        rated = [(sum(a == b != "*" for a, b in zip(templates[t], words)) / len(words), templates[t].count("*"), -t) for t in leaf or ()]
        if rated and max(rated)[0] >= similarity:
            t = -max(rated)[2]
            templates[t] = [a if a == b else "*" for a, b in zip(templates[t], words)]
        else:
            t = len(templates)
            templates.append(words)
            key = words[0]
            if key not in node and (any(c.isdigit() for c in key) or len(node) + ("*" not in node) >= most):
                key = "*"
            node.setdefault(key, []).append(t)
        out.append(t)
    return out


def varied(seed, n=300):
    rnd = random.Random(seed)
    forms = ["open port # by @", "close # now", "@ said # # to @", "retry retry @ #", "x # y @ z # w @", "# @"]
    return [" ".join(str(rnd.randrange(20)) if w == "#" else rnd.choice(["ann", "bob", "n1", "retry"]) if w == "@" else w for w in rnd.choice(forms).split()) for _ in range(n)]


def same_groups(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("similarity, most", [(0.5, 100), (0.4, 3), (0.7, 2)])
def test_drain_against_the_search(spark, similarity, most):
    lines = list(dict.fromkeys(varied(most)))
    ev = spark.createDataFrame(list(enumerate(lines)), "event_id long, message string").withColumn("message_length", F.size(F.split("message", " ")))
    got = {r.event_id: r.group for r in trees.drain(ev, similarity, most).collect()}
    assert same_groups([got[i] for i in range(len(lines))], slow_prefix_tree(lines, similarity, most))


def test_drain_patterns(spark):
    ev = spark.createDataFrame([(0, "a from 10.0.0.1", 3), (1, "a from 10.0.0.2", 3)], "event_id long, message string, message_length int")
    assert len({r.group for r in trees.drain(ev, 0.99, patterns=((r"[0-9.]+", "IP"),)).collect()}) == 1


def test_subsequences_of_repeated_words():
    s = trees.Subsequences()
    assert [s.add(m.split()) for m in ("a x y z", "a a a a", "a a a a", "a a b b")] == [0, 1, 1, 1]
    rnd = random.Random(2)
    lines = [[rnd.choice("abc") for _ in range(rnd.randint(1, 7))] for _ in range(150)]
    objects, want = [], []
    for w in lines:  # without any pruning
        found = [(len(trees.common_words(o, w)), -i) for i, o in enumerate(objects)]
        n, i = max(found, default=(0, 0))
        if n and n >= 0.5 * len(w):
            objects[-i] = trees.common_words(objects[-i], w)
            want.append(-i)
        else:
            objects.append(w)
            want.append(len(objects) - 1)
    s = trees.Subsequences()
    assert [s.add(w) for w in lines] == want


def slow_search(messages, k, group):
    """The potential, pair by pair, one line at a time."""
    from itertools import combinations

    group, pairs = list(group), [list(combinations(m.split(), 2)) for m in messages]
    while True:
        moved = False
        for i, p in enumerate(pairs):
            count = [{} for _ in range(k)]
            for g, q in zip(group, pairs):
                for x in q:
                    count[g][x] = count[g].get(x, 0) + 1
            size = [group.count(g) for g in range(k)]
            gains = [3 * sum(((count[g].get(x, 0) + 1) / (size[g] + 1)) ** 2 - (count[group[i]][x] / size[group[i]]) ** 2 for x in p) for g in range(k)]
            best = max(range(k), key=lambda g: gains[g])
            if gains[best] > 1e-9 and best != group[i] and gains[best] > gains[group[i]] + 1e-9:
                group[i], moved = best, True
        if not moved:
            return group


def test_search_against_the_potential():
    rnd = random.Random(6)
    messages = list(dict.fromkeys(varied(5, 40)))
    seeds = [rnd.randrange(4) for _ in messages]
    got = logsig.local_search(messages, [1] * len(messages), 4, seeds)
    assert got == slow_search(messages, 4, seeds)


def test_logmine_merges(spark):
    ev = spark.createDataFrame([(0, "open port 22 now", 4), (1, "open port 80 now", 4), (2, "user ann is in", 4), (3, "a b", 2)], "event_id long, message string, message_length int")
    got = {r.event_id: r.group for r in trees.logmine(ev, most=0.3, levels=1).collect()}
    assert got[0] == got[1] != got[2] and len(set(got.values())) == 3


def test_alignment_ties():
    """Of equal paths the diagonal, then a gap in the first sequence, then one in the second."""
    def best(a, b):
        score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                score[i][j] = max(score[i - 1][j - 1] + (10 if a[i - 1] == b[j - 1] else 1), score[i - 1][j], score[i][j - 1])
        i, j = max(((i, j) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1)), key=lambda p: (score[p[0]][p[1]], p))
        x, y = [], []
        while i and j:
            if score[i][j] == score[i - 1][j - 1] + (10 if a[i - 1] == b[j - 1] else 1):
                i, j = i - 1, j - 1
                x.append(a[i]), y.append(b[j])
            elif score[i][j] == score[i][j - 1]:
                j -= 1
                x.append("-"), y.append(b[j])
            else:
                i -= 1
                x.append(a[i]), y.append("-")
        return x[::-1], y[::-1]

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(1, 6))] for _ in range(2))
        assert trees.align(a, b) == best(a, b)


def test_weakest_sides_and_order(spark):
    e = spark.createDataFrame([(3, 0, 1, 0.9), (3, 1, 2, 0.8), (3, 0, 2, 0.7), (3, 2, 3, 0.1), (4, 0, 1, 0.5)], "message_length int, src long, dst long, weight double")
    assert {(r.src, r.dst, r.message_length) for r in graph.weakest_sides(e).collect()} == {(0, 1, 3), (1, 2, 3), (2, 3, 3), (0, 1, 4)}
    assert graph.pruned(e, 1).count() == 4
    assert [r.event_id for r in graph.by_degree(e).where("message_length = 3").orderBy("place").collect()] == [2, 0, 1, 3]
    ev = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "event_id long, x int")
    assert {r.event_id for r in graph.of_ids(ev, ev.where("event_id > 0")).collect()} == {1, 2}
    c = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "event_id long, cluster long")
    assert sorted(map(tuple, graph.cluster_of(graph.members(c)).collect())) == [(0, 0), (1, 0), (2, 2)]


def test_format_scan_numbers(spark):
    rows = spark.createDataFrame([(i, f"{'bad' if i % 3 == 0 else 'k: v' + str(i)}") for i in range(30)], "line_id long, raw string")
    got = logs.format_scan(rows, "<A>: <Content>", order=("line_id",), patterns=(("[0-9]+", "#"),)).collect()
    want = [i for i in range(30) if i % 3]
    assert {r.LineId: r.line_id for r in got} == dict(enumerate(want, 1)) and {r.Content_ for r in got} == {"v#"}


def test_iplom_parameters(spark):
    rows = spark.createDataFrame([(0, "a b c d"), (1, "x 1"), (2, "x 2"), (3, "y 3")], ["line_id", "message"])
    p = iplom.Parameters(longest=3)
    assert {r.line_id: r.part for r in iplom.step1(rows, p).collect()} == {0: "0", 1: "2", 2: "2", 3: "2"}
    assert {r.part for r in iplom.step2(iplom.step1(rows, iplom.Parameters(support=3)), iplom.Parameters(support=3)).collect()} == {"2", "4"}
    assert {r.line_id: r.part for r in iplom.step1(rows, iplom.Parameters(share=0.3)).collect()}[0] == "0"
    assert iplom.iplom(rows, p).count() == 4


def test_words_and_characters(spark):
    s = spark.createDataFrame([(0, ["ab", "c"]), (1, ["zz"])], ["sent_id", "words"])
    none = spark.createDataFrame([(0, "ab")], ["idx", "token"])
    assert {r.sent_id: r.ids for r in tagging.word_ids(s, none).collect()} == {0: [0, None], 1: [None]}
    chars = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "idx int, token string")
    got = {r.sent_id: (r.ids, r.lengths) for r in tagging.padded_characters(tagging.character_ids(s, chars)).collect()}
    assert got == {0: ([[1, 2], [3, 0]], [2, 1]), 1: ([[0, 0], [0, 0]], [0, 0])}


def test_character_ids_of_odd_words(spark):
    """Any code point, empty and null words, equal sentence ids, none at all; a sentence stays in its row, so nothing is shuffled."""
    rows = [(0, ["a\u00e9", "", "\U0001f600x\u4e2d"]), (0, [None, "?"]), (None, ["aa"]), (1, [])]
    s = spark.createDataFrame(rows, "sent_id long, words array<string>")
    chars = spark.createDataFrame([(5, "a"), (6, "\u00e9"), (7, "\u4e2d"), (8, "\U0001f600"), (9, "\x00"), (10, "xx")], "idx int, token string")
    got = tagging.character_ids(s, chars)
    assert sorted(((r.sent_id, r.ids) for r in got.collect()), key=str) == sorted([(0, [[5, 6], [], [8, 7]]), (0, [[], []]), (None, [[5, 5]]), (1, [])], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert {tuple(map(tuple, r.ids)) for r in tagging.character_ids(s, chars.limit(0)).collect()} == {((), (), ()), ((), ()), ((),), ()}
    seen = tagging.seen_characters(s).collect()
    assert {r.token for r in seen if r.token} == set("a\u00e9\U0001f600x\u4e2d?") and max(r.words for r in seen) == max(r.letters for r in seen) == 3
    most = spark.createDataFrame([(4, 3)], "words int, letters int")
    assert (5, 6, 0) in {tuple(r.ids[0]) for r in tagging.padded_characters(got, most=most).collect() if len(r.ids) == 4}


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 2\nb 3 4\n")
    vocab = spark.createDataFrame([(0, "b")], ["idx", "token"])
    assert {r.token for r in logs.vector_words(spark, str(tmp_path / "v.txt")).collect()} == {"a", "b"}
    logs.save_vectors(logs.trimmed_vectors(spark, str(tmp_path / "v.txt"), vocab), str(tmp_path / "saved"))
    assert [tuple(r) for r in logs.load_vectors(spark, str(tmp_path / "saved")).collect()] == [("b", [3.0, 4.0])]


def test_alignment_and_subsequence():
    assert trees.merged("a b c".split(), "a x c".split()) == ["a", "<*>", "c"]
    assert trees.common_words("a b c d".split(), "a x c d".split()) == ["a", "c", "d"]
    assert round(trees.distance("a b c".split(), "a b d".split()), 3) == 0.333


def test_iplom_removal_and_relation(spark):
    rows = spark.createDataFrame([(0, "from 10.0.0.12 ok")], ["line_id", "message"])
    assert iplom.step1(rows).first().tokens == ["from", "2", "ok"]
    rows = spark.createDataFrame([(0, "up eth0"), (1, "down eth0")], ["line_id", "message"])
    assert [r.n_rows for r in iplom.step4(iplom.step3(iplom.step2(iplom.step1(rows)))).collect()] == [2]


def test_logsig_signature(spark):
    rows = spark.createDataFrame([("g", 0, "a b c"), ("g", 1, "a b d"), ("g", 2, "a e c")], ["g", "line_id", "message"])
    assert logsig.signatures(rows, "g").first().signature == "a b c"


def test_fields(spark):
    f = events.assemble_fields(F.split(F.lit("t1 t2 msg a"), " "), F.split(F.lit("B-TIM I-TIM O O"), " "))
    assert [(x["name"], x["value"]) for x in spark.range(1).select(f.alias("f")).first().f] == [("TIM", "t1 t2"), ("message", "msg a")]


def test_chunks(spark):
    s = spark.createDataFrame([(0, ["B-TIM", "I-TIM", "O", "B-A", "B-A", "I-B"])], ["sent_id", "tags"])
    assert sorted((r.type, r.start, r.end) for r in tagging.chunks(s).collect()) == [("A", 3, 4), ("A", 4, 5), ("B", 5, 6), ("TIM", 0, 2)]


def test_remap_and_metrics(spark):
    gt = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "gt_id long, template string")
    pred = spark.createDataFrame([(0, "A", [0, 1]), (1, "X", [2, 3]), (2, "Y", [4])], "abstraction_id long, abstraction string, log_ids array<long>")
    ids = truth.remap(pred, gt)
    assert sorted(map(tuple, ids.collect())) == [(0, 0), (1, 3), (2, 4)]
    lines = pred.select("abstraction_id", F.explode("log_ids").alias("line_id")).join(ids, "abstraction_id").select("line_id", "new_id")
    r = truth.evaluate(spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (4, 2)], "line_id long, gt_id long"), lines).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.accuracy) == (2, 1, 2, 0.667, 0.5, 0.572)


def test_wordlist_conjunction(spark):
    rows = spark.createDataFrame([(0, "Alpha beta"), (1, "alpha"), (2, "zeta")], ["line_id", "raw"])
    assert [r.label_idx for r in truth.label_lines(rows, ["alpha &AND& beta", "alpha"]).orderBy("line_id").collect()] == [0, 1, -1]


def test_text_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("one\n\n  \ntwo\n")
    (tmp_path / "x.log").write_text("three\n")
    got = logs.read_logs(spark, str(tmp_path)).collect()
    assert sorted((r.line_id, r.raw) for r in got) == [(0, "one"), (0, "three"), (1, "two")] and len({r.source for r in got}) == 2


def test_format_compiler():
    headers, pattern = logs.compile_format("<A>: <B>")
    assert headers == ["A", "B"] and __import__("re").match(pattern, "x:  y z").groups() == ("x", "y z")


def test_sinks(spark):
    a = spark.createDataFrame([(0, "t *")], ["abstraction_id", "abstraction"])
    s = spark.createDataFrame([(0, 0), (1, 0)], ["line_id", "abstraction_id"])
    raw = spark.createDataFrame([(0, "t a"), (1, "t b")], ["line_id", "raw"])
    assert sorted(r.text for r in sinks.per_line(s, raw).collect()) == ["0; t a", "0; t b"]
    block = sinks.per_abstraction(a, s, raw).orderBy("abstraction_id", F.col("line_id").asc_nulls_last()).collect()
    assert [r.text for r in block] == ["Abstraction #0 t *", "0 t a", "1 t b", ""]


def test_comparison(spark):
    a = spark.createDataFrame([(0, "t * "), (1, "other")], ["abstraction_id", "abstraction"])
    gt = spark.createDataFrame([(0, "t *"), (1, " t *"), (2, "x")], ["gt_id", "template"])
    pairs = sinks.comparison(a, gt)
    assert sorted(tuple(r) for r in pairs.collect()) == [(0, "t * ", 1, " t *", "-----"), (1, "other", None, None, None)]
    raw = spark.createDataFrame([(0, "t a"), (1, "t b"), (2, "o")], ["line_id", "raw"])
    own = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], ["line_id", "abstraction_id"])
    rows = sinks.comparison_lines(pairs, spark.createDataFrame([(0, 0), (1, 1)], ["line_id", "gt_id"]), own, raw)
    got = [r.text for r in rows.orderBy(F.desc("matched"), "abstraction_id", "part", "line_id").collect()]
    assert got == ["Ground truth:  t *", "1 t b", "Prediction  : t * ", "0 t a", "1 t b", "-----", "No match prediction: other", "2 o"]


def test_structured_and_files(spark, tmp_path):
    a = spark.createDataFrame([(0, "t *")], ["abstraction_id", "abstraction"])
    s = spark.createDataFrame([(0, 0), (1, 0)], ["line_id", "abstraction_id"])
    raw = spark.createDataFrame([(0, "t a"), (1, "t b")], ["line_id", "raw"])
    import hashlib

    rows = sinks.structured(raw, s, a)
    assert {r.EventId for r in rows.collect()} == {hashlib.md5(b"t *").hexdigest()[:8]}
    assert {r.EventId for r in sinks.structured(raw, s, a, True).collect()} == {hashlib.md5(b"t   *").hexdigest()[:8]}
    assert sinks.occurrences(rows).first().Occurrences == 2
    sinks.write_csv(sinks.occurrences(rows), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["EventId", "EventTemplate", "Occurrences"]
    sinks.write_groups(sinks.group_line_numbers(s), str(tmp_path / "groups"), "abstraction_id")
    assert sorted((tmp_path / "groups" / "abstraction_id=0").glob("*.csv")) and sorted(r._c0 for r in spark.read.csv(str(tmp_path / "groups")).collect()) == ["1", "2"]
    v = spark.createDataFrame([(1, "b"), (0, "a")], ["idx", "token"])
    for _ in range(2):
        sinks.write_vocabulary(v, str(tmp_path / "words"))
    assert logs.vocabulary(spark, str(tmp_path / "words")) == {"a": 0, "b": 1}
    pairs = spark.createDataFrame([(["a", "longer"], ["tag", "x"])], ["w", "t"])
    assert tuple(sinks.aligned(pairs, "w", "t").first()) == ("a   longer", "tag x")


@pytest.mark.parametrize("method", METHODS)
def test_every_line_once_and_matching(spark, method):
    raw = spark.createDataFrame(list(enumerate(LINES)), ["line_id", "raw"])
    found, lines = abstract(raw, method, **({"k": 4} if method == "logsig" else {}))
    text = {r.abstraction_id: r for r in found.collect()}
    got = lines.collect()
    assert sorted(r.line_id for r in got) == list(range(len(LINES)))
    assert all(t in ("*", w) for r in got for t, w in zip(text[r.abstraction_id].abstraction.split(), LINES[r.line_id].split()))
    assert all(r.n_lines == sum(x.abstraction_id == i for x in got) for i, r in text.items())


@pytest.mark.parametrize("name", ["stream_templates", "stream_subsequences"])
def test_stream_equals_batch(spark, tmp_path, name):
    """Two batches of a stream, with state between them, give what one pass gives."""
    from loghew.streaming import templates as T

    rows = [("s", i, line.split(": ", 1)[1]) for i, line in enumerate(LINES)]
    for half, part in (("a", rows[:9]), ("b", rows[9:])):
        spark.createDataFrame(part, "source string, line_id long, message string").coalesce(1).write.parquet(str(tmp_path / "in" / half))
    stream = spark.readStream.schema("source string, line_id long, message string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = getattr(T, name)(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        got = {r.line_id: (r.length, r.template_id) for r in spark.table(name).collect()}
    finally:
        q.stop()
    by = {}
    for _, i, m in rows:
        by.setdefault(len(m.split()), []).append((i, m))
    for n, own in by.items():
        made = trees.PrefixTree() if name == "stream_templates" else trees.Subsequences()
        for i, m in own:
            assert got[i] == (n, made.add(m.split()))
