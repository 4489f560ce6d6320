"""Registered log queries over whole tables, against brute force on a small one."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from loghew.plans.queries import QUERIES, events, parsed, scored, tagged, templates, truth

TYPES = ["signup", "purchase", "error", "view", "click"]


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """More than 60 unique messages, of 3, 6 and 7 words."""
    d = str(tmp_path_factory.mktemp("logs"))
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i * 7 % 41, TYPES[i % 5], float(i * 37 % 500), "{}") for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def unique(spark, d):
    got = {r.event_id: r.message.split(" ") for r in events(spark, d).collect()}
    assert len(got) > 60
    return got


def pairs(ev):
    return {(a, b) for a in ev for b in ev if a < b and len(ev[a]) == len(ev[b])}


def test_hamming_expression_has_all_pairs(spark, logs):
    ev = unique(spark, logs)
    want = {(a, b) for a, b in pairs(ev) if any(x == y for x, y in zip(ev[a], ev[b]))}
    got = QUERIES["hamming_expression"](spark, logs).collect()
    assert len(got) == len(want) and {(r.src, r.dst) for r in got} == want
    edges = {(r.src, r.dst): r.weight for r in QUERIES["weighted_hamming_edges"](spark, logs).collect()}
    assert {(r.src, r.dst): r.weight for r in got} == edges


def test_merge_test_has_all_pairs(spark, logs):
    ev = unique(spark, logs)
    got = QUERIES["merge_test"](spark, logs).collect()
    assert len(got) == len(pairs(ev))
    assert {(r.event_id, r.other): r.template for r in got} == {(a, b): "|".join(x if x == y else "*" for x, y in zip(ev[a], ev[b])) for a, b in pairs(ev)}


def test_gt_id_remap_knows_all_truth(spark, logs):
    own = defaultdict(list)
    for r in truth(spark, logs).collect():
        own[r.template].append(r.gt_id)
    found = {r.abstraction_id: r.abstraction.rstrip(" ") for r in templates(spark, logs).collect()}
    fresh = iter(range(sum(map(len, own.values())), 10**6))
    want = {i: max(own[t]) if t in own else next(fresh) for i, t in sorted(found.items())}
    assert {r.abstraction_id: r.new_id for r in QUERIES["gt_id_remap"](spark, logs).collect()} == want
    assert any(t in own for t in found.values())


def test_evaluation_of_templates(spark, logs):
    """The metrics by hand from lines, true groups and remapped templates, in all and for each service."""
    gt, pred = scored(spark, logs)
    of = {r.line_id: r.gt_id for r in gt.collect()}
    to = {r.line_id: r.new_id for r in pred.collect()}
    assert of.keys() == to.keys() == set(range(300))

    def by_hand(lines):
        tp = fp = fn = 0
        for g in {of[i] for i in lines}:
            own = [i for i in lines if of[i] == g]
            ids = {to[i] for i in own}
            if g in {to[i] for i in lines}:
                tp += len(own)
            elif len(ids) == 1:
                fp += len(own)
            else:
                fn += len(own)
        return tp, fp, fn

    r = QUERIES["eval_metrics"](spark, logs).first()
    assert (r.tp, r.fp, r.fn) == by_hand(set(of))
    got = {r.filename: (r.tp, r.fp, r.fn) for r in QUERIES["evaluation_table"](spark, logs).collect()}
    services = defaultdict(set)
    for r in parsed(spark, logs).collect():
        services[r.entity_tokens[4]].add(r.line_id)
    assert got == {s: by_hand(lines) for s, lines in services.items()} | {"------": (None, None, None)}


def test_word_ids_keep_every_word(spark, logs):
    own = {r.sent_id: ["$NUM$" if w.isdigit() else w.lower() for w in r.words] for r in tagged(spark, logs).collect()}
    most, vocab = max(map(len, own.values())), sorted({"$UNK$", *(w for words in own.values() for w in words)})
    got = {r.sent_id: r for r in QUERIES["word_ids"](spark, logs).collect()}
    assert got.keys() == own.keys() and {len(w) for w in own.values()} == {8, 11, 12}
    for i, words in own.items():
        ids = [vocab.index(w) for w in words]
        assert got[i].length == len(words) and got[i].ids == "|".join(map(str, ids + [0] * (most - len(ids))))


def test_character_ids_move_no_characters(spark, logs):
    """By hand; sentences are not dealt out: what is shuffled is the sizes alone."""
    own = {r.sent_id: r.words for r in tagged(spark, logs).collect()}
    vocab = sorted({c for words in own.values() for w in words for c in w})
    words, letters = max(map(len, own.values())), max(len(w) for x in own.values() for w in x)
    df = QUERIES["character_ids"](spark, logs)
    got = {r.sent_id: (r.ids, r.lengths) for r in df.collect()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert got.keys() == own.keys()
    for i, x in own.items():
        x = x + [""] * (words - len(x))
        assert got[i] == ("|".join(",".join(str(n) for n in [*map(vocab.index, w), *[0] * (letters - len(w))]) for w in x), "|".join(str(len(w)) for w in x))
