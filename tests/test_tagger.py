"""The tagger, the command line and experiments on small files."""

import itertools
import random

import numpy as np
import pytest

from loghew.__main__ import main
from loghew.operators import tagger
from loghew.plans import experiment


def sentences(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["Jan", str(rnd.randint(1, 28)), f"{rnd.randint(10, 23)}:00:{rnd.randint(10, 59)}", rnd.choice(["web", "db"]) + str(rnd.randint(1, 9)), rnd.choice(["sshd:", "cron:"]), *rnd.choice(["session opened for", "job done in", "failed password"]).split(), str(rnd.randint(1, 999))]
        out.append((words, ["B-TIM", "I-TIM", "I-TIM", "B-HOS", "B-SER", *["O"] * (len(words) - 6), "B-NUM"]))
    return out


@pytest.mark.parametrize("method, rate", [("adam", 0.05), ("adagrad", 0.3), ("sgd", 1.0), ("rmsprop", 0.02)])
def test_learns_tags(method, rate):
    made = tagger.learn(sentences(200, 1), tagger.Settings(method=method, rate=rate, features=1 << 12, epochs=6, clip=5.0))
    held = sentences(60, 2)
    got = made.predict([w for w, _ in held])
    assert sum(g == t for g, (_, t) in zip(got, held)) >= 58
    with pytest.raises(ValueError):
        tagger.learn(sentences(5, 1), tagger.Settings(method="none", features=64))


def test_viterbi_against_all_sequences():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (1, 2, 5):
        z, moves = rng.normal(size=(n, 3)), rng.normal(size=(4, 3))
        rate = lambda s: moves[0, s[0]] + sum(z[i, t] for i, t in enumerate(s)) + sum(moves[1 + a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
        assert tuple(tagger.viterbi(z, moves)) == max(itertools.product(range(3), repeat=n), key=rate)
    assert tagger.viterbi(np.zeros((0, 3)), moves) == []


def test_saved_tagger_splits_lines(spark, tmp_path):
    rows = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(sentences(150, 3))], "sent_id long, words array<string>, tags array<string>")
    made = tagger.fit(rows, tagger.Settings(features=1 << 12, epochs=5, sentences=100))
    tagger.save(spark, made, str(tmp_path / "t"))
    held = tagger.load(spark, str(tmp_path / "t"))
    lines = spark.createDataFrame([(0, "Jan 3 11:00:22 web4 sshd: failed password 17"), (1, ""), (2, None)], "line_id long, raw string")
    got = {r.line_id: r for r in tagger.split_by_tags(lines, held).collect()}
    assert got[0].message == "failed password" and got[0].entity_tokens == ["Jan", "3", "11:00:22", "web4", "sshd:", "17"]
    assert [f.name for f in got[0].fields] == ["TIM", "HOS", "SER", "message", "NUM"] and got[1].message == "" and got[1].entity_tokens == []


def files(folder):
    (folder / "logs").mkdir(parents=True)
    (folder / "wordlist").mkdir()
    (folder / "logs" / "auth.log").write_text("".join(f"Jan 01 00:00:{i + 10} h app: {m}\n" for i, m in enumerate(["open port 22", "open port 80", "user ann in now", "user bob in now"] * 3)))
    (folder / "logs" / "mail.log").write_text("".join(f"Jan 01 00:00:{i + 10} h app: sent to {x}\n" for i, x in enumerate("abcd")))
    (folder / "wordlist" / "auth.txt").write_text("open port\nuser\n")


def test_experiment(spark, tmp_path):
    files(tmp_path / "set")
    (tmp_path / "run.ini").write_text(f"[methods]\nmethod = drain\n[datasets]\ndataset = set\ndataset_path = {tmp_path}\n[experiments]\nresult_path = {tmp_path}/results\n")
    got = {r.filename: r for r in experiment.run_config(spark, str(tmp_path / "run.ini"))["drain/set"].collect()}
    assert set(got) == {"auth.log", "mail.log", "------"} and got["auth.log"].tp == 12 and got["auth.log"].accuracy == 1.0
    out = tmp_path / "results" / "drain" / "set"
    text = lambda p: [r.value for r in spark.read.text(str(out / p)).collect()]
    assert len(text("auth.log/perline")) == 12 and any(x.startswith("Ground truth: ") for x in text("auth.log/comparison"))
    assert spark.read.option("header", True).csv(str(out / "evaluation")).columns == ["filename", "tp", "fp", "fn", "precision", "recall", "accuracy"]


def test_command_line(spark, tmp_path, capsys):
    files(tmp_path)
    main(["-i", str(tmp_path / "logs" / "auth.log"), "--method", "drain"])
    said = capsys.readouterr().out.splitlines()
    assert [x.split("app: ")[1] for x in said] == ["open port *", "user * in now"] and said[0].startswith("#0 ")
    main(["-i", str(tmp_path / "logs"), "-o", str(tmp_path / "out"), "--method", "logsig", "--groups", "3"])
    assert spark.read.text(str(tmp_path / "out")).count() >= 2
    main([])
    assert "usage" in capsys.readouterr().out
