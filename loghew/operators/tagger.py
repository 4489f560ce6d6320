"""A trainable tagger for the fields of log lines: hashed word features, a softmax over tags, tag transitions.

Training runs in numpy on a bounded number of tagged sentences; prediction runs in Arrow
batches over any number of lines, with the best sequence by Viterbi or the best tag of each word.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .events import assemble_fields

SHAPES = ((re.compile(r"[A-Z]+"), "A"), (re.compile(r"[a-z]+"), "a"), (re.compile(r"\d+"), "0"))


@dataclass(frozen=True)
class Settings:
    """Training: sentences is the bound on what is collected; patience counts epochs without a better score before the end."""

    sentences: int = 20_000
    features: int = 1 << 16
    epochs: int = 15
    batch: int = 20
    method: str = "adam"  # adam, adagrad, sgd, rmsprop
    rate: float = 0.05
    decay: float = 0.9
    clip: float = -1.0  # greatest norm of a step's gradient; below 0: none
    patience: int = 3
    transitions: bool = True
    held_out: float = 0.1
    seed: int = 1


@dataclass
class Tagger:
    tags: list[str]
    weights: np.ndarray  # features x tags
    moves: np.ndarray  # log odds of a tag after another; row 0: at the start
    settings: Settings

    def scores(self, sentences: list[list[str]]) -> list[np.ndarray]:
        return [self.weights[features(w, self.settings.features)].sum(axis=1) if w else np.zeros((0, len(self.tags))) for w in sentences]

    def predict(self, sentences: list[list[str]]) -> list[list[str]]:
        pick = (lambda z: viterbi(z, self.moves)) if self.settings.transitions else (lambda z: z.argmax(axis=1))
        return [[self.tags[i] for i in pick(z)] for z in self.scores(sentences)]


def shape(word: str) -> str:
    for pattern, sign in SHAPES:
        word = pattern.sub(sign, word)
    return word[:12]


def features(words: list[str], size: int) -> np.ndarray:
    """A row of hashed features for each word: itself, its shape, ends and neighbours, its place."""
    low = ["$NUM$" if w.isdigit() else w.lower() for w in words]
    around = ["<s>", *low, "</s>"]
    shapes = ["<s>", *map(shape, words), "</s>"]
    rows = []
    for i, w in enumerate(low):
        own = (f"w={w}", f"p={w[:3]}", f"e={w[-3:]}", f"s={shapes[i + 1]}", f"l={around[i]}", f"r={around[i + 2]}", f"ls={shapes[i]}", f"rs={shapes[i + 2]}", f"i={min(i, 9)}", f"is={min(i, 9)}{shapes[i + 1]}")
        rows.append([zlib.crc32(f.encode()) % size for f in own])
    return np.array(rows, np.int64).reshape(len(words), -1)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best sequence of tags; moves: (1 + tags, tags), row 0 for the start."""
    if not len(scores):
        return []
    best, back = scores[0] + moves[0], []
    for z in scores[1:]:
        every = best[:, None] + moves[1:]
        back.append(every.argmax(axis=0))
        best = every.max(axis=0) + z
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def learn(sentences: list[tuple[list[str], list[str]]], settings: Settings = Settings()) -> Tagger:  # noqa: B008
    """Softmax regression by minibatches, with a falling rate; the weights of the best held-out accuracy are kept."""
    rng = np.random.Generator(np.random.PCG64(settings.seed))
    tags = sorted({t for _, ts in sentences for t in ts})
    place = {t: i for i, t in enumerate(tags)}
    rows = [(features(w, settings.features), np.array([place[t] for t in ts], np.int64)) for w, ts in sentences if w]
    moves = np.ones((1 + len(tags), len(tags)))
    for _, y in rows:
        moves[0, y[0]] += 1
        np.add.at(moves, (y[:-1] + 1, y[1:]), 1)
    moves = np.log(moves / moves.sum(axis=1, keepdims=True))
    order = rng.permutation(len(rows))
    cut = max(1, int(settings.held_out * len(rows)))
    dev, train = order[:cut], order[cut:] if len(order) > cut else order
    net = Tagger(tags, np.zeros((settings.features, len(tags))), moves, settings)
    first, second = np.zeros_like(net.weights), np.zeros_like(net.weights)
    kept, top, idle, rate, step = net.weights.copy(), -1.0, 0, settings.rate, 0

    def accuracy() -> float:
        z = [(net.weights[rows[i][0]].sum(axis=1), rows[i][1]) for i in dev]
        hit = sum(int((np.array(viterbi(s, moves) if settings.transitions else s.argmax(axis=1)) == y).sum()) for s, y in z)
        return hit / max(1, sum(len(y) for _, y in z))

    for _ in range(settings.epochs):
        rng.shuffle(train)
        for a in range(0, len(train), settings.batch):
            x = np.concatenate([rows[i][0] for i in train[a : a + settings.batch]])
            y = np.concatenate([rows[i][1] for i in train[a : a + settings.batch]])
            z = net.weights[x].sum(axis=1)
            d = np.exp(z - z.max(axis=1, keepdims=True))
            d /= d.sum(axis=1, keepdims=True)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            used, where = np.unique(x, return_inverse=True)
            g = np.zeros((len(used), len(tags)))
            np.add.at(g, where.reshape(x.shape).ravel(), np.repeat(d, x.shape[1], axis=0))
            norm = np.sqrt((g * g).sum())
            if 0 <= settings.clip < norm:
                g *= settings.clip / norm
            step += 1
            net.weights[used] -= rate * update(settings.method, g, first, second, used, step)
        score = accuracy()
        rate *= settings.decay
        if score >= top:
            kept, top, idle = net.weights.copy(), score, 0
        else:
            idle += 1
            if idle >= settings.patience:
                break
    net.weights = kept
    return net


def update(method: str, g: np.ndarray, first: np.ndarray, second: np.ndarray, used: np.ndarray, step: int) -> np.ndarray:
    """A step's direction for the rows used; the optimiser's memory is changed in place."""
    if method == "sgd":
        return g
    if method == "adagrad":
        second[used] += g * g
        return g / (np.sqrt(second[used]) + 1e-8)
    if method == "rmsprop":
        second[used] = 0.9 * second[used] + 0.1 * g * g
        return g / (np.sqrt(second[used]) + 1e-8)
    if method == "adam":
        first[used] = 0.9 * first[used] + 0.1 * g
        second[used] = 0.999 * second[used] + 0.001 * g * g
        return first[used] / (1 - 0.9**step) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-8)
    raise ValueError(f"unknown optimiser {method}")


def fit(sentences: DataFrame, settings: Settings = Settings()) -> Tagger:  # noqa: B008
    """A tagger of (sent_id, words, tags), from at most settings.sentences of them, those of the least hashes."""
    drawn = sentences.select("words", "tags").orderBy(F.xxhash64("words", "tags"), F.array_join("words", " ")).limit(settings.sentences)
    return learn([(r.words, r.tags) for r in drawn.collect()], settings)


def tag(sentences: DataFrame, tagger: Tagger) -> DataFrame:
    """sentences (with words) and their tags, in Arrow batches."""
    columns = [c for c in sentences.columns if c != "tags"]
    rows = sentences.select(*columns)

    def run(batches):
        for batch in batches:
            got = tagger.predict([w or [] for w in batch.column("words").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.string()))], names=[*batch.schema.names, "tags"])

    from pyspark.sql.types import ArrayType, StringType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("tags", ArrayType(StringType())))


def split_by_tags(logs: DataFrame, tagger: Tagger, names: Column | None = None) -> DataFrame:
    """logs (line_id, raw) with tokens, fields, entity_tokens and message, as tagged; names: a map from tag to field name."""
    rows = tag(logs.withColumn("words", tokens("raw")), tagger).withColumnRenamed("words", "tokens")
    pairs = F.zip_with("tokens", "tags", lambda w, t: F.struct(w.alias("w"), t.alias("t")))
    part = lambda other: F.transform(F.filter(pairs, lambda p: (p["t"] != "O") if other else (p["t"] == "O")), lambda p: p["w"])
    plain = F.transform("tags", lambda t: F.regexp_replace(t, "^[BI]-", ""))
    named = plain if names is None else F.transform(plain, lambda t: F.coalesce(F.element_at(names, t), t))
    return rows.withColumn("entity_tokens", part(True)).withColumn("message", F.array_join(part(False), " ")).withColumn("fields", assemble_fields(F.col("tokens"), named)).drop("tags")


def save(spark: SparkSession, tagger: Tagger, path: str) -> None:
    """One row with all weights: any file system that Spark writes to will do."""
    held = io.BytesIO()
    used = np.flatnonzero(np.abs(tagger.weights).sum(axis=1))
    np.savez_compressed(held, used=used, weights=tagger.weights[used].astype(np.float32), moves=tagger.moves)
    spark.createDataFrame([(json.dumps({"tags": tagger.tags, "settings": asdict(tagger.settings)}), bytearray(held.getvalue()))], "facts string, weights binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Tagger:
    row = spark.read.parquet(path).first()
    facts, held = json.loads(row.facts), np.load(io.BytesIO(bytes(row.weights)))
    settings = Settings(**facts["settings"])
    weights = np.zeros((settings.features, len(facts["tags"])))
    weights[held["used"]] = held["weights"]
    return Tagger(facts["tags"], weights, held["moves"], settings)
