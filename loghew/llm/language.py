"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Filters of widths 2, 3 and 4 run over the bytes of fixed-length windows; each filter's
largest value in a window (max pooling, ReLU) feeds a softmax. A convolution over bytes is
a sum of table rows, one a byte and place, so that two places make one lookup by byte pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .kernels import LOWER, buffers, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Net:
    labels: list[str]
    tables: dict[int, np.ndarray]  # width: (width, 256, filters)
    bias: np.ndarray  # of all filters
    dense: np.ndarray
    out: np.ndarray


def forward(net: Net, x: np.ndarray, places: bool = False):
    """(logits, pooled, places of the maxima) of windows x, uint8 (n, WINDOW)."""
    pooled, at = [], []
    for w in WIDTHS:
        t = net.tables[w]
        span = x.shape[1] - w + 1
        v = t[0][x[:, :span]]
        for j in range(1, w):
            v = v + t[j][x[:, j : j + span]]
        if places:
            at.append(v.argmax(axis=1))
        pooled.append(v.max(axis=1))
    p = np.concatenate(pooled, axis=1) + net.bias
    return np.maximum(p, 0) @ net.dense + net.out, p, at


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(net: Net, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean cross-entropy, its gradients in the order tables by width, bias, dense, out); a maximum passes its gradient to its place alone."""
    n = len(x)
    z, p, at = forward(net, x, places=True)
    d = softmax(z)
    loss = -float(np.log(d[np.arange(n), y]).mean())
    d[np.arange(n), y] -= 1
    d /= n
    dp = (d @ net.dense.T) * (p > 0)
    grads = []
    for i, w in enumerate(WIDTHS):
        g = np.zeros_like(net.tables[w])
        part = dp[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):
            np.add.at(g[j], (x[np.arange(n)[:, None], at[i] + j], np.arange(FILTERS)[None, :]), part)
        grads.append(g)
    return loss, [*grads, dp.sum(axis=0), np.maximum(p, 0).T @ d, d.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, labels: list[str], steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Net:
    """Adam on cross-entropy, with classes drawn evenly; the same data gives the same net."""
    rng = np.random.Generator(np.random.PCG64(seed))
    f, k = FILTERS * len(WIDTHS), len(labels)
    net = Net(labels, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(f, np.float32), rng.normal(0, 0.3, (f, k)).astype(np.float32), np.zeros(k, np.float32))
    params = [*(net.tables[w] for w in WIDTHS), net.bias, net.dense, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by = [np.flatnonzero(y == c) for c in range(k)]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(r, max(1, batch // k)) for r in by])
        _, grads = gradients(net, x[rows], y[rows])
        for q, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= rate * (1 - step / (steps + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


class Fast:
    """The net with byte-pair tables, for many windows."""

    def __init__(self, net: Net):
        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)

        t = net.tables
        self.net = net
        self.two, self.three, self.four = pair(*t[2]), pair(t[3][0], t[3][1]), (pair(t[4][0], t[4][1]), pair(t[4][2], t[4][3]))
        self.third = t[3][2]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.labels)), np.float32)
        for a in range(0, len(x), 128):
            part = x[a : a + 128]
            pairs = part[:, :-1].astype(np.uint16) << 8 | part[:, 1:]
            v2 = self.two.take(pairs, axis=0).max(axis=1)
            v3 = self.three.take(pairs[:, :-1], axis=0)
            v3 += self.third.take(part[:, 2:], axis=0)
            v4 = self.four[0].take(pairs[:, :-2], axis=0)
            v4 += self.four[1].take(pairs[:, 2:], axis=0)
            p = np.concatenate([v2, v3.max(axis=1), v4.max(axis=1)], axis=1) + self.net.bias
            out[a : a + 128] = np.maximum(p, 0) @ self.net.dense + self.net.out
        return out


def windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, each document's first): whole texts in windows of WINDOW bytes, the last filled up with spaces."""
    size = np.maximum(1, -(-np.diff(off) // WINDOW))
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.full(first[-1] * WINDOW, 32, np.uint8)
    n = np.diff(off)
    out[np.arange(len(raw)) + np.repeat(first[:-1] * WINDOW - off[:-1], n)] = LOWER[raw]
    return out.reshape(-1, WINDOW), first


def fit(docs: DataFrame, allowed, label: str = "lang", per_label: int = 400, windows_each: int = 6) -> Net | None:
    """A net trained on at most about 2 * per_label documents a label, those of the least id hashes; None without labels.

    `per_label` bounds what is collected, whatever the input's size: a document is drawn
    when its hash falls under per_label / (documents of the label). Of each, `windows_each`
    windows at evenly spaced places are used.
    """
    rows = docs.where(allowed & F.col(label).isNotNull() & (F.length("text") > 0))
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # one row a language
    labels = sorted(counts)
    if not labels:
        return None
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    drawn = None
    for c in labels:
        own = (F.col(label) == c) & (h < int(min(1.0, per_label / counts[c]) * (1 << 30)))
        drawn = own if drawn is None else drawn | own
    raw = F.encode(F.col("text"), "utf-8")
    places = F.transform(F.sequence(F.lit(0), F.lit(windows_each - 1)), lambda i: F.substring(raw, (F.greatest(F.length(raw) - WINDOW, F.lit(0)) * i / max(1, windows_each - 1)).cast("int") + 1, F.lit(WINDOW)))
    sample = rows.where(drawn).select("doc_id", F.col(label).alias("y"), F.explode(F.array_distinct(places)).alias("w")).limit(2 * per_label * len(labels) * windows_each).toPandas()
    sample = sample.sort_values(["y", "doc_id", "w"], kind="stable")
    if not len(sample):
        return None
    labels = sorted(set(sample["y"]))
    x, _ = windows(*buffers(pa.array([bytes(w) for w in sample["w"]], pa.binary())))
    return train(x, np.array([labels.index(v) for v in sample["y"]]), labels)


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs' rows (doc_id, then lang_pred, score, further columns of docs) by the mean of all windows' log probabilities.

    lang_pred is `und` with score 0 where the text is null or has no letter, or no net was learned.
    """
    small_batches(docs.sparkSession)
    clash = [c for c in docs.columns if c in ("lang_pred", "score")]
    docs = docs.drop(*clash)
    schema = docs.schema
    made: list[Fast] = []

    def run(batches):
        for batch in slices(batches, "text", 1 << 19):
            column = batch.column("text")
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            if net is not None:
                if not made:
                    made.append(Fast(net))
                x, first = windows(*buffers(column))
                z = made[0].logits(x)
                logp = z - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - z.max(axis=1, keepdims=True)
                mean = np.add.reduceat(logp, first[:-1]) / np.diff(first)[:, None]
                p = softmax(mean)
                best, top = p.argmax(axis=1).tolist(), p.max(axis=1).tolist()
                for i, t in enumerate(column.to_pylist()):
                    if t and LETTER.search(t):
                        names[i], scores[i] = net.labels[best[i]], min(1.0, top[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType([*schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def held_out() -> object:
    """Documents that learning must not see: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_label: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the others' text and lang alone.

    Edge cases: null or letterless texts are `und` with score 0; a null lang teaches
    nothing; a null doc_id is not held out; repeated rows are rows like others; without any
    label all are `und`; an empty table gives no rows; further columns are ignored.
    """
    net = fit(docs.select("doc_id", "text", "lang"), ~held_out(), per_label=per_label)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), net).drop("text")
