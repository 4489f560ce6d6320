"""Substring dedup on words: de Bruijn compaction over 20-word edges.

An edge is a window of `length` words, from the node of its first length - 1 words to the node
of its last ones. Stretches of edges that come again whole are copies at once (see repeats); of
the rest every edge becomes a row. Edges that come again, with their first place, are the graph;
its in- and out-degrees tell the nodes that no path branches at, and joins compact the edges
between branches to paths that are one stretch of a document. Where a document walks a path it
holds a repeated span; its words are compared with those at the source's coordinates before any
word goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NULL_ID, dropped, stored
from .kernels import SPACE, U, Words, prefix, ranges, segments
from .repeats import Repeats, column, rows_of

EDGE = "e long, u int, v int, did long, th long, st int"
EDGE_TYPE = pa.schema([("e", pa.int64()), ("u", pa.int32()), ("v", pa.int32()), ("did", pa.int64()), ("th", pa.int64()), ("st", pa.int32())])
DIGEST = "did long, th long, st int, n int, words binary"
DIGEST_TYPE = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("st", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
PLACE = ["did", "th", "st"]


def words_of(column, covered: bool = False):
    w = Words(column)
    return (len(w.start) if covered else w.hash), w.doc


def edges(repeats: Repeats, open_: DataFrame, length: int) -> DataFrame:
    """(e, u, v, did, th, st): the edges of open stretches with their nodes, by hash, and places.

    Nodes have 32 bits: two taken for one only end a path early.
    """

    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return EDGE_TYPE.empty_table()
        texts, row = rows_of(docs, rows)
        w = Words(texts)
        c = prefix(w.hash)
        n = column(rows, "nw").astype(np.int64)
        rep = np.repeat(np.arange(len(n)), n)
        st = segments(column(rows, "st").astype(np.int64), n)
        at = w.doc[row[rep]] + st
        nodes = (ranges(c, at, at + length - 1), ranges(c, at + 1, at + length))
        return pa.table([ranges(c, at, at + length).view("i8"), *((h >> U(32)).astype("u4").view("i4") for h in nodes), column(rows, "did")[rep], column(rows, "th")[rep], st.astype("i4")], schema=EDGE_TYPE)

    return repeats.with_texts(open_, run, EDGE)


def paths(edge: DataFrame) -> DataFrame:
    """(e, fdid, fth, fst, head): repeated edges with their first place and the place where their path begins there.

    A path goes on from an edge to the next one of its first document if the node between
    has one edge in and one out.
    """
    first = edge.groupBy("e").agg(F.min(F.struct(*PLACE, "u", "v")).alias("f"), F.count("*").alias("times")).where("times > 1")
    graph = stored(first.select("e", "f.u", "f.v", F.col("f.did").alias("fdid"), F.col("f.th").alias("fth"), F.col("f.st").alias("fst")), "graph")
    goes_out = graph.groupBy(F.col("u").alias("node")).count().where("count = 1").select("node")
    comes_in = graph.groupBy(F.col("v").alias("node")).count().where("count = 1").select("node")
    through = goes_out.join(comes_in, "node").withColumn("through", F.lit(True))
    by = W.partitionBy("fdid", "fth").orderBy("fst")
    goes_on = F.col("through").isNotNull() & (F.lag("fst").over(by) == F.col("fst") - 1) & (F.lag("v").over(by) == F.col("u"))
    graph = graph.join(through, F.col("u") == F.col("node"), "left").withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    head = F.max(F.when(~F.col("goes_on"), F.col("fst"))).over(by.rowsBetween(W.unboundedPreceding, 0))
    return stored(graph.select("e", "fdid", "fth", "fst", head.alias("head")), "paths")


def walks(edge: DataFrame, path: DataFrame, length: int) -> DataFrame:
    """Spans where a document walks a path, or part of one, that an earlier place has."""
    again = edge.select("e", *PLACE).join(path.select("e", "fdid", "fth", "fst", "head"), "e").where(~((F.col("did") == F.col("fdid")) & (F.col("th") == F.col("fth")) & (F.col("st") == F.col("fst"))))
    walk = ["did", "th", "fdid", "fth", "head", "shift"]
    again = again.withColumn("shift", F.col("st") - F.col("fst"))
    run = F.col("st") - F.row_number().over(W.partitionBy(*walk).orderBy("st"))
    spans = again.withColumn("run", run).groupBy(*walk, "run").agg(F.min("st").alias("st"), (F.count("*") + length - 1).cast("int").alias("n"))
    return spans.select("did", "th", "st", "n", "fdid", "fth", (F.col("st") - F.col("shift")).alias("fst"))


def verified(repeats: Repeats, spans: DataFrame) -> DataFrame:
    """The spans whose words, by a 128-bit cryptographic digest, are those at the source's coordinates."""
    asked = spans.select(*PLACE, "n").union(spans.select("fdid", "fth", "fst", "n")).distinct()

    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return DIGEST_TYPE.empty_table()
        texts, row = rows_of(docs, rows)
        w = Words(texts)
        gap = SPACE[w.raw]
        keep = ~gap
        after = w.end[w.end < len(gap)]
        keep[after] |= gap[after]  # one sign after each word
        plain = memoryview(np.where(gap, np.uint8(0x20), w.raw)[keep].tobytes())
        to = np.concatenate([[0], np.cumsum(keep)])
        first = w.doc[row] + column(rows, "st")
        a, b = to[w.start[first]].tolist(), to[w.end[first + column(rows, "n") - 1]].tolist()
        digests = [hashlib.blake2b(plain[x:y], digest_size=16).digest() for x, y in zip(a, b)]
        return pa.table([*(rows.column(k) for k in (*PLACE, "n")), pa.array(digests, pa.binary())], schema=DIGEST_TYPE)

    said = stored(repeats.with_texts(asked, run, DIGEST), "digests")
    source = said.select(F.col("did").alias("fdid"), F.col("th").alias("fth"), F.col("st").alias("fst"), "n", F.col("words").alias("fwords"))
    same = spans.join(said, [*PLACE, "n"]).join(source, ["fdid", "fth", "fst", "n"]).where(F.col("words") == F.col("fwords")).select(*PLACE, "n")
    same = stored(same, "verified")
    dropped(said)
    return same


def dedup_words(docs: DataFrame, length: int = 20, gram: int = 6) -> DataFrame:
    """Each document with the words of later repeated windows taken out.

    A window is `length` consecutive words of one document. A word goes when a window over
    it has a word sequence that also starts earlier: in a smaller doc_id, or earlier in the
    same document. Windows are judged on the input. Words are runs of other than ASCII
    white space, taken unchanged from whole texts.

    Edge cases: a null text counts as empty; a null doc_id sorts first and stays null; rows
    equal in doc_id and text are one document, returned once a row; rows that share only
    the doc_id are ordered by a hash of the text; an empty table gives no rows; further
    columns are ignored. Long texts are taken whole, in batches of whole documents.
    """
    repeats = Repeats(docs, words_of, length, gram, sources=True)
    found = repeats.scan()
    edge = stored(edges(repeats, repeats.open(found), length), "edges")
    copies = stored(repeats.spans(found), "copies")
    dropped(found)
    path = paths(edge)
    walked = stored(walks(edge, path, length), "walks")
    dropped(edge, path)
    spans = verified(repeats, copies.unionByName(walked))

    def result(batch, covered, doc):
        w = Words(batch.column("text"))
        gone = np.concatenate([[0], np.cumsum(covered)])
        raw = w.raw.tobytes()
        start, end, kept = w.start.tolist(), w.end.tolist(), np.flatnonzero(~covered)
        kd = np.searchsorted(kept, w.doc).tolist()
        kept = kept.tolist()
        texts = [b" ".join([raw[start[i] : end[i]] for i in kept[a:b]]) for a, b in zip(kd[:-1], kd[1:])]
        ids = [None if d == NULL_ID else d for d in batch.column("did").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(w.doc), pa.int64()), pa.array(np.diff(gone[w.doc]), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], schema=ARROW
        )

    return repeats.removed(spans, result, RESULT, ARROW)
