"""Near-duplicate groups: banded MinHash, odd-sketch screening, exact confirmation.

Each document's shingle set gives MinHash samples. Bands of samples propose candidates;
an odd sketch (a bitmap in which every sample flips one bit) estimates a pair's similarity
from the population count of an XOR, and screens out pairs far below the threshold; every
link is then confirmed on the full shingle sets.

Equal sets collapse to one representative first. Small buckets are compared whole. The
larger ones form families: all buckets around one hub, the member that meets most others.
Every member meets the hub; then the members outside the family's greatest component meet
all of the family that lies in another component, block by block: the odd sketches screen a
block's meetings, full sets confirm what is left, and only links that join two components
leave it. A block's rows are sent once for each block it meets, so rows grow with a family's
size times its number of blocks (of some thousand documents), not with its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, components, keyed, shards, small_batches, stored, unique_ids
from .kernels import MULTIPLIERS, U, Words, mix, segments, sets, slices

SAMPLES, BANDS, ROWS, BITS = 128, 24, 4, 512
#: Buckets up to this size are compared whole.
SMALL = 16
#: Shingles a block of a family's members, or of the members that ask, holds on average.
MEMBERS, ASKING = 1 << 21, 1 << 21
CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(77))
FLIP = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
SCALE = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
SALT = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64)
LONGS = BITS // 64


def signatures(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MinHash samples, one row a document; empty segments must not occur."""
    low = (hashes >> U(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, SAMPLES), np.uint32)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((low ^ FLIP[i]) * SCALE[i], off[:-1])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of BITS bits, as 64-bit columns."""
    n = len(samples)
    bit = (mix(samples.astype(np.uint64) * MULTIPLIERS[0] + SALT) % U(BITS)).astype(np.int64)
    counts = np.bincount((bit + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, BITS), axis=1).view(np.uint64).astype(np.int64)


def farthest(percent: int) -> int:
    """The largest XOR count that a pair at the threshold reaches but for six standard deviations."""
    j = percent / 100
    differing = 2 * (SAMPLES * (1 - j) + 6 * (SAMPLES * j * (1 - j)) ** 0.5)
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** differing)
    return int(mean + 6 * (mean * (1 - mean / BITS)) ** 0.5 / 4) + 1


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """(did, n, full): the sorted 64-bit shingle hashes of each text, as bytes."""

    def run(batches):
        for batch in slices(batches, "text", CHUNK):
            h, off = sets(*Words(batch.column("text"), lower=True).shingles(k))
            full = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((off * 8).astype(np.int64)), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(np.diff(off), pa.int64()), full.cast(pa.binary())], names=["did", "n", "full"])

    return texts.select("did", "text").mapInArrow(run, "did long, n long, full binary")


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(did, n, s1, s2, bands, sketch columns) for each row: set size, the set's 128-bit identity, band hashes."""
    names = [f"o{i}" for i in range(LONGS)]
    types = [("did", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), *((x, pa.int64()) for x in names)]

    def run(batches):
        for batch in slices(batches, "text", CHUNK):
            h, off = sets(*Words(batch.column("text"), lower=True).shingles(k))
            n = np.diff(off)
            some = np.flatnonzero(n)
            full = np.append(off[:-1][some], off[-1])
            ids = np.zeros((2, len(n)), np.uint64)
            bands = np.zeros((len(n), BANDS), np.int64)
            odd = np.zeros((len(n), LONGS), np.int64)
            if len(some):
                for i in range(2):
                    ids[i, some] = np.add.reduceat(mix(h * MULTIPLIERS[200 + i] + MULTIPLIERS[210 + i]), full[:-1])
                m = signatures(h, full)
                flat = m[:, : BANDS * ROWS].astype(np.uint64)
                c = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    c = mix(c + (flat[:, r::ROWS] + U(1)) * MULTIPLIERS[220 + r])
                bands[some] = mix(c + np.arange(BANDS, dtype=np.uint64) * MULTIPLIERS[230]).astype(np.int64)
                odd[some] = odd_sketch(m)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(bands[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(n, pa.int64()), *(pa.array(x.astype(np.int64)) for x in ids), lists, *(pa.array(odd[:, i]) for i in range(LONGS))], schema=pa.schema(types))

    schema = "did long, n long, s1 long, s2 long, bands array<long>, " + ", ".join(f"{x} long" for x in names)
    return docs.select("did", "text").mapInArrow(run, schema)


def small_pairs(rows: DataFrame, parts: int) -> DataFrame:
    """All pairs (a, b) of buckets of up to SMALL members; rows: (bucket, did)."""

    def run(batches):
        held: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def out(bucket, did):
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            size = np.diff(edge)
            a, b = [], []
            for step in range(1, int(size.max(initial=1))):  # members step places apart
                i = np.flatnonzero(bucket[step:] == bucket[:-step])
                a.append(did[i])
                b.append(did[i + step])
            if a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

        for batch in batches:
            bucket, did = (np.concatenate([held[i], np.asarray(batch.column(c))]) for i, c in enumerate(("bucket", "did")))
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            held = (bucket[last:], did[last:])
            if last:
                yield from out(bucket[:last], did[:last])
        if len(held[0]):
            yield from out(*held)

    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "did").mapInArrow(run, "a long, b long")


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between asking members and members of other components, on full sets.

    rows: (hub, did, component, n, asks, full, sketch columns). A family is dealt into blocks by the number of
    its shingles; each block of asking members meets each block of members. Within a meeting
    a link joins two components, and later links between the two are left out.
    """
    size = F.sum("n")
    names = [f"o{i}" for i in range(LONGS)]
    most = farthest(percent)
    blocks = rows.groupBy("hub").agg(F.ceil(size / MEMBERS).cast("int").alias("mblocks"), F.ceil(F.coalesce(F.sum(F.when(F.col("asks"), F.col("n"))), F.lit(0)) / ASKING).cast("int").alias("qblocks"))
    own = F.xxhash64("did")
    spread = lambda count, block: F.transform(F.sequence(F.lit(0), F.col(count) - 1), block)
    block = lambda mb, qb, asking: F.struct(mb.cast("int").alias("mb"), qb.cast("int").alias("qb"), F.lit(asking).alias("asking"))
    as_member = spread("qblocks", lambda i: block(F.pmod(own, F.col("mblocks")), i, False))
    as_asking = F.when(F.col("asks"), spread("mblocks", lambda i: block(i, F.pmod(own, F.col("qblocks")), True)))
    dealt = rows.join(blocks.where("qblocks > 0"), "hub")
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("asks"), F.concat(as_member, as_asking)).otherwise(as_member))).select("hub", "to.*", "did", "component", "n", "full", *names)

    def meet(t: pa.Table) -> pa.Table:
        asks = np.asarray(t.column("asking").combine_chunks().cast(pa.int8())).astype(bool)
        t = t.take(pa.array(np.argsort(asks, kind="stable")))  # members first
        did, n, label = (np.asarray(t.column(c)).astype(np.int64) for c in ("did", "n", "component"))
        full = np.frombuffer(b"".join(t.column("full").to_pylist()), np.uint64)
        off = np.concatenate([[0], np.cumsum(n)])
        m = int((~asks).sum())
        size = n[:m]
        odd = np.stack([np.asarray(t.column(c)).astype(np.int64).view(np.uint64) for c in names])
        _, comp = np.unique(label, return_inverse=True)
        a, b = [], []
        for q in range(m, len(did)) if m else ():
            fit = (100 * size >= percent * n[q]) & (100 * n[q] >= percent * size) & (comp[:m] != comp[q])
            near = np.flatnonzero(fit)
            near = near[np.bitwise_count(odd[:, near] ^ odd[:, q : q + 1]).sum(axis=0) <= most]
            ok = np.zeros(0, np.int64)
            if len(near):  # confirmed on full sets: how many of each one's shingles the asking one holds
                own, held = full[off[q] : off[q + 1]], full[segments(off[near], size[near])]
                at = np.minimum(np.searchsorted(own, held), len(own) - 1)
                same = np.add.reduceat(own[at] == held, np.cumsum(size[near]) - size[near], dtype=np.int64)
                ok = near[100 * same >= percent * (size[near] + n[q] - same)]
            if len(ok):
                other, first = np.unique(comp[ok], return_index=True)
                a.append(np.full(len(first), did[q]))
                b.append(did[ok[first]])
                comp[np.isin(comp, other)] = comp[q]
        x, y = (np.concatenate([*v, np.zeros(0, np.int64)]) for v in (a, b))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.groupBy("hub", "mb", "qb").applyInArrow(meet, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach percent / 100."""

    def run(batches):
        for whole in batches:
            for batch in slices([whole], "ta", CHUNK):
                x, xo = sets(*Words(batch.column("ta"), lower=True).shingles(k))
                y, yo = sets(*Words(batch.column("tb"), lower=True).shingles(k))
                keep = []
                for i in range(batch.num_rows):
                    p, q = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
                    both = np.concatenate([p, q])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * same >= percent * (len(p) + len(q) - same))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("did").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("did").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate components of whole texts.

    Words are runs of other than ASCII white space, A-Z in lower case; a set holds the
    distinct k-word shingles, or the whole sequence of a shorter text. Two documents are
    linked when 100 * intersection >= percent * union; component_id is the least doc_id
    reachable. Linked pairs are missed only if no band meets (at 85 % about 2 in 10**8).

    Edge cases: null and wordless texts have an empty set and stay alone; a null doc_id
    counts as the least and stays null; rows equal in doc_id and text are one node, and rows
    that share only the doc_id are apart, ordered by a hash of the text; an empty table gives
    no rows; further columns are ignored; long texts are taken whole.
    """
    return near_nodes(docs, unique_ids(docs), k, percent).drop("th")


def near_nodes(docs: DataFrame, unique: bool, k: int = 5, percent: int = 80) -> DataFrame:
    """near_groups with th, the hash of the text that tells rows of one doc_id apart; null where doc_ids are unique."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shards(docs, 16)
    whole = keyed(docs)
    if not unique:  # inside, did is a number of (did, th)
        nodes = stored(whole.select("did", "th").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
        whole = whole.join(nodes, ["did", "th"]).select(F.col("node").alias("did"), "text")
    whole = whole.select("did", "text")
    base = stored(describe(whole, k), "sets")
    names = [f"o{i}" for i in range(LONGS)]
    least = base.where("n > 0").groupBy("s1", "s2").agg(F.min("did").alias("rep"))
    member = stored(base.select("did", "n", "s1", "s2").join(least, ["s1", "s2"], "left").select("did", "n", F.coalesce("rep", "did").alias("rep")), "members")
    reps = least.select(F.col("rep").alias("did"), "s1", "s2").join(base, ["did", "s1", "s2"]).dropDuplicates(["did", "s1", "s2"])
    sketch = stored(reps.select("did", "n", "bands", *names).dropDuplicates(["did"]), "sketches")
    band = stored(reps.select("did", F.explode("bands").alias("bucket")).distinct(), "bands")
    sizes = band.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stored(band.join(sizes, "bucket"), "buckets")
    large = buckets.where(F.col("size") > SMALL)
    met = large.join(large.groupBy("did").agg(F.sum("size").alias("met")), "did")
    hubs = met.groupBy("bucket").agg(F.max_by("did", F.struct("met", "did")).alias("hub"))
    family = stored(large.join(hubs, "bucket").select("hub", "did").distinct(), "families")
    most = farthest(percent)

    def screened(pairs: DataFrame) -> DataFrame:
        p = pairs.where("a < b").distinct()
        for side in "ab":
            p = p.join(sketch.select(F.col("did").alias(side), F.col("n").alias(side + "n"), *(F.col(n).alias(side + n) for n in names)), side)
        apart = sum((F.bit_count(F.col("a" + n).bitwiseXOR(F.col("b" + n))) for n in names), F.lit(0))
        fit = (100 * F.col("an") >= percent * F.col("bn")) & (100 * F.col("bn") >= percent * F.col("an"))
        return stored(p.where((apart <= most) & fit).select("a", "b"), "pairs")

    pairs = screened(small_pairs(buckets.where(F.col("size") <= SMALL).select("bucket", "did"), parts))
    used = pairs.select(F.col("a").alias("did"), F.lit(False).alias("large")).union(pairs.select("b", F.lit(False))).union(family.select("did", F.lit(True)))
    used = used.groupBy("did").agg(F.max("large").alias("large"), F.min("large").alias("only")).select("did", "large", (~F.col("only")).alias("paired"))
    # one shuffle of the texts, planned alike at every size
    texts = stored(whole.hint("merge").join(used, "did"), "texts")
    links = stored(confirmed(pairs, texts.where("paired").select("did", "text"), k, percent), "links")
    full = full_sets(texts.where("large"), k).withColumn("same", F.xxhash64("full")).dropDuplicates(["did", "same"]).drop("same")
    full = stored(full.join(sketch.select("did", *names), "did"), "full")
    stars = family.select("hub", "did", F.col("did").alias("component"), (F.col("did") == F.col("hub")).alias("asks")).join(full, "did")
    links = links.union(stored(compared(stars, percent), "links"))
    groups = components(links)
    placed = family.join(groups.withColumnRenamed("node", "did"), "did", "left").select("hub", "did", F.coalesce("component", "did").alias("component"))
    placed = stored(placed, "placed")
    shares = placed.groupBy("hub", "component").agg(F.count("*").alias("held"))
    mixed = shares.groupBy("hub").agg(F.max_by("component", F.struct("held", "component")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1")
    rows = placed.join(mixed, "hub").withColumn("asks", F.col("component") != F.col("major")).join(full, "did")
    fresh = stored(compared(rows, percent), "links")
    if not fresh.isEmpty():
        groups = components(links.union(fresh))
    out = member.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    if unique:
        return out.select(real("did").alias("doc_id"), F.lit(None).cast("long").alias("th"), F.col("n").alias("n_shingles"), real("c").alias("component_id"), (F.col("did") == F.col("c")).alias("kept"))
    own = out.select(F.col("did").alias("node"), "n", "c").join(nodes, "node")
    first = own.groupBy("c").agg(F.min(F.struct("did", "th")).alias("first"))
    out = own.join(first, "c").withColumn("cid", F.col("first.did"))
    return out.select(real("did").alias("doc_id"), "th", F.col("n").alias("n_shingles"), real("cid").alias("component_id"), (F.struct("did", "th") == F.col("first")).alias("kept"))
