"""Similarity graphs over unique events, blocked by message length."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() write to the cluster's shared folder; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="loghew-"))


def similarity_edges(events: DataFrame, *keys: str) -> DataFrame:
    """keys, message_length, src, dst, weight > 0, src < dst.

    A weight is above 0 just where some place agrees, so pairs come from an inverted index
    on (length, place, token) and their weights are partial sums; pairs that share nothing
    are never made.
    """
    words = events.select(*keys, "message_length", "event_id", F.posexplode(F.filter(F.split("message", " "), lambda t: t != "")).alias("pos", "tok"), F.size(F.filter(F.split("message", " "), lambda t: t != "")).alias("n"))
    on = [*keys, "message_length", "pos", "tok"]
    left = words.withColumnRenamed("event_id", "src").withColumnRenamed("n", "ns")
    right = words.withColumnRenamed("event_id", "dst").drop("n")
    pairs = left.join(right, on).where("src < dst")
    got = pairs.groupBy(*keys, "message_length", "src", "dst").agg(F.sum(F.col("ns") - F.col("pos")).alias("score"), F.first("ns").alias("n"))
    return got.select(*keys, "message_length", "src", "dst", F.bround(F.col("score") * F.lit(1.0) / (F.col("n") * (F.col("n") + 1) / 2), 3).alias("weight")).where("weight > 0")


def density(events: DataFrame, edges: DataFrame, gate: float = 0.8, most: int = 10_000) -> DataFrame:
    """message_length, vertices, edges, density, forced: whether the dense shortcut applies."""
    v = events.groupBy("message_length").agg(F.count("*").alias("vertices"))
    e = edges.groupBy("message_length").agg(F.count("*").alias("edges"))
    got = v.join(e, "message_length", "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("long"))
    d = F.when(F.col("vertices") > 1, 2.0 * F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1))).otherwise(F.lit(0.0))
    return got.withColumn("density", d).withColumn("forced", (F.col("density") > gate) & (F.col("density") <= 1.0) & (F.col("edges") >= most))


def isolates(events: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("event_id")).union(edges.select("dst"))
    return events.select("message_length", "event_id").join(ends, "event_id", "left_anti")


def threshold(edges: DataFrame, least: float = 0.75) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def lightest(edges: DataFrame) -> DataFrame:
    """message_length and its lightest edge, ties by src, then dst."""
    return edges.groupBy("message_length").agg(F.min(F.struct("weight", "src", "dst")).alias("e")).select("message_length", "e.src", "e.dst", "e.weight")


def pair_clusters(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Clusters of two-node components: one pair, or two singletons below the least weight."""
    both = F.array(F.array("src", "dst"))
    apart = F.array(F.array("src"), F.array("dst"))
    return edges.select("message_length", F.explode(F.when(F.col("weight") < least, apart).otherwise(both)).alias("nodes"))


def clusters(events: DataFrame, edges: DataFrame, least: float = 0.75) -> DataFrame:
    """event_id, cluster: connected components over edges of at least this weight; cluster is the least event_id.

    Labels only fall: every round takes the least label around and then the label's own
    label; each round is checkpointed, so the plan stays short.
    """
    checkpoints(events.sparkSession)
    e = threshold(edges, least)
    both = e.select("src", "dst").union(e.select("dst", "src")).checkpoint()
    labels = events.select("event_id", F.col("event_id").alias("cluster")).checkpoint()
    while True:
        near = both.join(labels, F.col("dst") == F.col("event_id")).groupBy("src").agg(F.min("cluster").alias("near"))
        step = labels.join(near, F.col("event_id") == F.col("src"), "left").select("event_id", F.col("cluster").alias("was"), F.least("cluster", F.coalesce("near", "cluster")).alias("low"))
        jump = labels.select(F.col("event_id").alias("low"), F.col("cluster").alias("own"))
        labels = step.join(jump, "low").select("event_id", "was", F.least("low", "own").alias("cluster")).checkpoint()
        if labels.where("was <> cluster").isEmpty():
            return labels.select("event_id", "cluster")
        labels = labels.select("event_id", "cluster")


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c with all three edges, and the weakest of them."""
    ab = edges.select("message_length", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("wab"))
    bc = edges.select("message_length", F.col("src").alias("b"), F.col("dst").alias("c"), F.col("weight").alias("wbc"))
    ac = edges.select("message_length", F.col("src").alias("a"), F.col("dst").alias("c"), F.col("weight").alias("wac"))
    return ab.join(bc, ["message_length", "b"]).join(ac, ["message_length", "a", "c"]).select("message_length", "a", "b", "c", F.least("wab", "wbc", "wac").alias("weakest"))


def weakest_sides(edges: DataFrame) -> DataFrame:
    """Edges without the weakest side (ties by src, dst) of every triangle; a stronger one stays wherever a weaker side goes.

    All triangles are judged at once on the given edges, so the result does not hang on an
    order of vertices, and no triangle is left whole.
    """
    sides = lambda p, q, w: F.struct(F.col(w).alias("weight"), F.col(p).alias("src"), F.col(q).alias("dst"))
    ab = edges.select("message_length", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("wab"))
    bc = edges.select("message_length", F.col("src").alias("b"), F.col("dst").alias("c"), F.col("weight").alias("wbc"))
    ac = edges.select("message_length", F.col("src").alias("a"), F.col("dst").alias("c"), F.col("weight").alias("wac"))
    found = ab.join(bc, ["message_length", "b"]).join(ac, ["message_length", "a", "c"])
    weak = found.select("message_length", F.least(sides("a", "b", "wab"), sides("b", "c", "wbc"), sides("a", "c", "wac")).alias("e")).select("message_length", "e.src", "e.dst").distinct()
    return edges.join(weak, ["message_length", "src", "dst"], "left_anti")


def pruned(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """weakest_sides(), again while over `most` edges are left and triangles still go."""
    checkpoints(edges.sparkSession)
    n = edges.count()
    while True:
        edges = weakest_sides(edges).checkpoint()
        left = edges.count()
        if left <= most or left == n:
            return edges
        n = left


def by_degree(edges: DataFrame) -> DataFrame:
    """message_length, event_id, degree, place: vertices by falling degree, ties by id."""
    ends = edges.select("message_length", F.col("src").alias("event_id")).union(edges.select("message_length", "dst"))
    degrees = ends.groupBy("message_length", "event_id").agg(F.count("*").alias("degree"))
    place = F.row_number().over(W.partitionBy("message_length").orderBy(F.desc("degree"), "event_id"))
    return degrees.withColumn("place", place)


def of_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The events whose event_id is in ids."""
    return events.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def members(clusters: DataFrame) -> DataFrame:
    """(cluster, event_ids) of (event_id, cluster)."""
    return clusters.groupBy("cluster").agg(F.sort_array(F.collect_list("event_id")).alias("event_ids"))


def cluster_of(members: DataFrame) -> DataFrame:
    """(event_id, cluster) of (cluster, event_ids)."""
    return members.select(F.explode("event_ids").alias("event_id"), "cluster")
