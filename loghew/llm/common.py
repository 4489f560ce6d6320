"""Helpers shared by the corpus operators: reading, shared scratch tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: it sorts before every real id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local session without one gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loghew-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shards(df: DataFrame, mb_each: int) -> int:
    """Partitions for df's bytes: the session's shuffle partitions, or more where the scan's size asks for it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if size >= 1 << 60 else max(n, -(-size // (mb_each << 20)))


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of few rows, so that a batch of long texts fits beside the heap."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text): the document key; a null id becomes NULL_ID, a null text ''.

    Rows equal in id and text are one document; rows that share only the id are told
    apart, and ordered, by th, the text's hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def unique_ids(docs: DataFrame) -> bool:
    """No two rows share a doc_id (null counts as one)."""
    return docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), by hash-to-min with shortcuts.

    Every round links each node to the least label among its neighbours and then jumps to
    that label's own label; rounds are O(log n), each written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("label", "seen").alias("least"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("further"))
        hooks = step.where("least < was").groupBy(F.col("was").alias("root")).agg(F.min("least").alias("hook"))
        new = (
            step.join(jump, "least", "left").join(hooks, F.col("least") == F.col("root"), "left")
            .select("node", "was", F.least("least", F.coalesce("further", "least"), F.coalesce("hook", "least")).alias("label"))
        )
        new = stored(new, "labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
