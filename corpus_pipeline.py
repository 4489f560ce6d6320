"""The corpus pipeline: language, near duplicates, secrets, mixture, packed sequences.

Each stage takes all rows its predecessor kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loghew.llm.common import stored, unique_ids
from loghew.llm.language import UNKNOWN, fit, predict
from loghew.llm.mixing import mix_sources
from loghew.llm.near_dedup import near_nodes
from loghew.llm.packing import pack
from loghew.llm.queries import tokenizer
from loghew.llm.secrets import find_secrets, redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter. lang becomes the predicted one.

    Ties of the prediction go to the language first by name; equal rows get equal languages and
    all stay; without any labelled document texts with a letter keep their lang; an empty
    table stays empty.
    """
    net = fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    got = predict(docs, net).where(F.col("lang_pred") != UNKNOWN) if net else docs.where(F.col("text").rlike(r"\p{L}")).withColumn("lang_pred", F.col("lang"))
    return got.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the least doc_id's (of texts that share it, one). Unlike texts stay, whatever their ids.

    Rows equal in id and text are one; of those that differ in further columns the least
    source, then lang, stays. Null and wordless texts have no duplicates. An empty table stays empty.
    """
    unique = unique_ids(docs)
    kept = near_nodes(docs, unique).where("kept").select(F.col("doc_id").alias("k"), F.col("th").alias("t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("k"))
    if unique:
        return docs.join(kept, same, "left_semi")
    out = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).join(kept, same & (F.col("th") == F.col("t")), "left_semi")
    n = F.row_number().over(W.partitionBy("doc_id", "th").orderBy("source", "lang"))
    return out.withColumn("n", n).where("n = 1").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking values of all kinds go out of the texts; copied ones and documents stay. n_chars follows the text.

    Null ids, sources and texts stay; equal rows are redacted alike; an empty table stays empty.
    """
    key = F.xxhash64("text")  # rows equal in id and text have the same places
    found = find_secrets(docs.withColumn("th", key), keep=("th",)).where("n_live > 0")
    found = stored(found.select(F.col("doc_id").alias("d"), "th", "found").dropDuplicates(["d", "th"]), "live")
    marked = docs.withColumn("key", key).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("th")), "left")
    live = F.col("found").isNotNull()
    return redact(marked, F.col("found")).withColumn("n_chars", F.when(live, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it, the one partly taken by its first words.

    Null sources are one source; null and wordless texts have no words to take and go; equal
    rows share their copies; an empty table stays empty.
    """
    got = mix_sources(docs).where("taken > 0")
    part = F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    got = got.withColumn("part", F.explode(copies))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    got = got.withColumn("text", F.when(F.col("part") > 0, words).otherwise(F.col("text")))
    return got.withColumn("n_chars", F.when(F.col("part") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, with their ids.

    A null text is its end alone; equal rows are packed once each; an empty table gives no pieces.
    """
    return pack(docs, tokenizer(), 1024)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: Learned models and hashes are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
