"""Log sources: text files, format-driven scans, views over tables, CoNLL, wordlists, vocabularies."""

from __future__ import annotations

import configparser
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import WHITE, removed_patterns
from ..operators.graph import checkpoints


def number_lines(df: DataFrame, source: str, position: str, raw: str) -> DataFrame:
    """(source, line_id, raw): dense ids from 0 over the lines with text, by position within a source."""
    kept = df.where(F.length(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), WHITE, "")) > 0)
    by = W.partitionBy(source).orderBy(position)
    return kept.select(F.col(source).alias("source"), (F.row_number().over(by) - 1).cast("long").alias("line_id"), F.col(raw).alias("raw"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every file under path is a source, known by its full path; its lines are numbered in file order."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # follows the order of lines within a split
    return number_lines(lines.withColumn("position", F.struct("block", "at")), "source", "position", "raw")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, raw): the events table as syslog-like lines."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    text = lambda x: F.col(x) if isinstance(x, str) else x.cast("string")
    bucket, user = F.floor(F.col("value") / 50).cast("long"), F.col("user_id") % 20
    message = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("new account created for user "), text(user)))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("order accepted user "), text(user), F.lit(" bucket "), text(bucket)))
        .when(F.col("event_type") == "error", F.concat(F.lit("request failed with code "), text(F.col("event_id") % 5), F.lit(" , retrying")))
        .when(F.col("event_type") == "view", F.concat(F.lit("page "), text(F.col("event_id") % 7), F.lit(" rendered in "), text(bucket), F.lit(" ms total")))
        .otherwise(F.concat(F.lit("button "), text(F.col("event_id") % 3), F.lit(" pressed")))
    )
    raw = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), text(F.col("user_id") % 10), F.lit(" "), F.col("event_type"), F.lit(": "), message)
    return e.select(F.col("event_id").alias("line_id"), raw.alias("raw"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line): non-empty lines of documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") > 0)


def compile_format(fmt: str) -> tuple[list[str], str]:
    """'<A> <B>' -> (headers, pattern): blanks match any white space, the last header the rest of the line."""
    parts = re.split(r"<([^<>]+)>", fmt)
    headers, pattern = parts[1::2], ""
    for i, part in enumerate(parts):
        pattern += re.sub(r"\\? +", r"\\s+", re.escape(part).replace(r"\ ", " ")) if i % 2 == 0 else "(.*?)"
    return headers, f"^{pattern}$"


def dense_numbers(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with name: 1, 2, ... in order; counted by ranges, so that no task holds all rows."""
    checkpoints(rows.sparkSession)
    part = F.spark_partition_id().alias("part_")
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part, F.monotonically_increasing_id().alias("at_")).checkpoint()
    sizes = sorted_.groupBy("part_").agg(F.count("*").alias("size_"), F.min("at_").alias("first_"))
    before = F.sum("size_").over(W.orderBy("part_")) - F.col("size_")  # one row a range
    return sorted_.join(F.broadcast(sizes.withColumn("before_", before)), "part_").withColumn(name, F.col("before_") + F.col("at_") - F.col("first_") + 1).drop("part_", "at_", "size_", "first_", "before_")


def format_scan(lines: DataFrame, fmt: str, raw: str = "raw", order: tuple[str, ...] = (), patterns: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One column a header of the format; lines that don't match are left out.

    order: columns that order the lines, which then get LineId, from 1 over the matching
    ones. patterns: replacements that make Content_ of Content.
    """
    headers, pattern = compile_format(fmt)
    kept = lines.where(F.col(raw).rlike(pattern))
    got = kept.select("*", *(F.regexp_extract(raw, pattern, i + 1).alias(h) for i, h in enumerate(headers)))
    if patterns:
        got = got.withColumn("Content_", removed_patterns(F.col("Content"), list(patterns)))
    return dense_numbers(got, "LineId", *order) if order else got


def json_map(spark: SparkSession, path: str, value: str = "bigint") -> DataFrame:
    """(key, value) of one JSON object with integer keys."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value")).select(F.col("key").cast("long").alias("key"), "value")


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    """(log_type, idx, label): labels of each file in order, lower case."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("log_type"), F.lower(F.trim("value")).alias("label"), F.monotonically_increasing_id().alias("at"))
    by = W.partitionBy("log_type").orderBy("at")
    return lines.where("label <> ''").select("log_type", (F.row_number().over(by) - 1).alias("idx"), "label")


def sentences(lines: DataFrame, source: str, position: str, value: str, most: int | None = None) -> DataFrame:
    """(source, sent_id, words, tags) of CoNLL lines: a blank or -DOCSTART- line ends a sentence; the last field is the tag."""
    by = W.partitionBy(source).orderBy(position)
    end = (F.trim(value) == "") | F.col(value).startswith("-DOCSTART-")
    marked = lines.withColumn("gap", F.sum(end.cast("int")).over(by)).where(~end)
    field = F.split(F.col(value), " ")
    got = marked.groupBy(F.col(source).alias("source"), "gap").agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), field[0].alias("w"), F.element_at(field, -1).alias("t")))).alias("x"))
    by = W.partitionBy("source").orderBy("gap")
    got = got.select("source", (F.row_number().over(by) - 1).alias("sent_id"), F.col("x.w").alias("words"), F.col("x.t").alias("tags"))
    return got if most is None else got.where(F.col("sent_id") < most)


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """line -> index; a vocabulary is a bounded driver-side table."""
    return {r["value"].strip(): i for i, r in enumerate(spark.read.text(path).collect())}


def vector_words(spark: SparkSession, path: str) -> DataFrame:
    """(token): the words of a word-vector text file."""
    return spark.read.text(path).select(F.split("value", " ")[0].alias("token")).distinct()


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("token", "vector").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector) of save_vectors."""
    return spark.read.schema("token string, vector array<float>").parquet(path)


def trimmed_vectors(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """(token, vector) of a word-vector text file for the vocabulary's tokens."""
    parts = F.split("value", " ")
    vectors = spark.read.text(path).select(parts[0].alias("token"), F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vector"))
    return vectors.join(vocab.select("token").distinct(), "token", "left_semi")


def read_config(path: str) -> dict[str, dict[str, object]]:
    """An INI file; values of several lines become lists."""
    parser = configparser.ConfigParser()
    parser.read(path)
    return {s: {k: [x for x in v.split("\n") if x] if "\n" in v else v for k, v in parser[s].items()} for s in parser.sections()}


def label_map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs for x in p))
