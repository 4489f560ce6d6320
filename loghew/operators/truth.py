"""Ground truth from wordlists, identifiers against it, and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .events import asterisk


def label_lines(lines: DataFrame, labels: list[str]) -> DataFrame:
    """lines with label_idx: the first label of the list found in the lower-case line; 'a &AND& b' needs both; -1 for none.

    A wordlist is a bounded file, so it becomes one CASE chain and no join.
    """
    low = F.lower(F.trim("raw"))
    hit = None
    for i, label in enumerate(labels):
        parts = [p.strip() for p in label.split("&AND&")]
        ok = low.contains(parts[0])
        for p in parts[1:]:
            ok = ok & low.contains(p)
        hit = F.when(ok, F.lit(i)) if hit is None else hit.when(ok, F.lit(i))
    return lines.withColumn("label_idx", hit.otherwise(F.lit(-1)) if hit is not None else F.lit(-1))


def ground_truth(parsed: DataFrame, labels: list[str]) -> DataFrame:
    """gt_id, template, n_rows, first_line: groups by message length, label and the tokens' total length, over raw tokens."""
    rows = label_lines(parsed, labels).withColumn("message_length", F.size(F.split("message", " ")))
    rows = rows.withColumn("total", F.aggregate(F.transform("tokens", F.length), F.lit(0), lambda s, x: s + x))
    keys = ["message_length", "label_idx", "total"]
    first = rows.groupBy(*keys).agg(F.min("line_id").alias("first_line"))
    got = asterisk(rows, keys, "tokens").join(first, keys)
    return got.select((F.row_number().over(W.orderBy("first_line")) - 1).cast("long").alias("gt_id"), *keys, "template", "n_rows", "first_line")


def remap(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """abstraction_id, new_id: the true id of the equal template (the last of equal ones), else fresh ids after the truth's."""
    known = truth.groupBy("template").agg(F.max("gt_id").alias("gt_id"))
    n = truth.agg(F.count("*").alias("n"))
    p = predicted.withColumn("key", F.rtrim("abstraction")).join(known, F.col("key") == F.col("template"), "left")
    fresh = F.row_number().over(W.partitionBy(F.col("gt_id").isNull()).orderBy("abstraction_id")) - 1
    return p.withColumn("fresh", fresh).crossJoin(F.broadcast(n)).select("abstraction_id", F.coalesce("gt_id", F.col("n") + F.col("fresh")).cast("long").alias("new_id"))


def evaluate(truth_lines: DataFrame, predicted_lines: DataFrame, *by: str) -> DataFrame:
    """by, tp, fp, fn, precision, recall, accuracy (the F1 of the rounded two), line-weighted by true group; and unrounded f1.

    truth_lines: (by, line_id, gt_id); predicted_lines: (by, line_id, new_id). A group whose id
    is predicted anywhere (under the same by) is tp; else fp when its lines share one
    predicted id, fn when not. Empty denominators give null.
    """
    seen = predicted_lines.select(*by, F.col("new_id").alias("gt_id")).distinct().withColumn("hit", F.lit(True))
    per = truth_lines.join(predicted_lines, [*by, "line_id"], "left").groupBy(*by, "gt_id").agg(F.count("*").alias("n"), F.countDistinct("new_id").alias("ids"))
    per = per.join(seen, [*by, "gt_id"], "left")
    hit = F.coalesce("hit", F.lit(False))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")
    s = per.groupBy(*by).agg(total(hit).alias("tp"), total(~hit & (F.col("ids") == 1)).alias("fp"), total(~hit & (F.col("ids") != 1)).alias("fn"))
    s = s.withColumn("precision", F.bround(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 3)).withColumn("recall", F.bround(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 3))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return s.withColumn("accuracy", F.bround(f1, 3)).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def truth_lines(parsed: DataFrame, labels: list[str], groups: DataFrame) -> DataFrame:
    """(line_id, gt_id) of ground_truth(parsed, labels)."""
    rows = label_lines(parsed, labels).withColumn("message_length", F.size(F.split("message", " ")))
    rows = rows.withColumn("total", F.aggregate(F.transform("tokens", F.length), F.lit(0), lambda s, x: s + x))
    keys = ["message_length", "label_idx", "total"]
    return rows.select("line_id", *keys).join(groups.select(*keys, "gt_id"), keys).select("line_id", "gt_id")
