"""Results as text lines and JSON; every sink is a DataFrame that any writer takes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Data that the baselines tokenise where a line has no message; configurable.
NO_MESSAGE = "loghew: no message found"


def per_line(assignments: DataFrame, logs: DataFrame) -> DataFrame:
    """(line_id, text): '<abstraction>; <raw>' for every line."""
    return logs.join(assignments.select("line_id", "abstraction_id"), "line_id").select("line_id", F.concat_ws("; ", F.col("abstraction_id").cast("string"), "raw").alias("text"))


def per_abstraction(abstractions: DataFrame, assignments: DataFrame, logs: DataFrame) -> DataFrame:
    """(abstraction_id, line_id, text): the lines of each block: the template (line_id -1), its numbered lines in order, a blank (line_id null)."""
    head = abstractions.select("abstraction_id", F.lit(-1).cast("long").alias("line_id"), F.concat(F.lit("Abstraction #"), F.col("abstraction_id").cast("string"), F.lit(" "), F.col("abstraction")).alias("text"))
    rows = assignments.select("line_id", "abstraction_id").join(logs, "line_id").select("abstraction_id", F.col("line_id").cast("long").alias("line_id"), F.concat_ws(" ", F.col("line_id").cast("string"), "raw").alias("text"))
    return head.unionByName(rows).unionByName(abstractions.select("abstraction_id", F.lit(None).cast("long").alias("line_id"), F.lit("").alias("text")))


def comparison(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(abstraction_id, abstraction, gt_id, truth, rule): predictions beside the true template of equal trimmed text, the last of equal ones; rule is as long as that template and one more. Unmatched ones carry null."""
    t = truth.groupBy(F.trim("template").alias("key")).agg(F.max(F.struct("gt_id", "template")).alias("t"))
    p = predicted.withColumn("key", F.trim("abstraction"))
    return p.join(t, "key", "left").select("abstraction_id", "abstraction", "t.gt_id", F.col("t.template").alias("truth"), F.repeat(F.lit("-"), F.length("t.template") + 1).alias("rule"))


def comparison_lines(pairs: DataFrame, truth_lines: DataFrame, assignments: DataFrame, logs: DataFrame) -> DataFrame:
    """(matched, abstraction_id, part, line_id, text), to be ordered by these (matched first): the true block, the predicted one and a rule, or the block of a prediction without a match."""
    matched = F.col("gt_id").isNotNull()
    p = pairs.withColumn("matched", matched)
    row = lambda df, part, line, text: df.select("matched", "abstraction_id", F.lit(part).alias("part"), line.cast("long").alias("line_id"), text.alias("text"))
    said = F.concat_ws(" ", F.col("line_id").cast("string"), "raw")
    none = F.lit(None)
    yes = p.where("matched")
    true = yes.join(truth_lines, "gt_id").join(logs, "line_id")
    own = p.join(assignments.select("line_id", "abstraction_id"), "abstraction_id").join(logs, "line_id")
    parts = [
        row(yes, 0, none, F.concat(F.lit("Ground truth: "), "truth")),
        row(true, 1, F.col("line_id"), said),
        row(p, 2, none, F.concat(F.when(matched, "Prediction  : ").otherwise("No match prediction: "), "abstraction")),
        row(own, 3, F.col("line_id"), said),
        row(yes, 4, none, F.col("rule")),
    ]
    return reduce(DataFrame.unionByName, parts)


def template_list(abstractions: DataFrame) -> DataFrame:
    return abstractions.select("abstraction_id", F.concat(F.lit("#"), F.col("abstraction_id").cast("string"), F.lit(" "), F.col("abstraction")).alias("text"))


def parsed_messages(parsed: DataFrame, placeholder: str = NO_MESSAGE) -> DataFrame:
    return parsed.select("line_id", F.when(F.coalesce("message", F.lit("")).isin("", "\n", "\r\n"), F.lit(placeholder)).otherwise(F.col("message")).alias("message"))


def as_json(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row with the object {key: value}; for results of bounded size."""
    return rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value")))))).alias("value"))


def with_mean(metrics: DataFrame) -> DataFrame:
    """The metrics of each file and a last row with the mean accuracy."""
    blank = [F.lit(None).cast(t).alias(n) for n, t in metrics.dtypes if n not in ("filename", "accuracy")]
    mean = metrics.agg(F.lit("------").alias("filename"), *blank, F.avg("accuracy").alias("accuracy"))
    return metrics.unionByName(mean)


def structured(lines: DataFrame, assignments: DataFrame, abstractions: DataFrame, letters_apart: bool = False) -> DataFrame:
    """lines with EventId and EventTemplate; the id is the start of the template's MD5, of its letters with spaces between if letters_apart."""
    t = abstractions.select("abstraction_id", F.col("abstraction").alias("EventTemplate"))
    return lines.join(assignments.join(t, "abstraction_id"), "line_id").withColumn("EventId", event_id(F.col("EventTemplate"), letters_apart)).drop("abstraction_id")


def event_id(template: Column, letters_apart: bool = False) -> Column:
    text = F.array_join(F.filter(F.split(template, ""), lambda x: x != ""), " ") if letters_apart else template
    return F.substring(F.md5(text), 1, 8)


def occurrences(structured_lines: DataFrame) -> DataFrame:
    """EventId, EventTemplate, Occurrences."""
    return structured_lines.groupBy("EventId", "EventTemplate").agg(F.count("*").alias("Occurrences"))


def group_line_numbers(assignments: DataFrame, group: str = "abstraction_id") -> DataFrame:
    """(group, number): lines by group, counted from 1."""
    return assignments.select(group, (F.col("line_id") + 1).alias("number"))


def aligned(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second) texts of two array columns, each pair of items padded to the longer one."""
    wide = F.zip_with(first, second, lambda a, b: F.greatest(F.length(a), F.length(b)))
    pad = lambda c: F.array_join(F.zip_with(c, wide, lambda x, n: F.rpad(x, n, " ")), " ")
    return rows.select(F.rtrim(pad(first)).alias(first), F.rtrim(pad(second)).alias(second))


def write_text(rows: DataFrame, path: str, *order: str) -> None:
    """Text lines in order; earlier results go."""
    rows.orderBy(*order).select("text").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """CSV with a header, as one file: for results of one row a file or template."""
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_groups(rows: DataFrame, path: str, group: str) -> None:
    """Tab-separated files in a folder for each group."""
    rows.write.mode("overwrite").partitionBy(group).option("sep", "\t").csv(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """A token a line, in order of idx."""
    vocab.orderBy("idx").select("token").write.mode("overwrite").text(path)
