"""Methods on datasets of log files: templates, comparison with the ground truth, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, truth
from ..sources import logs as L
from ..sources import sinks as K
from .methods import abstract, kept


def cluster_count(groups: DataFrame) -> int:
    """The number of true templates, which methods with a fixed number of groups start from."""
    return groups.count()


def labels_of(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Log type -> its labels in order; wordlists are bounded files."""
    out: dict[str, list[str]] = {}
    for r in L.wordlist(spark, path).orderBy("log_type", "idx").collect():
        out.setdefault(r.log_type, []).append(r.label)
    return out


def run_file(logs: DataFrame, labels: list[str], method: str, out: str | None = None, split: Callable[[DataFrame], DataFrame] = events.split_fields, **params) -> DataFrame:
    """The metrics of one file's (line_id, raw). With out, its lines, blocks, comparison and truth are written there."""
    parsed = split(logs)
    groups = kept(truth.ground_truth(parsed, labels))
    if method == "logsig":
        params = {"k": cluster_count(groups)} | params
    found, lines = abstract(logs, method, split, **params)
    gt = truth.truth_lines(parsed, labels, groups)
    if out:
        K.write_text(K.per_line(lines, logs), f"{out}/perline", "line_id")
        K.write_text(K.per_abstraction(found, lines, logs).withColumn("at", F.coalesce("line_id", F.lit(2**62))), f"{out}/perabstraction", "abstraction_id", "at")
        rows = K.comparison_lines(K.comparison(found, groups), gt, lines, logs).withColumn("other", ~F.col("matched"))
        K.write_text(rows, f"{out}/comparison", "other", "abstraction_id", "part", "line_id")
        K.write_text(K.template_list(found), f"{out}/abstractions", "abstraction_id")
        gt.write.mode("overwrite").parquet(f"{out}/lineid_abstractionid")
        K.as_json(groups, "gt_id", "template").write.mode("overwrite").text(f"{out}/abstraction_withid")
    ids = truth.remap(found, groups)
    return truth.evaluate(gt, lines.join(ids, "abstraction_id").select("line_id", "new_id")).drop("f1")


def run(spark: SparkSession, log_dir: str, wordlist_dir: str, method: str, out: str | None = None, **params) -> DataFrame:
    """filename, tp, fp, fn, precision, recall, accuracy of every file under log_dir, and the mean accuracy.

    A file's labels are the wordlist of its name up to the first '.', or none.
    """
    every = kept(L.read_logs(spark, log_dir))
    labels = labels_of(spark, wordlist_dir)
    rows = []
    for r in every.select("source").distinct().orderBy("source").collect():  # a row a file
        name = r.source.rsplit("/", 1)[-1]
        own = every.where(F.col("source") == r.source).select("line_id", "raw")
        got = run_file(own, labels.get(name.split(".")[0], []), method, f"{out}/{name}" if out else None, **params)
        rows.append(got.select(F.lit(name).alias("filename"), *got.columns))
    table = kept(K.with_mean(reduce(DataFrame.unionByName, rows)))
    if out:
        K.write_csv(table, f"{out}/evaluation", "filename")
    return table


def run_config(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Method -> evaluation, as an INI file says: [methods] method, [datasets] dataset and dataset_path, [experiments] result_path.

    Logs lie in dataset_path/dataset/logs, wordlists in dataset_path/dataset/wordlist.
    """
    said = L.read_config(path)
    many = lambda v: [x.strip() for x in (v if isinstance(v, list) else [v])]
    out = {}
    for method in many(said["methods"]["method"]):
        for dataset in many(said["datasets"]["dataset"]):
            base = f"{str(said['datasets']['dataset_path']).rstrip('/')}/{dataset}"
            results = f"{str(said['experiments']['result_path']).rstrip('/')}/{method}/{dataset}"
            out[f"{method}/{dataset}"] = run(spark, f"{base}/logs", f"{base}/wordlist", method, results)
    return out
