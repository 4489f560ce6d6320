"""python -m loghew -i LOGS [-o OUT]: the templates of log files; python -m loghew --experiment CONFIG: an evaluation."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import events, tagger
from .plans import experiment
from .plans.methods import METHODS, abstract
from .sources import logs, sinks


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loghew")
    parser.add_argument("-i", "--input", help="a log file or folder")
    parser.add_argument("-o", "--output", help="folder for the templates; without it they are printed")
    parser.add_argument("--method", default="graph", choices=sorted(METHODS))
    parser.add_argument("--groups", type=int, default=10, help="groups a message length, for logsig")
    parser.add_argument("--tagger", help="folder of a saved tagger for the fields")
    parser.add_argument("--experiment", help="an INI file with methods, datasets and where results go")
    given = parser.parse_args(arguments)
    if not (given.input or given.experiment):
        parser.print_help()
        return
    spark = SparkSession.builder.getOrCreate()
    if given.experiment:
        for name, table in experiment.run_config(spark, given.experiment).items():
            print(name)
            table.show(truncate=False)
        return
    lines = logs.dense_numbers(logs.read_logs(spark, given.input).withColumnRenamed("line_id", "at"), "line_id", "source", "at").select("line_id", "raw")
    split = events.split_fields
    if given.tagger:
        held = tagger.load(spark, given.tagger)
        split = lambda x: tagger.split_by_tags(x, held)
    found = abstract(lines, given.method, split, **({"k": given.groups} if given.method == "logsig" else {})).abstractions
    if given.output:
        sinks.write_text(sinks.template_list(found), given.output, "abstraction_id")
        print("Templates are in", given.output)
        return
    for r in sinks.template_list(found).orderBy("abstraction_id").toLocalIterator():
        print(r.text)


if __name__ == "__main__":
    main()
