"""Abstraction methods behind one call: logs in, abstractions and line assignments out."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import divisive, events, graph, iplom, logsig, trees


def _by_event(run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def lines(parsed: DataFrame, **params) -> DataFrame:
        unique = events.unique_events(parsed)
        groups = run(unique, **params)
        return unique.join(groups, "event_id").select(F.explode("members").alias("line_id"), "group")

    return lines


METHODS: dict[str, Callable[..., DataFrame]] = {
    "graph": _by_event(divisive.graph_method),
    "iplom": lambda parsed, **params: iplom.iplom(parsed, **params).withColumnRenamed("part", "group"),
    "logsig": _by_event(logsig.logsig),
    "drain": _by_event(trees.drain),
    "logmine": _by_event(trees.logmine),
    "spell": _by_event(trees.spell),
}


class Result(NamedTuple):
    """abstractions: group, n_entity, abstraction_id, abstraction, n_lines, first_line; lines: line_id, abstraction_id, each line once."""

    abstractions: DataFrame
    lines: DataFrame


def abstract(logs: DataFrame, method: str = "graph", split: Callable[[DataFrame], DataFrame] = events.split_fields, **params) -> Result:
    """The templates of (line_id, raw) and the lines they stand for; split finds the fields (see tagger.split_by_tags for a learned one)."""
    parsed = split(logs)
    rows = parsed.join(kept(METHODS[method](parsed, **params)), "line_id")
    found = kept(events.final_abstractions(rows, ["group"]))
    return Result(found, events.assigned(rows, found, ["group"]))


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once: what follows reads them several times. checkpoint() writes to the shared folder."""
    graph.checkpoints(rows.sparkSession)
    return rows.checkpoint()
