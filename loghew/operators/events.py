"""Fields, unique events, templates and their final numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import message_length, tokens

#: The head of a syslog-like line: names of its fields with their number of tokens.
SYSLOG = (("timestamp", 3), ("hostname", 1), ("service", 1))


def split_fields(logs: DataFrame, head: tuple[tuple[str, int], ...] = SYSLOG) -> DataFrame:
    """logs with tokens, fields (name, value in order), entity_tokens and message; a line shorter than its head is all message."""
    n = sum(k for _, k in head)
    t = F.col("tokens")
    out = logs.withColumn("tokens", tokens("raw"))
    at, fields = 1, []
    for name, k in head:
        fields.append(F.struct(F.lit(name).alias("name"), F.array_join(F.slice(t, at, k), " ").alias("value")))
        at += k
    whole = F.size(t) >= n
    rest = F.array_join(F.when(whole, F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(0)))).otherwise(t), " ")
    none = F.array().cast("array<struct<name:string,value:string>>")
    return out.withColumn("message", rest).withColumn("entity_tokens", F.when(whole, F.slice(t, 1, n)).otherwise(F.array().cast("array<string>"))).withColumn("fields", F.concat(F.when(whole, F.array(*fields)).otherwise(none), F.array(F.struct(F.lit("message").alias("name"), F.col("message").alias("value")))))


def assemble_fields(words: Column, tags: Column) -> Column:
    """(name, value) in order of first tag: IOB prefixes off, words joined by space, O is the message, which is always there."""
    names = F.transform(tags, lambda t: F.when(t == "O", F.lit("message")).otherwise(F.regexp_replace(t, "^[BI]-", "")))
    pairs = F.zip_with(words, names, lambda w, n: F.struct(w.alias("w"), n.alias("n")))
    order = F.array_distinct(names)
    order = F.when(F.array_contains(order, "message"), order).otherwise(F.concat(order, F.array(F.lit("message"))))
    return F.transform(order, lambda n: F.struct(n.alias("name"), F.array_join(F.transform(F.filter(pairs, lambda p: p["n"] == n), lambda p: p["w"]), " ").alias("value")))


def unique_events(parsed: DataFrame, *keys: str) -> DataFrame:
    """keys, event_id (order of first line), message, message_length, first_line, members; the dedupe before any pair work."""
    got = parsed.groupBy(*keys, "message").agg(F.min("line_id").alias("first_line"), F.sort_array(F.collect_list("line_id")).alias("members"))
    by = W.partitionBy(*keys).orderBy("first_line")
    return got.select(*keys, (F.row_number().over(by) - 1).cast("long").alias("event_id"), "message", message_length("message").alias("message_length"), "first_line", "members")


def asterisk(rows: DataFrame, keys: list[str], items: str, out: str = "template", repeated: bool = False) -> DataFrame:
    """keys, template, n_rows: place by place the common token or '*', as long as the shortest row.

    Token places are aggregated with partial aggregation, so a group of any size needs two
    values a place. repeated: rows mostly repeat, so that equal ones are counted first.
    """
    if repeated:
        rows = rows.groupBy(*keys, items).agg(F.count("*").alias("times"))
        counted = rows.groupBy(*keys).agg(F.min(F.size(items)).alias("n"), F.sum("times").alias("n_rows"))
    sized = rows.groupBy(*keys).agg(F.min(F.size(items)).alias("n"), F.count("*").alias("n_rows"))
    sized = counted if repeated else sized
    places = rows.select(*keys, F.posexplode(items).alias("pos", "tok")).groupBy(*keys, "pos").agg(F.min("tok").alias("lo"), F.max("tok").alias("hi"))
    word = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("*"))
    lines = places.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", word.alias("t")))).alias("x"))
    same = None
    for k in keys:
        e = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = e if same is None else same & e
    joined = sized.alias("a").join(lines.alias("b"), same, "left")
    text = F.array_join(F.transform(F.filter("x", lambda r: r["pos"] < F.col("n")), lambda r: r["t"]), " ")
    return joined.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.coalesce(text, F.lit("")).alias(out), "n_rows")


def final_abstractions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_entity, abstraction_id, abstraction, n_lines, first_line: clusters split by their number of entity tokens, entity template, then message template.

    The lines of an abstraction are rows of assigned(), however many.
    """
    rows = lines.withColumn("n_entity", F.size("entity_tokens")).withColumn("words", F.split("message", " "))
    by = [*keys, "n_entity"]
    left = asterisk(rows, by, "entity_tokens", "entity").drop("n_rows")
    right = asterisk(rows, by, "words", "said", repeated=True).drop("n_rows")
    ids = rows.groupBy(*by).agg(F.min("line_id").alias("first_line"), F.count("*").alias("n_lines"))
    out = ids.join(left, by).join(right, by)
    number = F.row_number().over(W.orderBy("first_line")) - 1  # one row a template
    return out.select(*by, number.cast("long").alias("abstraction_id"), F.concat_ws(" ", "entity", "said").alias("abstraction"), "n_lines", "first_line")


def assigned(lines: DataFrame, abstractions: DataFrame, keys: list[str]) -> DataFrame:
    """(line_id, abstraction_id) of every line of final_abstractions(lines, keys)."""
    rows = lines.select("line_id", *keys, F.size("entity_tokens").alias("n_entity"))
    return rows.join(abstractions.select(*keys, "n_entity", "abstraction_id"), [*keys, "n_entity"]).select("line_id", "abstraction_id")
