"""Iterative partitioning: length, fewest-valued column, column pair, template."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import removed_patterns, tokens
from .events import asterisk
from .graph import checkpoints


@dataclass(frozen=True)
class Parameters:
    """longest: tokens of a line, beyond which it is an outlier; support: partitions of no more lines go round step 2;
    share: with a value above 0, partitions of step 1 with a smaller share of all lines are outliers."""

    longest: int = 120
    constant_share: float = 0.175
    lower: float = 0.25
    support: int = 0
    share: float = 0.0
    #: An address whose last octet loses all but its first digit, and node numbers.
    patterns: tuple = ((r"([0-9]+\.){3}[0-9]", ""), (r"node-[0-9]+", "node-"))


def step1(lines: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """lines with tokens (after removing the patterns) and part, the partition by their number; lines left empty, too long or rare are part 0, the outliers."""
    t = tokens(removed_patterns(F.col("message"), list(p.patterns)))
    size = F.when(F.size("tokens") <= p.longest, F.size("tokens")).otherwise(F.lit(0))
    out = lines.withColumn("tokens", t).withColumn("part", size.cast("string"))
    if p.share <= 0:
        return out
    total = F.sum("n").over(W.partitionBy())  # one row a length
    rare = out.groupBy("part").agg(F.count("*").alias("n")).withColumn("rare", F.col("n") / (total + 1) < p.share).select("part", "rare")
    return out.join(F.broadcast(rare), "part").withColumn("part", F.when(F.col("rare"), F.lit("0")).otherwise(F.col("part"))).drop("rare")


def cardinalities(lines: DataFrame) -> DataFrame:
    """part, pos, card: distinct tokens of every column."""
    return lines.select("part", F.posexplode("tokens").alias("pos", "tok")).groupBy("part", "pos").agg(F.countDistinct("tok").alias("card"))


def step2(lines: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Splits a partition on its column with the fewest tokens (first of equal ones), unless a column is constant, its lines are few or it holds the outliers."""
    least = cardinalities(lines.where("part <> '0'")).groupBy("part").agg(F.min(F.struct("card", "pos")).alias("m"))
    if p.support > 0:
        least = least.join(lines.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > p.support).select("part"), "part", "left_semi")
    out = lines.join(least, "part", "left")
    split = F.coalesce(F.col("m.card") > 1, F.lit(False))
    word = F.element_at("tokens", F.col("m.pos") + 1)
    return out.withColumn("by_column", split).withColumn("part", F.when(split, F.concat_ws("/", "part", F.concat(F.lit("c"), F.col("m.pos").cast("string")), word)).otherwise(F.col("part"))).drop("m")


def column_pairs(lines: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """part, p1, p2: the columns step 3 relates; partitions that stay whole have none.

    Two columns relate to each other. Of more, unless the share of constant ones reaches
    the limit, columns are ranked by how many columns have as many tokens: after a split
    the first of the most common kind, with its second or, if that kind is constant or
    single, the first of the next kind; without a split the first of the rarest two kinds.
    """
    cards = cardinalities(lines.where("part <> '0'"))
    kind = cards.withColumn("freq", F.count("*").over(W.partitionBy("part", "card")))
    at = F.sort_array(F.collect_list(F.struct("pos", "card", "freq")))
    shape = kind.groupBy("part").agg(at.alias("at"), (F.sum((F.col("card") == 1).cast("int")) / F.count("*")).alias("constant"), F.max("freq").alias("most"), F.min("freq").alias("least"))
    went = lines.groupBy("part").agg(F.max("by_column").alias("split"))
    shape = shape.join(went, "part")
    freqs = F.transform("at", lambda x: x["freq"])
    next_down = F.array_max(F.filter(freqs, lambda f: f < F.col("most")))
    next_up = F.array_min(F.filter(freqs, lambda f: f > F.col("least")))

    def places(freq: Column) -> Column:
        return F.transform(F.filter("at", lambda x: x["freq"] == freq), lambda x: x["pos"])

    top, varied = places(F.col("most")), F.filter("at", lambda x: x["freq"] == F.col("most"))[0]["card"] > 1
    second = F.when(varied & (F.size(top) > 1), F.get(top, F.lit(1))).otherwise(F.get(places(next_down), F.lit(0)))
    n = F.size("at")
    p1 = F.when(n == 2, F.lit(0)).when(F.col("split"), F.get(top, F.lit(0))).otherwise(F.get(places(F.col("least")), F.lit(0)))
    p2 = F.when(n == 2, F.lit(1)).when(F.col("split"), second).otherwise(F.get(places(next_up), F.lit(0)))
    goes = (n == 2) | ((n > 2) & (F.col("constant") < p.constant_share))
    return shape.where(goes).select("part", p1.alias("p1"), p2.alias("p2")).where("p1 is not null and p2 is not null")


def rank_position(cardinality: Column, lines: Column, one_to_many: Column, lower: float = 0.25) -> Column:
    """1 or 2: the side of a 1-M or M-1 relation to split on. A share of distinct values up to `lower` marks the many side as constant."""
    share = cardinality / lines
    return F.when(one_to_many, F.when(share <= lower, F.lit(2)).otherwise(F.lit(1))).otherwise(F.when(share <= lower, F.lit(1)).otherwise(F.lit(2)))


def step3(lines: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Splits partitions by the relation of their two columns: 1-1 by the pair, 1-M and M-1 by the constant side, M-M stays together."""
    if "weight" not in lines.columns:  # rows that stand for several equal lines carry their number
        lines = lines.withColumn("weight", F.lit(1))
    rows = lines.join(column_pairs(lines, p), "part", "left")
    rows = rows.withColumn("w1", F.element_at("tokens", F.col("p1") + 1)).withColumn("w2", F.element_at("tokens", F.col("p2") + 1))
    pairs = rows.where("p1 is not null").groupBy("part", "w1", "w2").agg(F.sum("weight").alias("n"))
    by1 = pairs.groupBy("part", "w1").agg(F.count("*").alias("fan1"), F.sum("n").alias("n1"))
    by2 = pairs.groupBy("part", "w2").agg(F.count("*").alias("fan2"), F.sum("n").alias("n2"))
    pairs = pairs.join(by1, ["part", "w1"]).join(by2, ["part", "w2"])
    wide1, wide2 = W.partitionBy("part", "w1"), W.partitionBy("part", "w2")
    pairs = pairs.withColumn("one_many", (F.col("fan1") > 1) & (F.max("fan2").over(wide1) == 1)).withColumn("many_one", (F.col("fan2") > 1) & (F.max("fan1").over(wide2) == 1))
    pairs = pairs.withColumn("one_one", (F.col("fan1") == 1) & (F.col("fan2") == 1))
    pairs = pairs.withColumn("rest", ~(F.col("one_one") | F.col("one_many") | F.col("many_one")))
    left = pairs.where("rest").groupBy("part").agg(F.countDistinct("w1").alias("d1"), F.countDistinct("w2").alias("d2"))
    went = lines.groupBy("part").agg(F.max("by_column").alias("split"))
    kind = pairs.join(left, "part", "left").join(went, "part")
    side = F.when(F.col("one_many"), rank_position(F.col("fan1"), F.col("n1"), F.lit(True), p.lower)).when(F.col("many_one"), rank_position(F.col("fan2"), F.col("n2"), F.lit(False), p.lower)).when(F.col("rest") & ~F.col("split"), F.when(F.col("d1") < F.col("d2"), 1).otherwise(2))
    key = F.when(F.col("one_one"), F.concat(F.lit("1:"), "w1")).when(side == 1, F.concat(F.lit("1:"), "w1")).when(side == 2, F.concat(F.lit("2:"), "w2")).otherwise(F.lit("rest"))
    kind = kind.select("part", "w1", "w2", key.alias("key"))
    return rows.join(kind, ["part", "w1", "w2"], "left").withColumn("part", F.when(F.col("key").isNull(), F.col("part")).otherwise(F.concat_ws("/", "part", "key"))).drop("w1", "w2", "p1", "p2", "key", "weight")


def step4(lines: DataFrame) -> DataFrame:
    """part, template, n_rows; the template of lines without tokens is 'Outlier'."""
    got = asterisk(lines, ["part"], "tokens")
    return got.withColumn("template", F.when(F.col("part") == "0", F.lit("Outlier")).otherwise(F.col("template")))


def iplom(lines: DataFrame, p: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """line_id, part of every line, by steps 1 to 3 on unique messages, which are written after step 2 as step 3 reads them many times."""
    unique = lines.groupBy("message").agg(F.count("*").alias("weight"))
    checkpoints(lines.sparkSession)
    if p.support > 0 or p.share > 0:  # these count lines
        return step3(step2(step1(lines, p), p).checkpoint(), p).select("line_id", "part")
    parts = step3(step2(step1(unique, p), p).checkpoint(), p).select("message", "part")
    return lines.select("line_id", "message").join(parts, "message").select("line_id", "part")


def event_stats(lines: DataFrame, events: DataFrame) -> DataFrame:
    """(part, template, n_rows) of the events with more than one line."""
    return lines.groupBy("part").count().where("count > 1").select("part").join(events, "part")
