"""Mixing sources to target weights by weighted pivotal rounding, in DataFrame operations only.

A source's target over its size gives each of its documents the same fractional number of
copies. Documents meet in pairs: fractional mass, in words, moves from one to the other at
random, so that expectations stay, until one of them holds whole copies. A fold over a
small hashed group leaves one unsettled document; the groups' unsettled documents form the
next level, up to one a source, which is taken in part. So a source's words come to its
target but for rounding to a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Filling is exact in one pass: sources in order of limit by weight reach their limit
    first, so a source is limited when its fair part of what the earlier ones leave is not
    below its limit.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (n % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    every = W.partitionBy()
    upto = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.select("*", (F.sum("source_size").over(every) * F.lit(float(share))).alias("total"), F.sum("weight").over(every).alias("weights"), F.coalesce(F.sum("limit").over(upto), F.lit(0.0)).alias("before"), F.coalesce(F.sum("weight").over(upto), F.lit(0.0)).alias("passed"))
    part = (F.col("total") - F.col("before")) / (F.col("weights") - F.col("passed"))
    s = s.withColumn("full", (F.col("weight") * part >= F.col("limit")) | (F.col("weights") <= F.col("passed")))
    free = F.when(~F.col("full"), F.struct("passed", "before"))
    level = F.min(free).over(every)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * (F.col("total") - level["before"]) / (F.col("weights") - level["passed"])).alias("target"))


def fold(items: Column) -> Column:
    """One pass of pivotal rounding over an array of (doc, size, mass, u): mass in words, 0 < mass < size.

    u of the second and later items decides the meetings; the first one's is not used.
    Gives (rest: the unsettled item, done: settled docs with their words).
    """

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["rest"], x
        up = F.least(a["size"] - a["mass"], b["mass"])  # what b can give a
        down = F.least(a["mass"], b["size"] - b["mass"])  # what a can give b
        rise = b["u"] * (up + down) < down
        fills = F.when(rise, a["size"] - a["mass"] <= b["mass"]).otherwise(a["mass"] > b["size"] - b["mass"])
        # rising: a fills up, or b empties; falling: b fills up, or a empties
        a_mass = F.when(rise, a["mass"] + up).otherwise(a["mass"] - down)
        b_mass = F.when(rise, b["mass"] - up).otherwise(b["mass"] + down)
        a_ends = F.when(rise, fills).otherwise(~fills)

        def item(i: Column, mass: Column) -> Column:
            return F.struct(i["doc"].alias("doc"), i["size"].alias("size"), mass.alias("mass"), i["u"].alias("u"))

        a_words = F.when(rise, a["size"]).otherwise(F.lit(0.0))
        b_words = F.when(rise, F.lit(0.0)).otherwise(b["size"])
        rest = F.when(a_ends, item(b, b_mass)).otherwise(item(a, a_mass))
        done = F.when(a_ends, F.struct(a["doc"].alias("doc"), a_words.alias("words"))).otherwise(F.struct(b["doc"].alias("doc"), b_words.alias("words")))
        return F.struct(rest.alias("rest"), F.concat(acc["done"], F.array(done)).alias("done"))

    none = F.expr("cast(array() as array<struct<doc:bigint,words:double>>)")
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.struct(items[0].alias("rest"), none.alias("done")), step)


def mix_sources(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1, arity: int = 32) -> DataFrame:
    """docs' columns and row_key, size, source_size, target, taken: the words the mix takes of each row.

    Sources in code point order, null last, weigh `weights`, repeating; they share
    `share` of all words, a source at most `most` times its own. taken counts repeats and
    lies between 0 and `most` (rounded up) times size; taken // size copies are whole, and
    one document a source at most is taken in part.

    Edge cases: null and wordless texts have size 0 and give 0; null sources form one
    source; repeated rows and null ids are rows like others (drawn by a hash of all that
    identifies them and told apart by order); an empty table gives no rows; further
    columns stay. Clashing columns (row_key, size, source_size, target, taken) are replaced.
    """
    clash = [c for c in docs.columns if c in ("row_key", "size", "source_size", "target", "taken")]
    docs = docs.drop(*clash)
    rows = docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")).withColumn("row_key", F.xxhash64("doc_id", "source", F.coalesce("text", F.lit(""))))
    slim = stored(rows.select("doc_id", "source", "row_key", "size"), "sizes")
    again = slim.groupBy("row_key").count().where("count > 1").select("row_key")
    per = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, most)
    per = stored(per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), "targets")
    # equal rows are one item with their number of copies, so that a row_key has one row
    one = slim.groupBy("row_key").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("copies"))
    item = one.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = F.col("size") * F.col("copies")
    item = item.select("row_key", "source", "size", "copies", "source_size", "target", (F.floor("rate") * each).cast("double").alias("whole"), each.cast("double").alias("own"), ((F.col("rate") - F.floor("rate")) * each).alias("mass"))
    item = stored(item, "items")
    live = item.where("mass > 0 and mass < own").select("source", F.struct(F.col("row_key").alias("doc"), F.col("own").alias("size"), "mass").alias("item"))
    largest = live.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    done, level, groups = [], 0, largest
    while True:
        groups = -(-groups // arity)
        slot = F.pmod(F.xxhash64("item.doc", F.lit(seed + 7 * level + 1)), F.lit(max(groups, 1)))
        draw = (F.xxhash64("item.doc", F.lit(seed), F.lit(-1 - level)).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))).alias("u")  # a number for each level, so that no meeting reuses one
        fresh = F.struct("item.doc", "item.size", "item.mass", draw).alias("item")
        grouped = live.groupBy("source", slot.alias("slot")).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("item.doc", F.lit(seed + 3)).alias("order"), fresh))).alias("items"))
        folded = stored(grouped.select("source", fold(F.transform("items", lambda x: x["item"])).alias("f")), "pivots")
        done.append(folded.select(F.explode("f.done").alias("d")).select(F.col("d.doc").alias("row_key"), "d.words"))
        live = folded.select("source", F.col("f.rest").alias("item"))
        level += 1
        if groups <= 1:
            break
    last = live.select(F.col("item.doc").alias("row_key"), F.round("item.mass").alias("words"))
    words = last
    for d in done:
        words = words.unionByName(d)
    settled = item.join(words, "row_key", "left").select("row_key", F.col("source_size"), F.col("target"), F.col("copies"), (F.col("whole") + F.coalesce("words", F.when(F.col("mass") >= F.col("own"), F.col("own")).otherwise(F.lit(0.0)))).cast("long").alias("taken"))
    settled = stored(settled, "settled")
    out = rows.join(settled, "row_key")
    if again.isEmpty():
        return out.drop("copies")
    n = F.row_number().over(W.partitionBy("row_key").orderBy(F.to_json(F.struct(*docs.columns))))  # what further columns tell apart is told apart alike in every run
    base, extra = F.floor(F.col("taken") / F.col("copies")), F.pmod(F.col("taken"), F.col("copies"))
    return out.withColumn("taken", F.when(F.col("copies") == 1, F.col("taken")).otherwise(base + F.when(n <= extra, 1).otherwise(0)).cast("long")).drop("copies")
