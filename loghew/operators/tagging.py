"""Tagged sentences: IOB chunks, chunk scores, vocabularies, word and character ids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalized_word, padded


def chunks(sentences: DataFrame) -> DataFrame:
    """sent_id, type, start, end (exclusive): runs that a B- tag, a change of type or O ends."""
    t = sentences.select("sent_id", F.posexplode("tags").alias("pos", "tag"))
    by = W.partitionBy("sent_id").orderBy("pos")
    t = t.withColumn("type", F.regexp_replace("tag", "^[BI]-", "")).withColumn("before", F.lag("tag").over(by))
    start = (F.col("tag") != "O") & (F.col("tag").startswith("B-") | F.col("before").isNull() | (F.col("before") == "O") | (F.regexp_replace("before", "^[BI]-", "") != F.col("type")))
    t = t.withColumn("run", F.sum(start.cast("int")).over(by)).where("tag <> 'O'")
    return t.groupBy("sent_id", "run").agg(F.first("type").alias("type"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("run")


def chunk_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 in percent, of tokens and of chunks."""
    a, b = chunks(truth).withColumn("a", F.lit(1)), chunks(predicted).withColumn("b", F.lit(1))
    both = a.join(b, ["sent_id", "type", "start", "end"], "full").agg(F.sum("a").alias("truth"), F.sum("b").alias("found"), F.sum(F.col("a") * F.col("b")).alias("hit"))
    same = F.aggregate(F.zip_with("tags", "guess", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    tokens = truth.join(predicted.select("sent_id", F.col("tags").alias("guess")), "sent_id").agg(F.sum(same).alias("same"), F.sum(F.size("tags")).alias("n"))
    p, r = F.try_divide(F.col("hit"), F.col("found")), F.try_divide(F.col("hit"), F.col("truth"))
    return both.crossJoin(tokens).select((100 * F.try_divide("same", "n")).alias("accuracy"), (100 * p).alias("precision"), (100 * r).alias("recall"), (100 * F.try_divide(2 * p * r, p + r)).alias("f1"))  # both sides are one row


def vocabulary(words: DataFrame, column: str) -> DataFrame:
    """idx, token: distinct tokens in code point order."""
    distinct = words.select(F.explode(column).alias("token")).distinct()
    return distinct.select((F.row_number().over(W.orderBy("token")) - 1).alias("idx"), "token")


def characters(words: DataFrame, column: str) -> DataFrame:
    return words.select(F.explode(column).alias("w")).select(F.explode(F.split("w", "")).alias("token")).where("token <> ''").distinct()


def word_ids(sentences: DataFrame, vocab: DataFrame, unknown: str = "$UNK$") -> DataFrame:
    """sent_id, ids: vocabulary index of every normalised word; others take the unknown word's, or null if there is none."""
    words = sentences.select("sent_id", F.posexplode("words").alias("pos", "w")).withColumn("token", normalized_word(F.col("w")))
    extra = vocab.where(F.col("token") == unknown).agg(F.max("idx").alias("other"))
    got = words.join(vocab, "token", "left").crossJoin(F.broadcast(extra)).withColumn("id", F.coalesce("idx", "other"))  # always one row
    return got.groupBy("sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def padded_ids(rows: DataFrame, fill: int = 0) -> DataFrame:
    """sent_id, ids, length: ids filled up to the greatest length of all rows; length is the row's own."""
    most = rows.agg(F.max(F.size("ids")).alias("most"))
    got = rows.crossJoin(F.broadcast(most))  # one row
    return got.select("sent_id", padded(F.col("ids"), F.col("most"), fill).alias("ids"), F.size("ids").alias("length"))


def seen_characters(sentences: DataFrame) -> DataFrame:
    """token, words, letters: every character in use (and an empty or null token where a sentence has none), with the most words of a sentence and letters of a word it was found beside."""
    rows = sentences.select(F.size("words").alias("words"), F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).alias("letters"), F.split(F.array_join("words", ""), "").alias("token"))
    return rows.select("words", "letters", F.explode_outer("token").alias("token")).groupBy("token").agg(F.max("words").alias("words"), F.max("letters").alias("letters"))


def looked_up(code: Column, ids: dict[int, int], kind: str) -> Column:
    """ids[code], or null: a constant array of pages of 256 code points, so that no lookup searches."""
    pages = [[ids.get(p * 256 + i) for i in range(256)] if p in {c >> 8 for c in ids} else None for p in range(max(ids, default=-1) // 256 + 1)]
    table = F.from_json(F.lit(json.dumps(pages)), f"array<array<{kind}>>")
    return F.get(F.get(table, F.shiftright(code, 8)), code.bitwiseAND(255))


def character_ids(sentences: DataFrame, chars: DataFrame) -> DataFrame:
    """sent_id, ids: for each word the vocabulary indices of its characters, as written; unknown characters are dropped, a sentence without words has none.

    The vocabulary is a bounded driver-side table (one row a character), looked up where the
    sentence is: no character becomes a row, and nothing is shuffled.
    """
    kind = chars.schema["idx"].dataType.simpleString()
    held = chars.where(F.length("token") == 1).groupBy(F.ascii("token").alias("code")).agg(F.min("idx").alias("idx"))
    ids = {r["code"]: r["idx"] for r in held.collect()}
    empty = F.expr(f"cast(array() as array<{kind}>)")
    found = lambda w: F.array_compact(F.transform(F.transform(F.split(w, ""), F.ascii), lambda c: looked_up(c, ids, kind)))
    ids_of = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.coalesce(F.when(w != "", found(w)), empty))
    return sentences.select("sent_id", ids_of.alias("ids"))


def padded_characters(rows: DataFrame, fill: int = 0, most: DataFrame | None = None) -> DataFrame:
    """sent_id, ids, lengths: every word filled up to the longest word, every sentence to the longest sentence; lengths are the words' own, 0 for those added.

    most: one row with words and letters, the longest, where they are known; else rows are computed twice.
    """
    sizes = F.transform("ids", F.size)
    if most is None:
        most = rows.agg(F.max(F.size("ids")).alias("words"), F.max(F.coalesce(F.array_max(sizes), F.lit(0))).alias("letters"))
    got = rows.crossJoin(F.broadcast(most))  # one row
    blank = F.array_repeat(F.lit(fill), F.col("letters"))
    ids = F.transform("ids", lambda w: padded(w, F.col("letters"), fill))
    return got.select("sent_id", F.concat(ids, F.array_repeat(blank, F.col("words") - F.size("ids"))).alias("ids"), padded(sizes, F.col("words"), 0).alias("lengths"))
