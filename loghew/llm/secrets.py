"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Patterns find candidate values with their places. Each value is then counted over the
whole corpus: by how many owners and in how many repositories it occurs. A value that many
owners share, or that lies in many repositories even of few owners, is a copied example; one
that few have in few places looks live. Base kinds always count as found; of the generic kind
only live-looking values do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: kind: (pattern, group of the value, least length of the value), in the order of ties.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Long unbroken runs with letters of both cases and digits, outside the base kinds.
GENERIC = {"owned": (r"[A-Za-z0-9+/_-]{20,}", 0, 20)}
FOUND = "array<struct<start:int,rank:int,kind:string,end:int,value:string,owners:bigint,repositories:bigint,live:boolean>>"
PART = "array<struct<rank:int,kind:string,i:int,gap:int,size:int,value:string>>"


def parts(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """(rank, kind, i, gap, size, value) of a kind's matches in order: gap is the length of the text before one, from the one before it.

    The parts between matches and the matches themselves alternate, so places are sums of lengths.
    """
    re = F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, re, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, re, F.lit(group)) if group else found
    both = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("size"), v.alias("value")))
    both = F.zip_with(both, F.slice(gaps, 1, F.size(found)), lambda p, g: F.struct(p["size"].alias("size"), p["value"].alias("value"), F.length(g).alias("gap")))
    own = F.transform(both, lambda p, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("i"), p["gap"].alias("gap"), p["size"].alias("size"), p["value"].alias("value")))
    return F.when(text.rlike(pattern), own).otherwise(F.expr(f"cast(array() as {PART})"))


def places(rows: DataFrame, least: dict[int, int], generic: int) -> DataFrame:
    """(row, o, r, rank, kind, start, end, value) of the matches in rows' parts, in code points; generic ones that touch no base match.

    Places are running sums over a text's matches, so a text with many costs no more than their sort.
    """
    one = rows.select("row", "o", "r", F.explode("parts").alias("x")).select("row", "o", "r", "x.*")
    upto = W.partitionBy("row", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    one = one.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    enough = F.element_at(F.create_map(*(F.lit(x) for k, n in least.items() for x in (k, n))), F.col("rank"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    base = F.col("rank") < generic
    one = one.where((F.length("value") >= enough) & (base | mixed))
    row = W.partitionBy("row")  # frames that grow from one side cost one step a match
    ended = F.max(F.when(base, F.col("end"))).over(row.orderBy("start", "rank").rowsBetween(W.unboundedPreceding, -1))
    begins = F.min(F.when(base, F.col("start"))).over(row.orderBy(F.desc("start"), F.desc("rank")).rowsBetween(W.unboundedPreceding, -1))
    one = one.withColumn("apart", (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end")))
    return one.where(base | F.col("apart")).select("row", "o", "r", "rank", "kind", "start", "end", "value")


def written(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), copied_from: int = 3, copied_in: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (array with value, owners, repositories, live), n_live, n_copied.

    A value is live-looking when fewer than `copied_from` distinct owners hold it, in fewer
    than `copied_in` distinct repositories. documents name no repository; a source's texts of
    one language stand for one. The columns named in `keep` are returned besides.

    Edge cases: a null text is empty; a null owner or part of a repository's name counts as
    one of its own; a null doc_id stays null; repeated rows are scanned each; an empty table
    gives no rows; further columns are ignored. Whole texts are scanned; places are code
    points, ends exclusive.
    """
    kinds = BASE | GENERIC
    rank = {k: i for i, k in enumerate(kinds)}
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select("doc_id", *keep, name(owner).alias("o"), F.concat_ws("/", *(name(c) for c in repository)).alias("r"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    every = F.concat(*(parts(F.col("t"), k, rank[k], *kinds[k]) for k in kinds))
    rows = stored(rows.select("doc_id", *keep, "o", "r", every.alias("parts"), F.monotonically_increasing_id().alias("row")), "matches")
    one = stored(places(rows.where(F.size("parts") > 0), {rank[k]: v[2] for k, v in kinds.items()}, len(BASE)), "places")
    counts = one.select("value", "o", "r").distinct().groupBy("value").agg(F.count_distinct("o").alias("owners"), F.count_distinct("r").alias("repositories"))
    live = (F.col("owners") < copied_from) & (F.col("repositories") < copied_in)
    item = F.struct("start", "rank", "kind", "end", "value", "owners", "repositories", live.alias("live"))
    known = one.join(counts, "value").where(live | (F.col("rank") < len(BASE))).groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("found"))
    out = rows.drop("parts").join(known, "row", "left").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {FOUND})"))).withColumn("base", F.filter("found", lambda x: x["rank"] < len(BASE)))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    alive = F.size(F.filter("found", lambda x: x["live"])).cast("long")
    return out.select("doc_id", *keep, *(n(k) for k in BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), alive.alias("n_live"), (F.size("found") - alive).cast("long").alias("n_copied"), "found")


def redact(docs: DataFrame, found: Column, mark: str = "[SECRET]") -> DataFrame:
    """docs with the live values of `found` (see find_secrets) replaced by a mark, by their places; null: the text stays.

    A span ends with its value, so the name before an assigned value stays. Values that
    overlap become one mark; copied values and other columns stay.
    """
    text = F.col("text")
    places = F.transform(F.filter(found, lambda x: x["live"]), lambda x: F.struct((x["end"] - F.length(x["value"])).alias("a"), x["end"].alias("b")))

    def step(acc: Column, x: Column) -> Column:
        before = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["a"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["b"]).alias("at"), F.when((x["a"] >= acc["at"]), before).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), "")
    out = F.aggregate(F.array_sort(places), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step, rest)
    return docs.withColumn("text", F.when(found.isNotNull(), out).otherwise(text))
