"""Registered queries: one for each operator family, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import events as E
from ..operators import graph as G
from ..operators import iplom as I
from ..operators import logsig as S
from ..operators import tagging as N
from ..operators import truth as GT
from ..operators.trees import merged
from ..sources import logs as L
from ..sources import sinks as K
from .methods import METHODS, abstract, kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: A small wordlist for the lines of events, in order of preference.
LABELS = ["account created", "order accepted &AND& user 1", "order accepted", "request failed", "rendered", "button"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return E.split_fields(L.event_logs(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    return E.unique_events(parsed(spark, d))


def joined(c) -> F.Column:
    return F.array_join(c, "|")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return GT.ground_truth(parsed(spark, d), LABELS)


def typed(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).withColumn("length", X.message_length("message")).withColumn("type", F.element_at("entity_tokens", 5))


def templates(spark: SparkSession, d: str) -> DataFrame:
    """Abstractions by event type and message length, numbered by first line."""
    return E.final_abstractions(typed(spark, d), ["length", "type"])


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """(line_id, abstraction_id) of templates()."""
    return E.assigned(typed(spark, d), kept(templates(spark, d)), ["length", "type"])


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(line_id, gt_id) of the ground truth and (line_id, new_id) of templates(); the templates are computed once."""
    t, found = kept(truth(spark, d)), kept(templates(spark, d))
    ids = kept(GT.remap(found, t))
    lines = E.assigned(typed(spark, d), found, ["length", "type"])
    return GT.truth_lines(parsed(spark, d), LABELS, t), lines.join(ids, "abstraction_id").select("line_id", "new_id")


@query
def log_scan(spark, d):
    return L.number_lines(L.doc_lines(spark, d), "doc_id", "pos", "line")


@query
def tokenize(spark, d):
    t = X.tokens("raw")
    return L.event_logs(spark, d).select("line_id", F.size(t).alias("n_tokens"), joined(t).alias("tokens"))


@query
def field_split(spark, d):
    p = parsed(spark, d)
    value = lambda n: F.filter("fields", lambda f: f["name"] == n)[0]["value"].alias(n)
    return p.select("line_id", value("timestamp"), value("hostname"), value("service"), "message", F.size("entity_tokens").alias("n_entity"))


@query
def field_assembly(spark, d):
    p = parsed(spark, d).select("line_id", "tokens")
    tags = F.transform("tokens", lambda t, i: F.when(i == 0, "B-TIM").when(i < 3, "I-TIM").when(i == 3, "B-HOS").when(i == 4, "B-SER").otherwise("O"))
    f = E.assemble_fields(F.col("tokens"), tags)
    return p.select("line_id", F.array_join(F.transform(f, lambda x: F.concat_ws("=", x["name"], x["value"])), ";").alias("fields"))


@query
def unique_events(spark, d):
    return events(spark, d).select("event_id", "message", "message_length", "first_line", F.size("members").cast("long").alias("n_members"), F.array_max("members").alias("last_line"))


@query
def length_groups(spark, d):
    return events(spark, d).groupBy("message_length").agg(F.count("*").alias("n_events"), F.sum(F.size("members")).alias("n_lines"))


@query
def asterisk_templates(spark, d):
    rows = parsed(spark, d).withColumn("message_length", X.message_length("message")).withColumn("service", F.element_at("entity_tokens", 5)).withColumn("words", F.split("message", " "))
    return E.asterisk(rows, ["message_length", "service"], "words")


@query
def final_abstraction(spark, d):
    return templates(spark, d).select("abstraction_id", "abstraction", "n_entity", "n_lines", "first_line")


@query
def wordlist_label(spark, d):
    return GT.label_lines(L.event_logs(spark, d), LABELS).groupBy("label_idx").agg(F.count("*").alias("n"), F.min("line_id").alias("first_line"))


@query
def ground_truth_templates(spark, d):
    return truth(spark, d)


@query
def gt_id_remap(spark, d):
    return GT.remap(templates(spark, d), truth(spark, d))


@query
def eval_metrics(spark, d):
    return GT.evaluate(*scored(spark, d))


@query
def weighted_hamming_edges(spark, d):
    return G.similarity_edges(events(spark, d))


@query
def hamming_expression(spark, d):
    ev = events(spark, d).select("event_id", "message_length", F.split("message", " ").alias("t"))
    at = ev.select("message_length", F.col("event_id").alias("src"), F.posexplode("t").alias("pos", "tok"))
    pairs = at.join(at.withColumnRenamed("src", "dst"), ["message_length", "pos", "tok"]).where("src < dst").select("message_length", "src", "dst").distinct()
    a, b = ev.select(F.col("event_id").alias("src"), "t"), ev.select(F.col("event_id").alias("dst"), F.col("t").alias("u"))
    return pairs.join(a, "src").join(b, "dst").select("message_length", "src", "dst", X.weighted_hamming(F.col("t"), F.col("u")).alias("weight")).where("weight > 0")


@query
def graph_density(spark, d):
    ev = events(spark, d)
    return G.density(ev, G.similarity_edges(ev))


@query
def isolates(spark, d):
    ev = events(spark, d)
    return G.isolates(ev, G.threshold(G.similarity_edges(ev), 0.9))


@query
def threshold_edges(spark, d):
    return G.threshold(G.similarity_edges(events(spark, d)))


@query
def lightest_edge(spark, d):
    return G.lightest(G.similarity_edges(events(spark, d)))


@query
def pair_split(spark, d):
    got = G.pair_clusters(G.lightest(G.similarity_edges(events(spark, d))), 0.6)
    return got.select("message_length", joined(F.transform("nodes", lambda x: x.cast("string"))).alias("nodes"))


@query
def force_clusters(spark, d):
    ev = events(spark, d)
    return G.clusters(ev, G.similarity_edges(ev))


@query
def triangles(spark, d):
    return G.triangles(G.threshold(G.similarity_edges(events(spark, d)), 0.85)).groupBy("message_length").agg(F.count("*").alias("n"), F.sum(F.col("a") + F.col("b") + F.col("c")).alias("ids"), F.min("weakest").alias("weakest"))


@query
def word_generalize(spark, d):
    words = L.doc_lines(spark, d).select(F.explode(X.tokens("line")).alias("word")).union(L.event_logs(spark, d).select(F.explode(X.tokens("raw")).alias("word"))).distinct()
    return words.select("word", X.generalize(F.col("word")).alias("class"))


@query
def over_abstraction(spark, d):
    t = F.split("template", " ")
    return asterisk_templates(spark, d).select("message_length", "service", X.stars(t).alias("n_stars"), X.over_abstracted(t).alias("over"), X.all_stars(F.col("template")).alias("only_stars"))


@query
def merge_test(spark, d):
    ev = events(spark, d).select("event_id", "message_length", F.split("message", " ").alias("t"))
    b = ev.select(F.col("event_id").alias("other"), "message_length", F.col("t").alias("u"))
    return ev.join(b, "message_length").where("event_id < other").select("event_id", "other", X.mergeable(F.col("t"), F.col("u")).alias("mergeable"), joined(X.pair_template(F.col("t"), F.col("u"))).alias("template"))


@query
def drain_similarity(spark, d):
    first = events(spark, d).groupBy("message_length").agg(F.min_by("message", "event_id").alias("head"))
    ev = events(spark, d).join(first, "message_length")
    s, n = X.tree_similarity(F.split("head", " "), F.split("message", " "))
    return ev.select("event_id", s.alias("similarity"), n.alias("n_stars"))


@query
def logmine_distance(spark, d):
    first = events(spark, d).groupBy("message_length").agg(F.min_by("message", "event_id").alias("head"))
    ev = events(spark, d).join(first, "message_length")
    return ev.select("event_id", F.round(X.message_distance(F.split("head", " "), F.split("message", " ")), 6).alias("distance"), F.round(X.pattern_distance(F.split("head", " "), F.split("message", " ")), 6).alias("pattern"))


@query
def iplom_step1(spark, d):
    return I.step1(parsed(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.min("line_id").alias("first_line"))


@query
def iplom_cardinalities(spark, d):
    return I.cardinalities(I.step1(parsed(spark, d)))


@query
def iplom_step2(spark, d):
    return I.step2(I.step1(parsed(spark, d))).groupBy("part", "by_column").agg(F.count("*").alias("n"), F.min("line_id").alias("first_line"))


@query
def iplom_step3(spark, d):
    return I.iplom(parsed(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.min("line_id").alias("first_line"))


@query
def iplom_step4(spark, d):
    p = parsed(spark, d)
    return I.step4(I.step1(p).drop("part").join(I.iplom(p), "line_id"))


@query
def logsig_term_pairs(spark, d):
    return S.term_pairs(parsed(spark, d).withColumn("length", X.message_length("message")), "length")


@query
def logsig_signature(spark, d):
    return S.signatures(parsed(spark, d).withColumn("length", X.message_length("message")), "length")


@query
def logformat_scan(spark, d):
    return L.format_scan(L.event_logs(spark, d), "<Month> <Day> <Time> <Host> <Service>: <Content>").select("line_id", "Month", "Day", "Time", "Host", "Service", "Content")


@query
def regex_removal(spark, d):
    rows = parsed(spark, d).withColumn("t", X.tokens(X.removed_patterns(F.col("raw"), [(r"[0-9]+:[0-9]+:[0-9]+", "<time>"), (r"host[0-9]+", "host")])))
    return rows.select("line_id", joined(X.dropped_places(F.col("t"), [0, 2])).alias("tokens"))


@query
def template_occurrences(spark, d):
    return templates(spark, d).groupBy("abstraction").agg(F.sum("n_lines").alias("n")).withColumn("event_hash", F.substring(F.md5("abstraction"), 1, 8))


@query
def vocabulary(spark, d):
    return N.vocabulary(parsed(spark, d).select("tokens"), "tokens")


@query
def character_vocabulary(spark, d):
    return N.characters(parsed(spark, d).select("tokens"), "tokens")


def tagged(spark, d):
    p = parsed(spark, d)
    tags = F.transform("tokens", lambda t, i: F.when(i == 0, "B-TIM").when(i < 3, "I-TIM").when(i == 3, "B-HOS").when(t.rlike("^[0-9]+$"), "B-NUM").otherwise("O"))
    return p.select(F.col("line_id").alias("sent_id"), F.col("tokens").alias("words"), tags.alias("tags"))


@query
def iob_chunks(spark, d):
    return N.chunks(tagged(spark, d))


@query
def chunk_scores(spark, d):
    t = tagged(spark, d)
    guess = t.withColumn("tags", F.transform("tags", lambda x, i: F.when((F.col("sent_id") % 3 == 0) & (x == "B-NUM"), "O").otherwise(x)))
    return N.chunk_scores(t, guess).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query
def conll_sentences(spark, d):
    """Documents as CoNLL-like files: a line is a token line, every seventh a gap."""
    lines = L.doc_lines(spark, d).withColumn("line", F.when(F.col("pos") % 7 == 6, F.lit("")).otherwise(F.col("line")))
    s = L.sentences(lines, "doc_id", "pos", "line")
    return s.select("source", "sent_id", F.size("words").alias("n_words"), F.array_join("words", "|").alias("words"), F.array_join("tags", "|").alias("tags"))


@query
def word_ids(spark, d):
    t = tagged(spark, d)
    vocab = N.vocabulary(t.select(F.transform("words", X.normalized_word).alias("w")).union(spark.createDataFrame([(["$UNK$"],)], T.StructType([T.StructField("w", T.ArrayType(T.StringType()))]))), "w")
    got = N.padded_ids(N.word_ids(t, vocab))
    return got.select("sent_id", "length", joined(F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


@query
def perline(spark, d):
    return K.per_line(assignments(spark, d), L.event_logs(spark, d))


@query
def perabstraction(spark, d):
    return K.per_abstraction(templates(spark, d), assignments(spark, d), L.event_logs(spark, d))


@query
def comparison(spark, d):
    return K.comparison(templates(spark, d), truth(spark, d))


@query
def structured_lines(spark, d):
    return K.structured(parsed(spark, d).select("line_id", "message"), assignments(spark, d), templates(spark, d))


@query
def vertex_order(spark, d):
    return G.by_degree(G.threshold(G.similarity_edges(events(spark, d)), 0.85))


@query
def weakest_sides(spark, d):
    return G.weakest_sides(G.threshold(G.similarity_edges(events(spark, d)), 0.85))


@query
def character_ids(spark, d):
    t = E.split_fields(L.event_logs(spark, d).where("raw is not null")).select(F.col("line_id").alias("sent_id"), F.col("tokens").alias("words"))
    seen = kept(N.seen_characters(t))
    chars = N.vocabulary(seen.where("token <> ''").select(F.array("token").alias("c")), "c")
    most = seen.agg(F.max("words").alias("words"), F.max("letters").alias("letters"))  # the vocabulary has every character
    got = N.padded_characters(N.character_ids(t, chars), most=most)
    text = lambda c, between: F.btrim(F.replace(F.to_json(c), F.lit(between), F.lit("|")), F.lit("[]"))
    return got.select("sent_id", text("ids", "],[").alias("ids"), text("lengths", ",").alias("lengths"))


@query
def template_list(spark, d):
    return K.template_list(templates(spark, d))


@query
def parsed_messages(spark, d):
    p = parsed(spark, d).withColumn("message", F.when(F.col("line_id") % 50 == 0, F.lit("")).otherwise(F.col("message")))
    return K.parsed_messages(p)


@query
def evaluation_table(spark, d):
    """Each service as a file of its own."""
    of = parsed(spark, d).select("line_id", F.element_at("entity_tokens", 5).alias("filename"))
    gt, pred = scored(spark, d)
    return K.with_mean(GT.evaluate(gt.join(of, "line_id"), pred.join(of, "line_id"), "filename").drop("f1")).withColumn("accuracy", F.round("accuracy", 6))


@query
def ground_truth_json(spark, d):
    return K.as_json(truth(spark, d), "gt_id", "template")


def _method(name: str, **params):
    def run(spark, d):
        return abstract(L.event_logs(spark, d), name, **params).abstractions.select("abstraction_id", "abstraction", "n_entity", "n_lines", "first_line")

    return run


#: Parameters that fit the lines of events: their messages have 3 to 7 words.
PARAMETERS = {"logsig": {"k": 6}, "logmine": {"most": 0.4, "widen": 1.0}}
for _name in METHODS:
    QUERIES[f"method_{_name}"] = _method(_name, **PARAMETERS.get(_name, {}))


@query
def local_alignment(spark, d):
    """Every event's message merged with the first of its length by local alignment, in Arrow batches."""
    first = events(spark, d).groupBy("message_length").agg(F.min_by("message", "event_id").alias("head"))

    @F.pandas_udf("string")
    def merge(a, b):
        return a.combine(b, lambda x, y: " ".join(merged(x.split(), y.split())))

    return events(spark, d).join(first, "message_length").select("event_id", merge("head", "message").alias("merged"))
