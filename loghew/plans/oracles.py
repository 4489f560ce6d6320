"""DuckDB SQL of the registered queries."""

from __future__ import annotations

LOGS = r"""
logs AS (SELECT event_id AS line_id, strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 10)::VARCHAR || ' ' || event_type || ': ' || CASE event_type
    WHEN 'signup' THEN 'new account created for user ' || (user_id % 20)::VARCHAR
    WHEN 'purchase' THEN 'order accepted user ' || (user_id % 20)::VARCHAR || ' bucket ' || floor(value / 50)::BIGINT::VARCHAR
    WHEN 'error' THEN 'request failed with code ' || (event_id % 5)::VARCHAR || ' , retrying'
    WHEN 'view' THEN 'page ' || (event_id % 7)::VARCHAR || ' rendered in ' || floor(value / 50)::BIGINT::VARCHAR || ' ms total'
    ELSE 'button ' || (event_id % 3)::VARCHAR || ' pressed' END AS raw FROM events)"""
PARSED = LOGS + r""",
parsed AS (SELECT line_id, raw, string_split(raw, ' ') AS tokens, array_to_string(string_split(raw, ' ')[6:], ' ') AS message, string_split(raw, ' ')[5] AS service FROM logs),
words AS (SELECT *, string_split(message, ' ') AS w, len(string_split(message, ' '))::INT AS length FROM parsed)"""
EVENTS = PARSED + r""",
grouped AS MATERIALIZED (SELECT message, length AS message_length, min(line_id) AS first_line, max(line_id) AS last_line, count(*) AS n_members FROM words GROUP BY message, length),
ev AS MATERIALIZED (SELECT (SELECT count(*) FROM grouped h WHERE h.first_line < g.first_line)::BIGINT AS event_id, message, message_length, first_line, last_line, n_members FROM grouped g),
et AS (SELECT *, string_split(message, ' ') AS t FROM ev)"""
EDGES = EVENTS + r""",
edges AS (SELECT * FROM (SELECT a.message_length, a.event_id AS src, b.event_id AS dst,
    round_even(list_sum(list_transform(range(1, len(a.t) + 1), lambda i: CASE WHEN a.t[i] = b.t[i] THEN len(a.t) - i + 1 ELSE 0 END))::DOUBLE / (len(a.t) * (len(a.t) + 1) / 2), 3) AS weight
  FROM et a JOIN et b ON a.message_length = b.message_length AND a.event_id < b.event_id) WHERE weight > 0)"""


def stars(rows: str, keys: str, items: str) -> str:
    """CTE bodies: tpl(keys, template, n_rows) of rows' list column items."""
    return f"""
pos AS (SELECT {keys}, i, min({items}[i]) AS lo, max({items}[i]) AS hi FROM (SELECT *, unnest(range(1, len({items}) + 1)) AS i FROM {rows}) GROUP BY ALL),
siz AS (SELECT {keys}, min(len({items})) AS n, count(*) AS n_rows, min(line_id) AS first_line FROM {rows} GROUP BY ALL),
tpl AS (SELECT siz.*, coalesce(t.template, '') AS template FROM siz LEFT JOIN (
    SELECT {keys}, string_agg(CASE WHEN lo = hi THEN lo ELSE '*' END, ' ' ORDER BY i) AS template FROM pos JOIN siz USING ({keys}) WHERE i <= n GROUP BY {keys}) t USING ({keys}))"""


FINAL = PARSED + "," + stars("words", "length, service", "tokens") + r""",
fin AS (SELECT (row_number() OVER (ORDER BY first_line) - 1)::BIGINT AS abstraction_id, template AS abstraction, 5 AS n_entity, length, service, n_rows, first_line FROM tpl)"""
LABEL = r"""CASE WHEN contains(lower(raw), 'account created') THEN 0 WHEN contains(lower(raw), 'order accepted') AND contains(lower(raw), 'user 1') THEN 1
  WHEN contains(lower(raw), 'order accepted') THEN 2 WHEN contains(lower(raw), 'request failed') THEN 3 WHEN contains(lower(raw), 'rendered') THEN 4 WHEN contains(lower(raw), 'button') THEN 5 ELSE -1 END"""
TRUTH = PARSED + f""",
lab AS (SELECT *, length AS message_length, {LABEL} AS label_idx, list_sum(list_transform(tokens, lambda x: len(x)))::INT AS total FROM words),""" + stars("lab", "message_length, label_idx, total", "tokens") + r""",
gt AS (SELECT (row_number() OVER (ORDER BY first_line) - 1)::BIGINT AS gt_id, message_length, label_idx, total, template, n_rows, first_line FROM tpl)"""
TAGGED = PARSED + r""",
tagged AS (SELECT line_id AS sent_id, tokens, list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN i = 1 THEN 'B-TIM' WHEN i < 4 THEN 'I-TIM' WHEN i = 4 THEN 'B-HOS' WHEN regexp_full_match(tokens[i], '[0-9]+') THEN 'B-NUM' ELSE 'O' END) AS tags FROM parsed)"""
GENERAL = r"""CASE WHEN length(regexp_replace(word, '[^\p{L}]', '', 'g')) = 1 OR length(regexp_replace(word, '[^\p{Nd}]', '', 'g')) = 1
  OR regexp_full_match(word, '[\p{Nd}!#$%&()*+,\-./:;<=>?@\[\\\]^_{|}~]*') THEN '*' ELSE word END"""
STEP = PARSED + r""",
s1 AS (SELECT line_id, string_split(regexp_replace(regexp_replace(message, '([0-9]+\.){3}[0-9]', '', 'g'), 'node-[0-9]+', 'node-', 'g'), ' ') AS tokens, length::VARCHAR AS part FROM words),
c1 AS (SELECT part, (i - 1)::INT AS pos, count(DISTINCT tokens[i]) AS card FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM s1) GROUP BY ALL),
m2 AS (SELECT part, m[1] AS card, m[2] AS pos FROM (SELECT part, [arg_min(card, card * 1000 + pos), arg_min(pos, card * 1000 + pos)] AS m FROM c1 GROUP BY part)),
s2 AS (SELECT line_id, tokens, m2.card > 1 AS by_column, CASE WHEN m2.card > 1 THEN s1.part || '/c' || m2.pos::INT::VARCHAR || '/' || tokens[m2.pos::INT + 1] ELSE s1.part END AS part FROM s1 JOIN m2 USING (part))"""
STEP3 = STEP + r""",
k AS (SELECT part, (i - 1)::INT AS pos, count(DISTINCT tokens[i]) AS card FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM s2) GROUP BY ALL),
kf AS (SELECT *, count(*) OVER (PARTITION BY part, card) AS freq FROM k),
sh AS (SELECT part, count(*) AS n, avg((card = 1)::INT) AS constant, max(freq) AS most, min(freq) AS least FROM kf GROUP BY part),
nx AS (SELECT kf.part, max(freq) FILTER (WHERE freq < most) AS down, min(freq) FILTER (WHERE freq > least) AS up FROM kf JOIN sh USING (part) GROUP BY kf.part),
sp AS (SELECT part, bool_or(by_column) AS split FROM s2 GROUP BY part),
ch AS (SELECT sh.part, n, constant, split,
    (SELECT min(pos) FROM kf WHERE kf.part = sh.part AND freq = most) AS t1,
    (SELECT arg_min(card, pos) FROM kf WHERE kf.part = sh.part AND freq = most) AS tcard,
    (SELECT list_sort(list(pos))[2] FROM kf WHERE kf.part = sh.part AND freq = most) AS t2,
    (SELECT min(pos) FROM kf WHERE kf.part = sh.part AND freq = down) AS td,
    (SELECT min(pos) FROM kf WHERE kf.part = sh.part AND freq = least) AS l1,
    (SELECT min(pos) FROM kf WHERE kf.part = sh.part AND freq = up) AS l2
  FROM sh JOIN nx USING (part) JOIN sp USING (part)),
pp AS (SELECT part, split, CASE WHEN n = 2 THEN 0 WHEN split THEN t1 ELSE l1 END AS p1, CASE WHEN n = 2 THEN 1 WHEN split THEN CASE WHEN tcard > 1 AND t2 IS NOT NULL THEN t2 ELSE td END ELSE l2 END AS p2
  FROM ch WHERE n = 2 OR (n > 2 AND constant < 0.175)),
pr AS (SELECT s2.*, p1, p2, pp.split, tokens[p1 + 1] AS w1, tokens[p2 + 1] AS w2 FROM s2 JOIN pp USING (part) WHERE p1 IS NOT NULL AND p2 IS NOT NULL),
fan AS (SELECT part, w1, w2, any_value(split) AS split, count(DISTINCT w2) OVER (PARTITION BY part, w1) AS fan1, count(DISTINCT w1) OVER (PARTITION BY part, w2) AS fan2, sum(count(*)) OVER (PARTITION BY part, w1) AS n1, sum(count(*)) OVER (PARTITION BY part, w2) AS n2 FROM pr GROUP BY part, w1, w2),
rel AS (SELECT *, fan1 = 1 AND fan2 = 1 AS oo, fan1 > 1 AND max(fan2) OVER (PARTITION BY part, w1) = 1 AS om, fan2 > 1 AND max(fan1) OVER (PARTITION BY part, w2) = 1 AS mo FROM fan),
rst AS (SELECT part, count(DISTINCT w1) AS d1, count(DISTINCT w2) AS d2 FROM rel WHERE NOT (oo OR om OR mo) GROUP BY part),
ky AS (SELECT rel.part, w1, w2, CASE WHEN oo THEN '1:' || w1 WHEN om THEN CASE WHEN fan1 / n1 <= 0.25 THEN '2:' || w2 ELSE '1:' || w1 END
    WHEN mo THEN CASE WHEN fan2 / n2 <= 0.25 THEN '1:' || w1 ELSE '2:' || w2 END WHEN split THEN 'rest' WHEN d1 < d2 THEN '1:' || w1 ELSE '2:' || w2 END AS key FROM rel LEFT JOIN rst USING (part)),
s3 AS (SELECT s2.line_id, s2.tokens, CASE WHEN ky.key IS NULL THEN s2.part ELSE s2.part || '/' || ky.key END AS part FROM s2 LEFT JOIN pr USING (line_id) LEFT JOIN ky ON ky.part = s2.part AND ky.w1 = pr.w1 AND ky.w2 = pr.w2)"""

BOTH = TRUTH + "," + FINAL.replace("pos AS", "pos2 AS").replace("FROM pos ", "FROM pos2 ").replace("siz AS", "siz2 AS").replace("siz.*", "siz2.*").replace("FROM siz ", "FROM siz2 ").replace("JOIN siz ", "JOIN siz2 ").replace("tpl AS", "tpl2 AS").replace("FROM tpl)", "FROM tpl2)")[len(PARSED) + 1:]
SCORED = BOTH + r""",
known AS (SELECT template, max(gt_id) AS id FROM gt GROUP BY 1),
ids AS (SELECT abstraction_id, coalesce(id, (SELECT count(*) FROM gt) + row_number() OVER (PARTITION BY id IS NULL ORDER BY abstraction_id) - 1)::BIGINT AS new_id FROM fin LEFT JOIN known ON rtrim(abstraction) = known.template),
both_ AS (SELECT w.line_id, w.service AS filename, gt.gt_id AS g, ids.new_id AS p FROM lab w JOIN gt USING (message_length, label_idx, total) JOIN fin ON fin.length = w.length AND fin.service = w.service JOIN ids ON ids.abstraction_id = fin.abstraction_id)"""


def metrics(by: str) -> str:
    """CTE bodies: m(by, tp, fp, fn, precision, recall) of both_."""
    return f"""
q AS (SELECT {by}g, count(*) AS n, count(DISTINCT p) AS ids FROM both_ GROUP BY ALL), seen AS (SELECT DISTINCT {by}p AS g, TRUE AS hit FROM both_),
h AS (SELECT q.*, coalesce(hit, FALSE) AS hit FROM q LEFT JOIN seen USING ({by}g)),
s AS (SELECT {by}coalesce(sum(n) FILTER (hit), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (NOT hit AND ids = 1), 0)::DOUBLE AS fp, coalesce(sum(n) FILTER (NOT hit AND ids <> 1), 0)::DOUBLE AS fn FROM h GROUP BY ALL),
m AS (SELECT *, round_even(tp / nullif(tp + fp, 0), 3) AS precision, round_even(tp / nullif(tp + fn, 0), 3) AS recall FROM s)"""


ORACLES: dict[str, str] = {
    "log_scan": "SELECT doc_id AS source, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS line_id, line AS raw FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line, ' \t\r\n') <> ''",
    "tokenize": f"WITH {LOGS} SELECT line_id, len(string_split(raw, ' '))::INT AS n_tokens, replace(raw, ' ', '|') AS tokens FROM logs",
    "field_split": f"WITH {PARSED} SELECT line_id, array_to_string(tokens[1:3], ' ') AS timestamp, tokens[4] AS hostname, tokens[5] AS service, message, 5 AS n_entity FROM parsed",
    "field_assembly": f"WITH {PARSED} SELECT line_id, 'TIM=' || array_to_string(tokens[1:3], ' ') || ';HOS=' || tokens[4] || ';SER=' || tokens[5] || ';message=' || message AS fields FROM parsed",
    "unique_events": f"WITH {EVENTS} SELECT * FROM ev",
    "length_groups": f"WITH {EVENTS} SELECT message_length, count(*) AS n_events, sum(n_members)::BIGINT AS n_lines FROM ev GROUP BY 1",
    "asterisk_templates": f"WITH {PARSED}, {stars('words', 'length, service', 'w')} SELECT length AS message_length, service, template, n_rows FROM tpl",
    "final_abstraction": f"WITH {FINAL} SELECT abstraction_id, abstraction, n_entity, n_rows AS n_lines, first_line FROM fin",
    "wordlist_label": f"WITH {LOGS} SELECT {LABEL} AS label_idx, count(*) AS n, min(line_id) AS first_line FROM logs GROUP BY 1",
    "ground_truth_templates": f"WITH {TRUTH} SELECT * FROM gt",
    "gt_id_remap": f"WITH {SCORED} SELECT abstraction_id, new_id FROM ids",
    "eval_metrics": f"WITH {SCORED}, {metrics(str())} SELECT *, round_even(2 * precision * recall / nullif(precision + recall, 0), 3) AS accuracy, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM m",
    "weighted_hamming_edges": f"WITH {EDGES} SELECT * FROM edges",
    "hamming_expression": f"WITH {EDGES} SELECT * FROM edges",
    "graph_density": f"""WITH {EDGES}, v AS (SELECT message_length, count(*) AS vertices FROM ev GROUP BY 1), e AS (SELECT message_length, count(*) AS edges FROM edges GROUP BY 1),
d AS (SELECT message_length, vertices, coalesce(edges, 0) AS edges, CASE WHEN vertices > 1 THEN 2.0::DOUBLE * coalesce(edges, 0) / (vertices * (vertices - 1)) ELSE 0.0::DOUBLE END AS density FROM v LEFT JOIN e USING (message_length))
SELECT *, density > 0.8 AND density <= 1.0 AND edges >= 10000 AS forced FROM d""",
    "isolates": f"WITH {EDGES} SELECT message_length, event_id FROM ev WHERE event_id NOT IN (SELECT src FROM edges WHERE weight >= 0.9 UNION SELECT dst FROM edges WHERE weight >= 0.9)",
    "threshold_edges": f"WITH {EDGES} SELECT * FROM edges WHERE weight >= 0.75",
    "lightest_edge": f"WITH {EDGES} SELECT message_length, src, dst, weight FROM edges QUALIFY row_number() OVER (PARTITION BY message_length ORDER BY weight, src, dst) = 1",
    "pair_split": f"""WITH {EDGES}, l AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY message_length ORDER BY weight, src, dst) = 1)
SELECT message_length, src::VARCHAR || '|' || dst::VARCHAR AS nodes FROM l WHERE weight >= 0.6 UNION ALL SELECT message_length, src::VARCHAR FROM l WHERE weight < 0.6 UNION ALL SELECT message_length, dst::VARCHAR FROM l WHERE weight < 0.6""",
    "force_clusters": "WITH RECURSIVE " + EDGES + """, b AS (SELECT src, dst FROM edges WHERE weight >= 0.75 UNION SELECT dst, src FROM edges WHERE weight >= 0.75),
r(node, seen) AS (SELECT event_id, event_id FROM ev UNION SELECT b.dst, r.seen FROM r JOIN b ON r.node = b.src WHERE r.seen < b.dst)
SELECT node AS event_id, min(seen) AS cluster FROM r GROUP BY 1""",
    "triangles": f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE weight >= 0.85)
SELECT x.message_length, count(*) AS n, sum(x.src + x.dst + y.dst)::BIGINT AS ids, min(least(x.weight, y.weight, z.weight)) AS weakest FROM e x JOIN e y ON x.dst = y.src AND x.message_length = y.message_length JOIN e z ON z.src = x.src AND z.dst = y.dst AND z.message_length = x.message_length GROUP BY 1""",
    "word_generalize": f"""WITH {LOGS}, u AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents UNION ALL SELECT unnest(string_split(raw, ' ')) FROM logs))
SELECT word, {GENERAL} AS class FROM u""",
    "over_abstraction": f"""WITH {PARSED}, {stars('words', 'length, service', 'w')}, x AS (SELECT *, string_split(template, ' ') AS t, len(list_filter(string_split(template, ' '), lambda y: y = '*'))::INT AS n_stars FROM tpl)
SELECT length AS message_length, service, n_stars, n_stars = len(t) - 1 AND len(t) > 3 AS over, regexp_full_match(template, '[* ]*[*][* ]*') AS only_stars FROM x""",
    "merge_test": f"""WITH {EVENTS}, s AS (SELECT * FROM et), g AS (SELECT DISTINCT word FROM (SELECT unnest(t) AS word FROM s)), cls AS (SELECT word, {GENERAL} AS c FROM g),
p AS (SELECT a.event_id, b.event_id AS other, a.t, b.t AS u, unnest(range(1, len(a.t) + 1)) AS i FROM s a JOIN s b ON a.message_length = b.message_length AND a.event_id < b.event_id)
SELECT event_id, other, bool_and(t[i] = u[i] OR t[i] = '*' OR x.c = y.c) AS mergeable, string_agg(CASE WHEN t[i] = u[i] THEN t[i] ELSE '*' END, '|' ORDER BY i) AS template FROM p JOIN cls x ON x.word = t[i] JOIN cls y ON y.word = u[i] GROUP BY 1, 2""",
    "drain_similarity": f"""WITH {EVENTS}, h AS (SELECT message_length, arg_min(t, event_id) AS h FROM et GROUP BY 1)
SELECT event_id, len(list_filter(range(1, len(h) + 1), lambda i: h[i] = t[i] AND h[i] <> '*'))::DOUBLE / len(h) AS similarity, len(list_filter(h, lambda y: y = '*'))::INT AS n_stars FROM et JOIN h USING (message_length)""",
    "logmine_distance": f"""WITH {EVENTS}, h AS (SELECT message_length, arg_min(t, event_id) AS h FROM et GROUP BY 1), x AS (SELECT event_id, round(1.0::DOUBLE - len(list_filter(range(1, len(h) + 1), lambda i: h[i] = t[i]))::DOUBLE / len(h), 6) AS distance FROM et JOIN h USING (message_length))
SELECT event_id, distance, distance AS pattern FROM x""",
    "iplom_step1": f"WITH {STEP} SELECT part, count(*) AS n, min(line_id) AS first_line FROM s1 GROUP BY 1",
    "iplom_cardinalities": f"WITH {STEP} SELECT * FROM c1",
    "iplom_step2": f"WITH {STEP} SELECT part, by_column, count(*) AS n, min(line_id) AS first_line FROM s2 GROUP BY ALL",
    "iplom_step3": f"WITH {STEP3} SELECT part, count(*) AS n, min(line_id) AS first_line FROM s3 GROUP BY 1",
    "iplom_step4": f"WITH {STEP3}, {stars('s3', 'part', 'tokens')} SELECT part, template, n_rows FROM tpl",
    "logsig_term_pairs": f"WITH {PARSED}, x AS (SELECT length, w, unnest(range(1, len(w) + 1)) AS j FROM words), y AS (SELECT length, w[j] AS w1, unnest(w[j + 1:]) AS w2 FROM x) SELECT length, w1, w2, count(*) AS n FROM y GROUP BY ALL",
    "logsig_signature": f"""WITH {PARSED}, z AS (SELECT length, count(*) AS lines FROM words GROUP BY 1), o AS (SELECT length, x, count(*) AS n FROM (SELECT length, unnest(list_distinct(w)) AS x FROM words) GROUP BY ALL),
f AS (SELECT o.length, x FROM o JOIN z USING (length) WHERE n >= ceil(lines / 2)), u AS (SELECT length, line_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words),
s AS (SELECT u.length, line_id, string_agg(u.x, ' ' ORDER BY i) AS signature FROM u JOIN f ON u.length = f.length AND u.x = f.x GROUP BY ALL),
c AS (SELECT length, signature, count(*) AS n, min(line_id) AS l FROM s GROUP BY ALL) SELECT length, signature FROM c QUALIFY row_number() OVER (PARTITION BY length ORDER BY n DESC, l) = 1""",
    "logformat_scan": f"""WITH {PARSED} SELECT line_id, tokens[1] AS "Month", tokens[2] AS "Day", tokens[3] AS "Time", tokens[4] AS "Host", rtrim(tokens[5], ':') AS "Service", message AS "Content" FROM parsed""",
    "regex_removal": f"WITH {PARSED}, x AS (SELECT line_id, string_split(regexp_replace(regexp_replace(raw, '[0-9]+:[0-9]+:[0-9]+', '<time>', 'g'), 'host[0-9]+', 'host', 'g'), ' ') AS t FROM parsed) SELECT line_id, array_to_string(list_concat([t[2]], t[4:]), '|') AS tokens FROM x",
    "template_occurrences": f"WITH {FINAL} SELECT abstraction, sum(n_rows)::BIGINT AS n, substring(md5(abstraction), 1, 8) AS event_hash FROM fin GROUP BY 1",
    "vocabulary": f"WITH {PARSED} SELECT (row_number() OVER (ORDER BY token) - 1)::INT AS idx, token FROM (SELECT DISTINCT unnest(tokens) AS token FROM parsed)",
    "character_vocabulary": f"WITH {PARSED} SELECT DISTINCT unnest(string_split(replace(raw, ' ', ''), '')) AS token FROM parsed",
    "iob_chunks": f"""WITH {TAGGED}, x AS (SELECT sent_id, unnest(range(0, len(tags))) AS p, unnest(tags) AS t FROM tagged)
SELECT sent_id, 'TIM' AS type, 0 AS start, 3 AS "end" FROM tagged UNION ALL SELECT sent_id, t[3:], p::INT, p::INT + 1 FROM x WHERE t IN ('B-HOS', 'B-NUM')""",
    "chunk_scores": f"""WITH {TAGGED}, x AS (SELECT sent_id, unnest(tags) AS t FROM tagged), n AS (SELECT count(*) AS n, count(*) FILTER (t LIKE 'B-%') AS truth, count(*) FILTER (sent_id % 3 = 0 AND t = 'B-NUM') AS lost FROM x)
SELECT round(100.0::DOUBLE * (n - lost) / n, 6) AS accuracy, 100.0::DOUBLE AS precision, round(100.0::DOUBLE * (truth - lost) / truth, 6) AS recall, round(100.0::DOUBLE * 2 * (truth - lost) / (truth + truth - lost), 6) AS f1 FROM n""",
    "conll_sentences": """WITH l AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
m AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 6 THEN '' ELSE line END AS line FROM l WHERE line <> ''),
g AS (SELECT *, trim(line) = '' OR starts_with(line, '-DOCSTART-') AS cut, sum((trim(line) = '' OR starts_with(line, '-DOCSTART-'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM m),
s AS (SELECT doc_id, gap, count(*)::INT AS n_words, string_agg(string_split(line, ' ')[1], '|' ORDER BY pos) AS words, string_agg(string_split(line, ' ')[-1], '|' ORDER BY pos) AS tags FROM g WHERE NOT cut GROUP BY ALL)
SELECT doc_id AS source, (row_number() OVER (PARTITION BY doc_id ORDER BY gap) - 1)::INT AS sent_id, n_words, words, tags FROM s""",
    "word_ids": f"""WITH {TAGGED}, x AS (SELECT sent_id, p, CASE WHEN regexp_full_match(w, '[0-9]+') THEN '$NUM$' ELSE lower(w) END AS w FROM (SELECT sent_id, unnest(range(0, len(tokens))) AS p, unnest(tokens) AS w FROM tagged)),
v AS (SELECT row_number() OVER (ORDER BY token) - 1 AS idx, token FROM (SELECT DISTINCT w AS token FROM x UNION SELECT '$UNK$')),
i AS (SELECT sent_id, list(coalesce(v.idx, (SELECT idx FROM v WHERE token = '$UNK$')) ORDER BY p) AS ids FROM x LEFT JOIN v ON v.token = x.w GROUP BY 1)
SELECT sent_id, len(ids)::INT AS length, array_to_string(list_resize(ids, (SELECT max(len(ids)) FROM i), 0), '|') AS ids FROM i""",
    "perline": f"WITH {FINAL} SELECT line_id, abstraction_id::VARCHAR || '; ' || raw AS text FROM words JOIN fin USING (length, service)",
    "perabstraction": f"""WITH {FINAL} SELECT abstraction_id, -1::BIGINT AS line_id, 'Abstraction #' || abstraction_id::VARCHAR || ' ' || abstraction AS text FROM fin
UNION ALL SELECT abstraction_id, line_id, line_id::VARCHAR || ' ' || raw FROM words JOIN fin USING (length, service) UNION ALL SELECT abstraction_id, NULL, '' FROM fin""",
    "comparison": f"""WITH {BOTH}, t AS (SELECT trim(template) AS key, max(gt_id) AS gt_id, arg_max(template, gt_id) AS truth FROM gt GROUP BY 1)
SELECT abstraction_id, abstraction, gt_id, truth, repeat('-', len(truth) + 1) AS rule FROM fin LEFT JOIN t ON trim(abstraction) = key""",
    "template_list": f"WITH {FINAL} SELECT abstraction_id, '#' || abstraction_id::VARCHAR || ' ' || abstraction AS text FROM fin",
    "parsed_messages": f"WITH {PARSED} SELECT line_id, CASE WHEN line_id % 50 = 0 THEN 'loghew: no message found' ELSE message END AS message FROM parsed",
    "evaluation_table": f"""WITH {SCORED}, {metrics('filename, ')}, o AS (SELECT *, round_even(2 * precision * recall / nullif(precision + recall, 0), 3) AS accuracy FROM m)
SELECT * FROM o UNION ALL SELECT '------', NULL, NULL, NULL, NULL, NULL, round(avg(accuracy), 6) FROM o""",
    "structured_lines": f"WITH {FINAL} SELECT line_id, message, abstraction AS \"EventTemplate\", substring(md5(abstraction), 1, 8) AS \"EventId\" FROM words JOIN fin USING (length, service)",
    "ground_truth_json": f"""WITH {TRUTH} SELECT '{{' || string_agg('"' || gt_id::VARCHAR || '":"' || template || '"', ',' ORDER BY gt_id::VARCHAR) || '}}' AS value FROM gt""",
    "method_iplom": f"""WITH {STEP3}, r AS (SELECT s3.part, words.line_id, words.tokens FROM s3 JOIN words USING (line_id)), {stars('r', 'part', 'tokens')}
SELECT (row_number() OVER (ORDER BY first_line) - 1)::BIGINT AS abstraction_id, template AS abstraction, 5 AS n_entity, n_rows AS n_lines, first_line FROM tpl""",
    "vertex_order": f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE weight >= 0.85), v AS (SELECT message_length, event_id, count(*) AS degree FROM (SELECT message_length, src AS event_id FROM e UNION ALL SELECT message_length, dst FROM e) GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY message_length ORDER BY degree DESC, event_id))::INT AS place FROM v""",
    "weakest_sides": f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE weight >= 0.85),
t AS (SELECT x.message_length, [x.src, x.dst] AS ab, [y.src, y.dst] AS bc, [z.src, z.dst] AS ac, x.weight AS wab, y.weight AS wbc, z.weight AS wac FROM e x JOIN e y ON x.dst = y.src AND x.message_length = y.message_length JOIN e z ON z.src = x.src AND z.dst = y.dst AND z.message_length = x.message_length),
k AS (SELECT DISTINCT message_length, CASE WHEN (wab, ab) < (wbc, bc) AND (wab, ab) < (wac, ac) THEN ab WHEN (wac, ac) < (wbc, bc) THEN ac ELSE bc END AS g FROM t)
SELECT e.* FROM e LEFT JOIN k ON k.message_length = e.message_length AND k.g[1] = src AND k.g[2] = dst WHERE k.g IS NULL""",
    "character_ids": f"""WITH {PARSED}, v AS (SELECT (row_number() OVER (ORDER BY token) - 1)::INT AS idx, token FROM (SELECT DISTINCT unnest(string_split(replace(raw, ' ', ''), '')) AS token FROM parsed)),
w AS (SELECT line_id, unnest(range(1, len(tokens) + 1)) AS p, unnest(tokens) AS w FROM parsed), c AS (SELECT line_id, p, unnest(range(1, len(w) + 1)) AS i, unnest(string_split(w, '')) AS token FROM w),
z AS (SELECT max(len(tokens)) AS words, (SELECT max(len(w)) FROM w) AS letters FROM parsed),
x AS (SELECT line_id, p, list(idx ORDER BY i) AS ids FROM c JOIN v USING (token) GROUP BY ALL),
y AS (SELECT line_id, list(array_to_string(list_resize(ids, letters, 0), ',') ORDER BY p) AS ids, list(len(ids) ORDER BY p) AS lengths FROM x, z GROUP BY 1)
SELECT line_id AS sent_id, array_to_string(list_resize(ids, words, array_to_string(list_resize([0], letters, 0), ',')), '|') AS ids, array_to_string(list_resize(lengths, words, 0), '|') AS lengths FROM y, z""",
}
