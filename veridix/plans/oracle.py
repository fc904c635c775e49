"""The same queries in DuckDB's SQL, for the driver's comparison."""

from __future__ import annotations

ORACLE: dict[str, str] = {}
R = "round({0}, 6) AS {1}"

TURNS = """
WITH c AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t0 AS (SELECT conv_id AS session_id, conv_id % 3 = 0 AS is_ego, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx, count(*) OVER (PARTITION BY conv_id) AS total_turn_count,
  conv_id || '-' || turn AS interaction_id, text AS query, CASE WHEN nr = 'assistant' THEN nt ELSE 'I don''t know' END AS agent_response, (('0x' || substr(md5(conv_id || '-' || turn), 1, 8))::BIGINT) % 10 AS h FROM c WHERE role = 'user'),
turns AS (SELECT *, CASE WHEN h < 3 THEN ' ' || agent_response ELSE 'gt ' || h END AS ground_truth, h IN (3, 4) AS verdict FROM t0)"""
FLAGS = TURNS + """,
f0 AS (SELECT *, lower(trim(agent_response)) = lower(trim(ground_truth)) AS is_exact_match, contains(lower(agent_response), 'i don''t know') AS is_miss FROM turns),
f AS (SELECT *, is_exact_match OR (NOT is_miss AND verdict) AS is_correct FROM f0)"""
STOP = FLAGS + """,
p AS (SELECT *, NOT is_correct AND NOT coalesce(lag(is_correct) OVER (PARTITION BY session_id ORDER BY turn_idx), true) AS pair FROM f),
s AS (SELECT *, coalesce(max(pair::INT) OVER (PARTITION BY session_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM p),
a AS (SELECT *, is_correct AND NOT stopped AS adj_correct, is_exact_match AND NOT stopped AS adj_exact, is_miss OR stopped AS adj_miss FROM s)"""

ORACLE["turn_rows"] = TURNS + " SELECT session_id, turn_idx, is_ego, total_turn_count, interaction_id, query, ground_truth, agent_response FROM turns"
ORACLE["turn_history"] = TURNS + """ SELECT session_id, turn_idx, turn_idx AS n_history,
  coalesce(string_agg('user=' || md5(query) || '|assistant=' || md5(agent_response), '|' ORDER BY turn_idx) OVER w, '') AS messages, coalesce(string_agg(interaction_id, ',' ORDER BY turn_idx) OVER w, '') AS history_ids
  FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
ORACLE["turn_flags"] = FLAGS + " SELECT session_id, turn_idx, is_exact_match, is_miss, is_correct AS is_semantically_correct, is_correct, CASE WHEN is_exact_match THEN 'exact' WHEN is_correct THEN 'semantic' WHEN is_miss THEN 'miss' ELSE 'incorrect' END AS status FROM f"
ORACLE["early_stop"] = STOP + " SELECT session_id, turn_idx, is_correct, is_miss, stopped, adj_correct, adj_exact, adj_miss FROM a"
ORACLE["session_scores"] = STOP + " SELECT session_id, round(avg(adj_correct::INT) - avg((NOT adj_correct AND NOT adj_miss)::INT), 6) AS score FROM a GROUP BY 1"
ORACLE["score_dictionary"] = STOP + """,
x AS (SELECT 'all' AS scope, * FROM a UNION ALL SELECT 'ego', * FROM a WHERE is_ego),
g AS (SELECT scope, count(*) AS total, sum(adj_exact::INT)::BIGINT AS correct_exact, sum(adj_correct::INT)::BIGINT AS correct, sum(adj_miss::INT)::BIGINT AS miss FROM x GROUP BY 1),
m AS (SELECT scope, avg(score) AS mean FROM (SELECT scope, session_id, avg(adj_correct::INT) - avg((NOT adj_correct AND NOT adj_miss)::INT) AS score FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT scope, total, correct_exact, correct, miss, total - correct - miss AS hallucination, round(correct_exact / total, 6) AS exact_accuracy, round(correct / total, 6) AS accuracy, round(miss / total, 6) AS missing,
  round((total - correct - miss) / total, 6) AS hallucination_rate, round(CASE WHEN total > 1 THEN (2 * correct + miss) / total - 1 ELSE 0.0 END, 6) AS truthfulness_score, round(mean, 6) AS mean_multi_turn_conversation_score FROM g JOIN m USING (scope)"""
ORACLE["distinct_counts"] = TURNS + " SELECT count(DISTINCT session_id) AS n_sessions, count(DISTINCT interaction_id) AS n_interactions FROM turns"
ORACLE["first_n_sessions"] = TURNS + " SELECT session_id, turn_idx, interaction_id FROM turns WHERE session_id IN (SELECT DISTINCT session_id FROM turns ORDER BY 1 LIMIT 10)"

REVIEWS = """
WITH r0 AS (SELECT doc_id // 20 AS query_id, CASE source WHEN 'src0' THEN 'b0' WHEN 'src1' THEN 'a1' WHEN 'src2' THEN 'a2' WHEN 'src3' THEN 'a3' WHEN 'src4' THEN 'full' ELSE source END AS version,
  CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 0 THEN 'incorrect' WHEN toxic = 1 THEN 'partial' ELSE 'correct' END AS label, doc_id // 20 AS source_order, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, CASE label WHEN 'missing' THEN 'refusal' WHEN 'incorrect' THEN 'quality' WHEN 'partial' THEN 'toxicity' END AS error_cause FROM r0),
s AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT 'primary', * FROM r WHERE source_order >= 10)"""
METRICS = REVIEWS + """,
k AS (SELECT scope, version, count(*) AS total, count(*) FILTER (label = 'correct') AS n_correct, count(*) FILTER (label = 'partial') AS n_partial, count(*) FILTER (label = 'incorrect') AS n_incorrect, count(*) FILTER (label = 'missing') AS n_missing FROM s GROUP BY 1, 2),
m AS (SELECT *, n_correct / total AS accuracy, n_missing / total AS missing, (n_partial + n_incorrect) / total AS hallucination, n_correct / total - (n_partial + n_incorrect) / total AS truthfulness, 1 - n_missing / total AS coverage FROM k)"""
PAIRS = REVIEWS + """,
p AS (SELECT v.scope, v.version, v.query_id, b.label AS base_label, v.label FROM s v JOIN s b ON v.scope = b.scope AND v.query_id = b.query_id AND b.version = 'b0' WHERE v.version <> 'b0')"""
ORACLE["label_metrics"] = METRICS + " SELECT scope, version, total, n_correct, n_partial, n_incorrect, n_missing, " + ", ".join(R.format(c, c) for c in ("accuracy", "missing", "hallucination", "truthfulness", "coverage")) + " FROM m"
ORACLE["paired_deltas"] = METRICS + " SELECT v.scope, v.version, " + ", ".join(R.format(f"v.{c} - b.{c}", f"delta_{c}") for c in ("accuracy", "missing", "hallucination", "truthfulness", "coverage")) + " FROM m v JOIN m b ON v.scope = b.scope AND b.version = 'b0' WHERE v.version <> 'b0'"
_D = {"accuracy": "{0} = 'correct'", "missing": "{0} = 'missing'", "hallucination": "{0} IN ('partial', 'incorrect')"}
_ONE = {m: f"({x.format('label')})::INT - ({x.format('base_label')})::INT" for m, x in _D.items()}
ORACLE["bootstrap_ci"] = PAIRS + f""",
qp AS (SELECT scope, query_id, string_agg(version || ':' || base_label || ':' || label, ',' ORDER BY version) AS pattern FROM p GROUP BY 1, 2),
q AS (SELECT scope, query_id, row_number() OVER (PARTITION BY scope ORDER BY pattern, query_id) - 1 AS i, count(*) OVER (PARTITION BY scope) AS n FROM qp),
dr AS (SELECT scope, b, (('0x' || substr(md5('20260712-' || scope || '-' || b || '-' || (i // 4)), 1 + 8 * (i % 4), 8))::BIGINT) % n AS i FROM q, range(10000) t(b)),
v AS (SELECT p.scope, version, i, {_ONE['accuracy']} AS accuracy, {_ONE['missing']} AS missing, {_ONE['hallucination']} AS hallucination FROM p JOIN q ON p.scope = q.scope AND p.query_id = q.query_id),
x AS (SELECT dr.scope, version, b, sum(accuracy)::DOUBLE / count(*) AS accuracy, sum(missing)::DOUBLE / count(*) AS missing, sum(hallucination)::DOUBLE / count(*) AS hallucination, sum(accuracy - hallucination)::DOUBLE / count(*) AS truthfulness FROM dr JOIN v ON dr.scope = v.scope AND dr.i = v.i GROUP BY 1, 2, 3),
o AS (SELECT scope, version, avg(accuracy) AS accuracy, avg(missing) AS missing, avg(hallucination) AS hallucination, avg(accuracy - hallucination) AS truthfulness FROM v GROUP BY 1, 2),
xl AS (UNPIVOT x ON accuracy, missing, hallucination, truthfulness INTO NAME metric VALUE delta), ol AS (UNPIVOT o ON accuracy, missing, hallucination, truthfulness INTO NAME metric VALUE delta)
SELECT xl.scope, xl.version, xl.metric, round(any_value(ol.delta), 6) AS observed_delta, round(quantile_cont(xl.delta, 0.025), 6) AS ci_low, round(quantile_cont(xl.delta, 0.975), 6) AS ci_high, count(*) AS bootstrap_samples, 20260712::BIGINT AS seed FROM xl JOIN ol ON xl.scope = ol.scope AND xl.version = ol.version AND xl.metric = ol.metric GROUP BY 1, 2, 3"""
ORACLE["mcnemar"] = PAIRS + """,
k AS (SELECT scope, version, count(*) FILTER (base_label = 'correct' AND label <> 'correct') AS b, count(*) FILTER (base_label <> 'correct' AND label = 'correct') AS c FROM p GROUP BY 1, 2)
SELECT scope, version, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))) END, 6) AS p_value FROM k"""
ORACLE["transition_matrix"] = PAIRS + " SELECT scope, version, base_label, label, count(*) AS n FROM p GROUP BY 1, 2, 3, 4"
ORACLE["error_causes"] = REVIEWS + " SELECT scope, version, error_cause, count(*) AS n FROM s WHERE label <> 'correct' GROUP BY 1, 2, 3"
ORACLE["refusal_quality"] = PAIRS + """ SELECT scope, version, count(*) FILTER (label = 'missing') AS missing, count(*) FILTER (label = 'missing' AND base_label = 'correct') AS harmful, count(*) FILTER (label = 'missing' AND base_label = 'missing') AS also_missing,
  count(*) FILTER (label = 'missing' AND base_label IN ('partial', 'incorrect')) AS avoided FROM p GROUP BY 1, 2"""
_G = ", ".join(f"({round(0.05 * i, 2)})" for i in range(1, 20))
GRID = REVIEWS + f""",
cal AS (SELECT b.query_id, (b.n_chars % 101) / 100.0::DOUBLE AS score, b.label AS b0_label, e.label AS enriched_label FROM r b JOIN r e ON b.query_id = e.query_id AND e.version = 'a2' WHERE b.version = 'b0'),
gr(g) AS (SELECT g::DOUBLE FROM (VALUES {_G}) t(g)),
l AS (SELECT lo.g AS tau_low, hi.g AS tau_high, CASE WHEN score <= lo.g THEN 'missing' WHEN score >= hi.g THEN b0_label ELSE enriched_label END AS label FROM gr lo JOIN gr hi ON lo.g < hi.g, cal),
k AS (SELECT tau_low, tau_high, count(*) AS total, count(*) FILTER (label = 'correct') AS c, count(*) FILTER (label = 'missing') AS m, count(*) FILTER (label IN ('partial', 'incorrect')) AS h FROM l GROUP BY 1, 2),
o AS (SELECT round(tau_low, 6) AS tau_low, round(tau_high, 6) AS tau_high, total, round(c / total, 6) AS accuracy, round(m / total, 6) AS missing, round(h / total, 6) AS hallucination, round(c / total - h / total, 6) AS truthfulness, round(1 - m / total, 6) AS coverage, 1 - m / total >= 0.2 AS feasible FROM k)"""
ORACLE["threshold_grid"] = GRID + " SELECT * FROM o"
ORACLE["threshold_best"] = GRID + " SELECT tau_low, tau_high, total, accuracy, missing, hallucination, truthfulness, coverage, (SELECT count(*) FROM o WHERE feasible) AS n_feasible, (SELECT count(*) FROM o WHERE NOT feasible) AS n_rejected FROM o WHERE feasible ORDER BY truthfulness DESC, accuracy DESC, missing, tau_low, tau_high LIMIT 1"
ORACLE["stratified_sample"] = """WITH x AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7-' || doc_id), doc_id) AS rn, md5('7-' || lang || '-' || source) AS hs FROM documents),
y AS (SELECT *, row_number() OVER (ORDER BY rn, hs, doc_id) - 1 AS position FROM x) SELECT position, doc_id, lang, source FROM y WHERE position < 60"""
ORACLE["blind_review_classes"] = REVIEWS + """,
g AS (SELECT source_order, label || '-' || (n_chars % 3) AS answer, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM r GROUP BY 1, 2)
SELECT 'Q' || CASE WHEN length((source_order + 1)::VARCHAR) < 3 THEN lpad((source_order + 1)::VARCHAR, 3, '0') ELSE (source_order + 1)::VARCHAR END AS query_id, row_number() OVER (PARTITION BY source_order ORDER BY md5('11-' || source_order || '-' || answer), answer) AS class_rank, answer, versions FROM g"""
ORACLE["run_alignment"] = """WITH r AS (SELECT (doc_id // 20)::VARCHAR AS query, source AS version FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), n AS (SELECT count(DISTINCT version) AS v FROM r),
z AS (SELECT query, count(*) AS n, count(DISTINCT version) AS versions, 1::BIGINT AS truths FROM r GROUP BY 1)
SELECT query, z.n, versions, truths FROM z, n WHERE z.n <> v OR versions <> v"""

TRACES = """WITH t AS (SELECT event_id, 't' || event_id AS trace_id, user_id % 2 AS gpu, event_type, CASE event_type WHEN 'error' THEN 'abstain' WHEN 'purchase' THEN 'expand' ELSE 'answer' END AS gate_action, CASE event_type WHEN 'error' THEN 'search_error' ELSE 'ok' END AS status,
  value AS total_ms, floor(value) / 2 AS generation_ms, floor(value) AS image_search_ms, floor(value) / 4 AS web_search_ms, 2 + (event_type = 'purchase')::BIGINT AS search_call_count, CASE WHEN event_type = 'purchase' THEN event_id % 3 ELSE 0 END AS additional_web_evidence,
  event_id % 4 AS n_image, event_id % 3 AS n_web, event_id % 60 + 40 AS answer_token_count, event_type = 'error' AS refused FROM events)"""
_SUMMARY = """round(quantile_cont(total_ms, 0.5), 6) AS p50_ms, round(quantile_cont(total_ms, 0.95), 6) AS p95_ms, round(quantile_cont(generation_ms, 0.5), 6) AS generation_p50_ms, round(quantile_cont(generation_ms, 0.95), 6) AS generation_p95_ms,
  round(avg(search_call_count), 6) AS mean_search_calls, sum(search_call_count)::BIGINT AS search_calls, sum(additional_web_evidence)::BIGINT AS additional_evidence,
  count(*) FILTER (gate_action = 'answer') AS n_answer, count(*) FILTER (gate_action = 'expand') AS n_expand, count(*) FILTER (gate_action = 'abstain') AS n_abstain"""
ORACLE["trace_summary"] = TRACES + f" SELECT gpu, count(*) AS n, {_SUMMARY} FROM t GROUP BY 1"
ORACLE["nearest_rank_latency"] = TRACES + """ SELECT event_type, count(*) AS n, round(min(total_ms), 6) AS min_ms, round(quantile_cont(total_ms, 0.5), 6) AS median_ms, round(list_sort(list(total_ms))[round_even(0.5 * (count(*) - 1), 0)::BIGINT + 1], 6) AS p50_nearest_ms,
  round(list_sort(list(total_ms))[round_even(0.95 * (count(*) - 1), 0)::BIGINT + 1], 6) AS p95_nearest_ms, round(max(total_ms), 6) AS max_ms, round(avg(total_ms), 6) AS mean_ms FROM t GROUP BY 1"""
TELE = """WITH t AS (SELECT event_type, user_id % 2 AS gpu, ts, json_extract_string(props, '$.k')::DOUBLE AS mem_mib, least(value, 100.0) AS util, (event_id % 50 + 30)::DOUBLE AS temp_c, (event_id % 300 + 100)::DOUBLE AS power_w FROM events)"""
_GPU = "round(max(mem_mib), 6) AS peak_mem_mib, round(max(util), 6) AS peak_util, round(avg(util), 6) AS mean_util, max(temp_c) AS peak_temp_c, max(power_w) AS peak_power_w"
ORACLE["gpu_summary"] = TELE + f" SELECT gpu, count(*) AS n, {_GPU} FROM t GROUP BY 1"
ORACLE["telemetry_in_run"] = TELE + """, d AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day FROM t)
SELECT strftime(day, '%Y-%m-%d') AS day, gpu, count(*) AS n, round(avg(util), 9) AS mean_util, round(max(epoch_us(ts::TIMESTAMP) - epoch_us(day + INTERVAL 6 HOUR)) / 1e6, 6) AS last_second FROM t JOIN d ON ts::TIMESTAMP BETWEEN day + INTERVAL 6 HOUR AND day + INTERVAL 9 HOUR GROUP BY 1, 2"""
ORACLE["prefetch_status"] = "SELECT CASE WHEN page_id % 5 = 0 THEN 'embedded' WHEN coalesce(url, '') = '' THEN 'missing' WHEN page_id % 3 = 0 THEN 'cached' ELSE 'failed' END AS status, count(*) AS n FROM pages GROUP BY 1"
ORACLE["url_cache_keys"] = r"""WITH p AS (SELECT page_id, url, regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '(\.[A-Za-z0-9]+)$', 1) AS ext FROM pages)
SELECT page_id, md5(url) || CASE WHEN ext = '' THEN '.jpg' ELSE ext END AS md5_key, sha256(url) || '.jpg' AS sha_key, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS is_url FROM pages JOIN p USING (page_id, url)"""
ORACLE["thumbnail_rewrite"] = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/' || page_id || '.jpg/1280px-' || page_id || '.jpg' END AS thumbnail FROM pages"
_ENT = "replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def clean(c: str) -> str:
    out = f"regexp_replace({_ENT.format(c)}, '<br\\s*/?>', ' ', 'gi')"
    for pattern, to, flags in ((r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1", "g"), (r"\{\{URL\|([^{}]+)\}\}", r"\1", "gi"), (r"\{\{convert\|([^|{}]+)\|([^|{}]+)[^{}]*\}\}", r"\1 \2", "gi"), (r"\{\{[^{}]*\}\}", " ", "g"), (r"\s+", " ", "g")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', '{flags}')"
    return f"trim({out}, ' ,;|')"


def clean_v1(c: str) -> str:
    out = f"regexp_replace({c}, '<br\\s*/?>', ' ', 'g')"
    for pattern, to in ((r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1"), (r"\{\{[^{}]*\|([^{}|]+)\}\}", r"\1"), (r"\s+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out}, ' ,;')"


ORACLE["clean_markup_pages"] = f"WITH t AS (SELECT page_id, '[[a|' || url || ']]{{{{convert|7|ft|m|0}}}} {{{{x|y}}}} ' || html AS t FROM pages) SELECT page_id, md5({clean('t')}) AS v2_md5, length({clean('t')}) AS v2_chars, md5({clean_v1('t')}) AS v1_md5, length({clean_v1('t')}) AS v1_chars FROM t"


def toks(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def terms(c: str) -> str:
    stop = "'the','is','a','an','of','in','on','to','what','which','who','how'"
    return f"list_distinct(list_filter({toks(clean('coalesce(' + c + chr(44) + chr(39) * 2 + ')'))}, lambda z: length(z) > 1 AND z NOT IN ({stop})))"


def f1(a: str, b: str) -> str:
    x, y = f"list_distinct({a})", f"list_distinct({b})"
    o = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN {o} > 0 THEN 2 * ({o} / len({y})) * ({o} / len({x})) / ({o} / len({y}) + {o} / len({x})) ELSE 0.0 END"


def rel(q: str, c: str) -> str:
    o = f"len(list_intersect({q}, {c}))"
    return f"CASE WHEN len({c}) > 0 THEN {o} + {o} / greatest(len({q}), 1) ELSE 0.0 END"


def lexical(index: str, queries: str, k: int) -> str:
    """CTEs up to `lx` (query_id, item_id, score, rank)."""
    return f"""ia AS (SELECT item_id, list_distinct({toks('text')}) AS t FROM {index}), qa AS (SELECT query_id, list_distinct({toks('text')}) AS t FROM {queries}),
lt AS (SELECT query_id, item_id, round(2 * (o / len(it)) * (o / len(qt)) / (o / len(it) + o / len(qt)), 6) AS score FROM (SELECT query_id, item_id, qa.t AS qt, ia.t AS it, len(list_intersect(qa.t, ia.t)) AS o FROM qa, ia) WHERE o > 0),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM lt) WHERE rank <= {k})"""


ORACLE["token_f1_benchmark"] = "WITH dq AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 100 = 0), " + lexical("benchmark", "dq", 3) + " SELECT query_id, item_id, score, rank FROM lx"


def knn(k: int) -> str:
    return f"""ks AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label::BIGINT AS label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ks) WHERE rank <= {k})"""


ORACLE["knn_by_cells"] = f"WITH {knn(5)} SELECT query_id, item_id, score, rank, label FROM kn"
ORACLE["repeated_answers"] = TURNS + " SELECT md5(agent_response) AS answer_md5, count(*) AS n FROM turns GROUP BY 1 HAVING count(*) > 1"
ORACLE["knn_topk"] = f"WITH {knn(5)} SELECT query_id, item_id, score, rank, label FROM kn"
KG = f"""pq AS (SELECT p_partkey AS turn_id, 'what is the size of ' || p_name AS query FROM part WHERE p_partkey % 100 = 0), {knn(3)},
kh AS (SELECT query_id AS turn_id, rank AS hit_pos, score, p_name AS entity_name, unnest([0, 1, 2, 3]) AS attr_pos, unnest(['brand', 'type', 'size', 'retail price']) AS field, unnest([p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR]) AS value FROM kn JOIN part ON item_id = p_partkey),
kc AS (SELECT turn_id, query, hit_pos, attr_pos, coalesce(score, 0.0) AS score, {clean("coalesce(entity_name, '')")} AS name, {clean("coalesce(field, '')")} AS f, {clean("coalesce(value, '')")} AS v FROM kh JOIN pq USING (turn_id)),
kr AS (SELECT *, f || ': ' || v AS attr, {rel(terms('query'), terms("name || ' ' || f || ' ' || v"))} AS rel FROM kc WHERE f <> '' AND v <> ''),
kd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id, lower(name), lower(attr) ORDER BY rel DESC, score DESC, hit_pos, attr_pos) AS dn FROM kr) WHERE dn = 1),
kg AS (SELECT turn_id, rank, 'KG' || rank AS evidence_id, CASE WHEN name <> '' THEN name || ' | ' || attr ELSE attr END AS text, score, rel AS query_relevance FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY rel DESC, score DESC, hit_pos, attr_pos) AS rank FROM kd) WHERE rank <= 8)"""
ORACLE["kg_evidence"] = f"WITH {KG} SELECT turn_id, rank, evidence_id, text, round(score, 6) AS score, round(query_relevance, 6) AS query_relevance FROM kg"


def web(items: int, name: str) -> str:
    return f"""{name} AS (SELECT turn_id, rank, 'WEB' || rank AS evidence_id, title || ': ' || snippet AS text, score, rel AS query_relevance, url FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY rel DESC, score DESC, pos) AS rank FROM wd) WHERE rank <= {items})"""


WEB = f"""pf AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_replace(regexp_extract(html, '<p>(.*?)(?:</p>|<p>)', 1), '<[^>]+>', ' ', 'g') AS snippet FROM pages),
wi AS (SELECT page_id AS item_id, title || ' ' || snippet AS text FROM pf), wq AS (SELECT page_id AS query_id, title AS text FROM pf WHERE page_id % 100 = 0), {lexical('wi', 'wq', 5)},
wc AS (SELECT lx.query_id AS turn_id, wq.text AS query, rank AS pos, score, coalesce(nullif({clean("coalesce(title, '')")}, ''), 'Untitled page') AS title, {clean("coalesce(snippet, '')")} AS snippet, {clean("coalesce(url, '')")} AS url FROM lx JOIN pf ON item_id = page_id JOIN wq ON wq.query_id = lx.query_id),
wr AS (SELECT *, {rel(terms('query'), terms("title || ' ' || snippet"))} AS rel FROM wc WHERE snippet <> '' AND score >= 0.05),
wd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id, lower(url), lower(snippet) ORDER BY pos) AS dn FROM wr) WHERE dn = 1), {web(3, 'we')}"""
ORACLE["web_evidence"] = f"WITH {WEB} SELECT turn_id, rank, evidence_id, text, round(score, 6) AS score, round(query_relevance, 6) AS query_relevance, url FROM we"
ORACLE["evidence_budget"] = f"WITH {KG}, b AS (SELECT turn_id, rank, '[' || evidence_id || ' score=' || format('{{:.3f}}', score) || '] ' || text AS line FROM kg), u AS (SELECT *, (sum(length(line)) OVER (PARTITION BY turn_id ORDER BY rank))::BIGINT AS used FROM b) SELECT turn_id, rank, line, used FROM u WHERE used <= 200"
AGREE = f"""{KG}, {WEB},
ai AS (SELECT turn_id, rank, score, trim(split_part(text, ' | ', 1)) AS name, CASE WHEN contains(text, ' | ') THEN substr(text, length(split_part(text, ' | ', 1)) + 4) ELSE '' END AS attr FROM kg),
ag AS (SELECT turn_id, CASE WHEN name = '' THEN '__unnamed_' || (rank - 1) ELSE array_to_string({toks('name')}, ' ') END AS key, min(rank) AS first_rank, max(score) AS best, arg_min(name, rank) AS entity_name, count(*) AS n_items, string_agg(attr, ' ' ORDER BY rank) AS attrs FROM ai GROUP BY 1, 2),
aw AS (SELECT turn_id, string_agg(text, ' ' ORDER BY rank) AS web_text FROM we GROUP BY 1),
ab AS (SELECT turn_id, first_rank, entity_name, n_items, least(1.0, greatest(0.0, best)) AS image_score, {f1(toks('entity_name'), toks('web_text'))} AS web_support, {f1(toks('query'), toks('attrs'))} AS attribute_support FROM ag LEFT JOIN aw USING (turn_id) LEFT JOIN pq USING (turn_id)),
ac AS (SELECT *, 0.5 * image_score + 0.35 * web_support + 0.15 * attribute_support AS entity_score FROM ab),
ar AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY entity_score DESC, first_rank) AS entity_rank FROM ac),
at0 AS (SELECT *, max(CASE WHEN entity_rank = 1 THEN entity_score END) OVER (PARTITION BY turn_id) AS top_score, coalesce(max(CASE WHEN entity_rank = 2 THEN entity_score END) OVER (PARTITION BY turn_id), 0.0) AS second_score FROM ar),
ae AS (SELECT turn_id, entity_rank, entity_name, first_rank, n_items, round(image_score, 6) AS image_score, round(web_support, 6) AS web_support, round(attribute_support, 6) AS attribute_support, round(entity_score, 6) AS entity_score, round(top_score, 6) AS top_score, round(second_score, 6) AS second_score, round(greatest(0.0, top_score - second_score), 6) AS margin FROM at0)"""
ORACLE["entity_agreement"] = f"WITH {AGREE} SELECT * FROM ae"
_CUES = "how many|how much|what year|when|age|number|size|length|width|height|engine|horsepower|capacity|century|date|score|population|distance|weight|speed|duration"


def nums(c: str) -> str:
    return f"list_distinct(regexp_extract_all(regexp_replace(lower(coalesce({c}, '')), '([a-z])[0-9]', '\\1 ', 'g'), '[0-9]+(?:\\.[0-9]+)?'))"


CONFLICT = f"""{AGREE}, ci AS (SELECT turn_id, string_agg(text, ' ' ORDER BY rank) AS image_text FROM kg GROUP BY 1),
cn AS (SELECT turn_id, regexp_matches(query, '(?i)\\b(?:{_CUES})\\b') OR len({nums('query')}) > 0 AS is_numeric, {nums('image_text')} AS a, {nums('web_text')} AS b FROM pq JOIN ci USING (turn_id) LEFT JOIN aw USING (turn_id)),
cf AS (SELECT turn_id, is_numeric, len(a) AS n_image, len(b) AS n_web, is_numeric AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 AS conflict FROM cn)"""
ORACLE["numeric_conflict"] = f"WITH {CONFLICT} SELECT * FROM cf"
ORACLE["gate_actions"] = f"""WITH {CONFLICT}, v AS (SELECT turn_id, top_score, conflict, unnest(['b0', 'a1', 'a2', 'a3', 'full', 'a2_enrich_all']) AS variant FROM ae JOIN cf USING (turn_id) WHERE entity_rank = 1)
SELECT turn_id, variant, top_score, conflict, top_score > 0.45 AND top_score < 0.6 AS in_band, CASE WHEN variant IN ('b0', 'a1') THEN 'answer' WHEN variant = 'a2' THEN CASE WHEN top_score > 0.45 AND top_score < 0.6 THEN 'expand' ELSE 'answer' END
  WHEN variant = 'a3' THEN CASE WHEN conflict OR top_score <= 0.45 THEN 'abstain' ELSE 'answer' END WHEN variant = 'full' THEN CASE WHEN conflict OR top_score <= 0.45 THEN 'abstain' WHEN top_score < 0.6 THEN 'expand' ELSE 'answer' END ELSE CASE WHEN top_score <= 0.45 THEN 'abstain' ELSE 'expand' END END AS action FROM v"""
ORACLE["merge_web_results"] = f"""WITH {WEB}, {web(5, 'w5')}, b AS (SELECT *, 0 AS src FROM we UNION ALL SELECT *, 1 FROM w5),
k AS (SELECT *, row_number() OVER (PARTITION BY turn_id, CASE WHEN coalesce(url, '') <> '' THEN 'u:' || url ELSE 't:' || array_to_string({toks('text')}, ' ') END ORDER BY src, rank) AS dn FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY src, rank) AS nr FROM k WHERE dn = 1) SELECT turn_id, nr AS rank, 'WEB' || nr AS evidence_id, text, round(score, 6) AS score, round(query_relevance, 6) AS query_relevance, url FROM n"""
ORACLE["refusal_reasons"] = TURNS + f""", n AS (SELECT *, {clean('agent_response')} AS a FROM turns), m AS (SELECT *, a = '' OR regexp_matches(a, '(?i)\\bi\\s+(?:do\\s+not|don''t)\\s+know\\b') AS is_idk FROM n)
SELECT session_id, turn_idx, is_idk, CASE WHEN NOT is_idk THEN NULL WHEN h = 0 THEN 'generation_error' WHEN h = 1 THEN 'search_error' WHEN h = 2 THEN 'conflicting_evidence' WHEN h = 3 THEN 'no_retrieval' WHEN a = '' THEN 'empty_generation' ELSE 'insufficient_evidence' END AS refusal_reason FROM m"""
ORACLE["sequence_equality"] = """WITH a AS (SELECT row_number() OVER (ORDER BY event_id) AS position, event_type AS left_value FROM events), b AS (SELECT row_number() OVER (ORDER BY event_id) AS position, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE event_type END AS right_value FROM events WHERE event_id <> 5)
SELECT position, left_value, right_value FROM a FULL JOIN b USING (position) WHERE left_value IS DISTINCT FROM right_value"""
ORACLE["set_equality"] = """SELECT DISTINCT doc_id AS value, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
ORACLE["wave_generation"] = TURNS + r" SELECT session_id, turn_idx, (2 * turn_idx) || ':' || regexp_extract(query, '\S+') AS agent_response FROM turns"
