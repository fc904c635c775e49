"""SQL of the queries through files and over runs, reviews, prompts and searches."""

from __future__ import annotations

from veridix.plans.oracle import _GPU, _SUMMARY, AGREE, FLAGS, KG, REVIEWS, STOP, TELE, TRACES, TURNS, WEB, clean, clean_v1

ORACLE: dict[str, str] = {}
IDK = "I don''t know"

# ---------------------------------------------------------------- through files

ORACLE["dataset_split"] = "SELECT n_nationkey, n_name FROM nation"
ORACLE["manifest_rows"] = """WITH x AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7-' || doc_id), doc_id) AS rn, md5('7-' || lang || '-' || source) AS hs FROM documents),
y AS (SELECT *, row_number() OVER (ORDER BY rn, hs, doc_id) - 1 AS pos FROM x) SELECT pos, doc_id, lang, source FROM y WHERE pos < 20"""
ORACLE["run_csv"] = REVIEWS + """ SELECT query_id::VARCHAR AS query, 'the truth' AS ground_truth, label || ', "quoted"' || chr(10) || 'answer' AS agent_response FROM r WHERE version = 'b0'"""
ORACLE["reviewed_results"] = REVIEWS + """ SELECT query_id::VARCHAR AS query, 'the truth' AS ground_truth, label || ', "quoted"' || chr(10) || 'answer' AS answer, label, error_cause AS cause, 'n' || n_chars AS note FROM r WHERE version = 'a1'"""
ORACLE["telemetry_csv"] = TELE + f" SELECT gpu, count(*) AS n, {_GPU}, strftime(min(ts), '%Y-%m-%d %H') AS first_hour FROM t GROUP BY 1"
ORACLE["trace_files"] = TRACES + " SELECT gate_action, status, count(*) AS n, count(DISTINCT trace_id) AS n_traces, sum(search_call_count)::BIGINT AS search_calls, max(answer_token_count) AS most_tokens, round(max(total_ms), 6) AS max_ms FROM t GROUP BY 1, 2"
ORACLE["json_documents"] = "SELECT r_name AS region, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"
ORACLE["results_files"] = STOP + """, s2 AS (SELECT *, CASE WHEN is_exact_match THEN 'exact' WHEN is_correct THEN 'semantic' WHEN is_miss THEN 'miss' ELSE 'incorrect' END AS status FROM a WHERE is_ego)
SELECT session_id, turn_idx, status, (SELECT count(*) FROM s2) AS ego_turns FROM s2"""
ORACLE["hydrated_entities"] = "SELECT p_partkey, p_name AS entity_name, p_brand AS brand, p_type AS kind FROM part"
ORACLE["page_content"] = f"WITH {WEB} SELECT lx.query_id AS turn_id, rank AS pos, pages.url AS page_url, length(html) AS n_chars, md5(html) AS content_md5 FROM lx JOIN pages ON item_id = page_id"

# ---------------------------------------------------------------- runs

ORACLE["run_counters"] = TRACES + " SELECT gpu, count(*) AS n, count(*) FILTER (status <> 'ok') AS run_failures, count(*) FILTER (n_image = 0 AND n_web = 0) AS empty_retrieval, count(*) FILTER (refused) AS refusals, count(*) FILTER (answer_token_count > 75) AS over_tokens FROM t GROUP BY 1"
ORACLE["evidence_stats"] = TRACES + """ SELECT event_type, count(*) FILTER (n_image > 0 AND n_web > 0) AS both_sources, min(answer_token_count) AS min_tokens, max(answer_token_count) AS max_tokens,
  quantile_cont(n_image::DOUBLE, 0.5) AS image_median, quantile_cont(n_web::DOUBLE, 0.5) AS web_median, quantile_cont(answer_token_count::DOUBLE, 0.5) AS tokens_median FROM t GROUP BY 1"""
ORACLE["latency_rows"] = TRACES + " SELECT trace_id, image_search_ms AS image_ms, web_search_ms AS web_ms, generation_ms, round(total_ms, 3) AS total_ms, answer_token_count AS answer_tokens, n_image AS image_evidence, n_web AS web_evidence FROM t"
ORACLE["prefetch_report"] = "SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'embedded' WHEN coalesce(url, '') = '' THEN 'missing' WHEN page_id % 3 = 0 THEN 'cached' ELSE 'failed' END AS status FROM pages"
ORACLE["review_histograms"] = REVIEWS + " SELECT 'label' AS field, label AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'error_cause', error_cause, count(*) FROM r GROUP BY 2"
ORACLE["accepted_runs"] = """WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
p AS (SELECT doc_id // 30 AS run_key, count(*) AS trace_count, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM bad)) AS result_count FROM documents GROUP BY 1)
SELECT run_key, trace_count, result_count, trace_count - result_count AS set_gap, run_key % 7 <> 3 AND run_key % 5 <> 4 AND trace_count = 30 AND result_count = 30 AS valid FROM p"""
ORACLE["run_metrics"] = TRACES + f""", e AS (SELECT event_type, user_id % 2 AS gpu, json_extract_string(props, '$.k')::DOUBLE AS mem_mib, least(value, 100.0) AS util, (event_id % 50 + 30)::DOUBLE AS temp_c, (event_id % 300 + 100)::DOUBLE AS power_w FROM events),
a AS (SELECT event_type, gpu, count(*) AS n, {_SUMMARY} FROM t GROUP BY 1, 2), b AS (SELECT event_type, gpu, count(*) AS telemetry_rows, {_GPU} FROM e GROUP BY 1, 2)
SELECT event_type AS pair_dir, 'g' || gpu AS side, * EXCLUDE (event_type) FROM a JOIN b USING (event_type, gpu)"""
ORACLE["label_domain"] = REVIEWS + " SELECT version, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM r WHERE label NOT IN ('correct', 'missing') GROUP BY 1"
ORACLE["primary_positions"] = REVIEWS + ", q AS (SELECT DISTINCT query_id, source_order FROM r WHERE source_order >= 10) SELECT *, row_number() OVER (ORDER BY source_order, query_id) - 1 AS position FROM q"


def padded(prefix: str, n: str) -> str:
    return f"'{prefix}' || CASE WHEN length(({n})::VARCHAR) < 3 THEN lpad(({n})::VARCHAR, 3, '0') ELSE ({n})::VARCHAR END"


SHEET = REVIEWS + f""",
g AS (SELECT DISTINCT source_order, label || '-' || (n_chars % 3) AS answer, label FROM r),
sh AS (SELECT *, row_number() OVER (ORDER BY md5('11-' || source_order || '-' || answer), source_order, answer) AS k FROM g),
st AS (SELECT {padded('R', 'k')} AS response_id, {padded('Q', 'source_order + 1')} AS query_id, source_order, source_order::VARCHAR AS query, 't' AS ground_truth, answer, label AS given FROM sh)"""
ORACLE["review_sheets"] = SHEET + " SELECT response_id, query_id, source_order, query, ground_truth, answer, '' AS label FROM st"
ORACLE["expanded_reviews"] = SHEET + " SELECT response_id, st.query_id, version, given AS label, st.source_order FROM st JOIN r ON st.source_order = r.source_order AND st.answer = r.label || '-' || (r.n_chars % 3)"

# ---------------------------------------------------------------- turns

ORACLE["exploded_turns"] = TURNS + " SELECT session_id, turn_idx, is_ego, total_turn_count, interaction_id, query, 'a: ' || agent_response AS ground_truth FROM turns WHERE session_id NOT IN (0, 3)"
ORACLE["first_turns"] = TURNS + " SELECT session_id, arg_min(query, turn_idx) AS query, arg_max(interaction_id, turn_idx) AS last_interaction_id FROM turns GROUP BY 1"
ORACLE["forced_answers"] = TURNS + rf" SELECT session_id, turn_idx, CASE WHEN h < 2 THEN '{IDK}' ELSE (2 * turn_idx) || ':' || regexp_extract(query, '\S+') END AS agent_response FROM turns"
ORACLE["judged_turns"] = FLAGS + """, j AS (SELECT *, CASE WHEN NOT is_exact_match AND NOT is_miss THEN length(query) % 2 = 0 END AS v FROM f)
SELECT session_id, turn_idx, v AS verdict, CASE WHEN is_exact_match THEN 'exact' WHEN v THEN 'semantic' WHEN is_miss THEN 'miss' ELSE 'incorrect' END AS status FROM j"""
ORACLE["history_queries"] = TURNS + f""", h AS (SELECT *, lag(query) OVER w AS q1, lag(agent_response) OVER w AS a1 FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_idx)),
p AS (SELECT session_id, turn_idx, [query, 'a picture, ', coalesce(q1, ''), coalesce('a ' || a1, '')] AS parts FROM h)
SELECT session_id, turn_idx, substr(array_to_string(list_filter(list_transform(parts, lambda z: {clean_v1('z')}), lambda z: z <> ''), ' '), 1, 280) AS search_query FROM p"""
ORACLE["repeated_queries"] = TURNS + " SELECT md5(query) AS query_md5, count(*) AS n FROM turns GROUP BY 1 HAVING count(*) > 1"
ORACLE["displayed_turns"] = FLAGS + " SELECT session_id, turn_idx, query, CASE WHEN is_exact_match THEN 'exact' WHEN is_correct THEN 'semantic' WHEN is_miss THEN 'miss' ELSE 'incorrect' END AS status FROM f WHERE session_id IN (SELECT DISTINCT session_id FROM f ORDER BY 1 LIMIT 3)"
_PERCENT, _FIXED = "format('{{:.2f}}', {0} * 100) || '%'", "format('{{:.{1}f}}', {0})"
# The labels of the printed panel.
_SHOWN = [("Total conversations", "sessions::VARCHAR"), ("Total turns", "turns::VARCHAR"), ("Avg MT conversation score", _FIXED.format("mean", 2)), ("Exact matches", "correct_exact::VARCHAR"), ("Refusals", "miss::VARCHAR"), ("Hallucinated responses", "(total - correct - miss)::VARCHAR"), ("Exact accuracy", _PERCENT.format("(correct_exact / total)")), ("Accuracy", _PERCENT.format("(correct / total)")), ("Missing rate", _PERCENT.format("(miss / total)")), ("Hallucination rate", _PERCENT.format("((total - correct - miss) / total)")), ("Truthfulness score", _FIXED.format("(CASE WHEN total > 1 THEN (2 * correct + miss) / total - 1 ELSE 0.0 END)", 4))]
ORACLE["displayed_metrics"] = STOP + """,
x AS (SELECT 'all' AS scope, * FROM a UNION ALL SELECT 'ego', * FROM a WHERE is_ego),
g AS (SELECT scope, count(*) AS total, sum(adj_exact::INT)::BIGINT AS correct_exact, sum(adj_correct::INT)::BIGINT AS correct, sum(adj_miss::INT)::BIGINT AS miss, count(DISTINCT session_id) AS sessions, count(DISTINCT interaction_id) AS turns FROM x GROUP BY 1),
m AS (SELECT scope, avg(score) AS mean FROM (SELECT scope, session_id, avg(adj_correct::INT) - avg((NOT adj_correct AND NOT adj_miss)::INT) AS score FROM x GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT * FROM g JOIN m USING (scope)) """ + " UNION ALL ".join(f"SELECT scope, {i}::BIGINT AS place, '{n}' AS metric, {v} AS value FROM b" for i, (n, v) in enumerate(_SHOWN))

# ---------------------------------------------------------------- evidence and prompts

NAMES = """nm AS (SELECT turn_id, rank, trim(split_part(text, ' | ', 1)) AS name FROM kg), nf AS (SELECT turn_id, min(rank) AS rank, arg_min(name, rank) AS name FROM nm WHERE name <> '' GROUP BY turn_id, lower(name)),
nk AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY rank) AS k FROM nf), nn AS (SELECT turn_id, string_agg(name, ' ' ORDER BY k) AS names, arg_min(name, k) AS main_name FROM nk WHERE k <= 2 GROUP BY 1)"""
ORACLE["search_queries"] = f"WITH {KG}, {NAMES} SELECT turn_id, substr({clean(chr(40) + 'names || chr(32) || query' + chr(41))}, 1, 240) AS search_query, substr(trim(main_name) || ' ' || trim(query), 1, 240) AS rewritten FROM nn JOIN pq USING (turn_id)"


def line(table: str) -> str:
    return f"SELECT turn_id, rank, '[' || evidence_id || ' score=' || format('{{:.3f}}', score) || '] ' || text AS line FROM {table}"


_RULES = f"Answer briefly from the picture and the evidence. If they don''t settle it, answer exactly: {IDK}"
ORACLE["prompts"] = f"""WITH {AGREE}, kl AS ({line('kg')}), kb AS (SELECT *, sum(length(line)) OVER (PARTITION BY turn_id ORDER BY rank) AS used FROM kl),
kj AS (SELECT turn_id, string_agg(line, chr(10) ORDER BY rank) AS t FROM kb WHERE used <= 400 GROUP BY 1), pk AS (SELECT turn_id, query, coalesce(t, '') AS kg_lines FROM pq LEFT JOIN kj USING (turn_id)),
wl AS ({line('we')}), wb AS (SELECT wl.*, 400 - length(kg_lines) AS room, sum(length(line)) OVER (PARTITION BY turn_id ORDER BY rank) AS used FROM wl JOIN pk USING (turn_id)),
wj AS (SELECT turn_id, string_agg(line, chr(10) ORDER BY rank) AS t FROM wb WHERE used <= room GROUP BY 1), pw AS (SELECT pk.*, coalesce(t, '') AS web_lines FROM pk LEFT JOIN wj USING (turn_id)),
pm AS (SELECT *, unnest(['vision', 'task1', 'task2']) AS mode FROM pw),
pp AS (SELECT *, '{_RULES}' || CASE WHEN mode <> 'vision' THEN chr(10) || chr(10) || 'Image evidence:' || chr(10) || coalesce(nullif(kg_lines, ''), 'none') ELSE '' END
  || CASE WHEN mode = 'task2' THEN chr(10) || chr(10) || 'Web evidence:' || chr(10) || coalesce(nullif(web_lines, ''), 'none') ELSE '' END || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM pm)
SELECT turn_id, mode, kg_lines, web_lines, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM pp"""
ORACLE["image_lines"] = f"""WITH {KG}, c AS (SELECT turn_id, hit_pos, score, attr_pos, {clean_v1("coalesce(entity_name, '')")} AS name, {clean_v1("coalesce(field, '')")} AS f, {clean_v1("coalesce(value, '')")} AS v FROM kh JOIN pq USING (turn_id) WHERE hit_pos <= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY turn_id, hit_pos ORDER BY attr_pos) AS k FROM c WHERE v <> ''),
l AS (SELECT turn_id, hit_pos, '[Image KG ' || hit_pos || ', score=' || format('{{:.3f}}', any_value(score)) || '] ' || any_value(name) || '; ' || string_agg(f || ': ' || v, '; ' ORDER BY attr_pos) AS line FROM n WHERE k <= 3 GROUP BY 1, 2)
SELECT turn_id, string_agg(line, chr(10) ORDER BY hit_pos) AS evidence FROM l GROUP BY 1"""
ORACLE["web_lines"] = f"""WITH {WEB}, c AS (SELECT lx.query_id AS turn_id, rank AS pos, score, coalesce(nullif({clean_v1("coalesce(title, '')")}, ''), 'Untitled page') AS t, {clean_v1("coalesce(snippet, '')")} AS s, {clean_v1("coalesce(url, '')")} AS u, snippet FROM lx JOIN pf ON item_id = page_id),
a AS (SELECT turn_id, string_agg('[Web ' || pos || ', score=' || format('{{:.3f}}', score) || '] ' || t || CASE WHEN u <> '' THEN ' (' || u || ')' ELSE '' END || ': ' || s, chr(10) ORDER BY pos) AS evidence FROM c WHERE s <> '' AND pos <= 3 GROUP BY 1),
b AS (SELECT turn_id, string_agg('[Info ' || pos || '] ' || snippet, chr(10) ORDER BY pos) AS info FROM c WHERE snippet <> '' GROUP BY 1)
SELECT turn_id, evidence, info FROM a JOIN b USING (turn_id)"""
ORACLE["items_by_entity"] = f"""WITH {AGREE}, ik AS (SELECT ai.turn_id, ai.rank, evidence_id, CASE WHEN name = '' THEN '__unnamed_' || (ai.rank - 1) ELSE array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') END AS key FROM ai JOIN kg ON ai.turn_id = kg.turn_id AND ai.rank = kg.rank),
ek AS (SELECT ik.turn_id, key, entity_rank FROM ae JOIN ik ON ae.turn_id = ik.turn_id AND ae.first_rank = ik.rank)
SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY entity_rank, rank) AS position, evidence_id, entity_rank FROM ik JOIN ek USING (turn_id, key)"""
ORACLE["called_searches"] = """WITH q AS (SELECT p_partkey AS turn_id, 'what is the size of ' || p_name AS query FROM part WHERE p_partkey % 100 = 0)
SELECT turn_id, CASE WHEN length(query) % 2 = 1 THEN '' ELSE array_to_string(string_split(query, ' ')[1:3], ' ') END AS titles, CASE WHEN length(query) % 2 = 1 THEN 'web search failed: ValueError: odd' END AS error, CASE WHEN length(query) % 2 = 1 THEN 'search_error' ELSE 'ok' END AS search_status FROM q"""
ORACLE["contract_suites"] = f"""WITH p AS (SELECT p_brand AS suite, p_partkey AS n, p_size, unnest(['vision', 'task2']) AS mode FROM part),
c AS (SELECT suite, mode, CASE WHEN mode = 'vision' OR n % 4 = 0 THEN '{IDK}' ELSE '$' || p_size END AS prediction, '$' || CASE WHEN n % 9 = 0 THEN 0 ELSE p_size END AS ground_truth FROM p),
k AS (SELECT suite, mode, count(*) AS samples, count(*) FILTER (prediction = ground_truth) AS correct, count(*) FILTER (prediction = '{IDK}') AS missing FROM c GROUP BY 1, 2), g AS (SELECT *, samples - correct - missing AS hallucination FROM k)
SELECT *, round(correct / samples, 6) AS accuracy, round(missing / samples, 6) AS missing_rate, round(hallucination / samples, 6) AS hallucination_rate, round((correct - hallucination) / samples, 6) AS truthfulness FROM g"""

# ---------------------------------------------------------------- order, text

ORACLE["paged_scan"] = "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) SELECT doc_id, p // 128 AS page, p % 128 AS place FROM x"
ORACLE["shuffled_documents"] = "SELECT doc_id, row_number() OVER (ORDER BY md5('3-' || doc_id), doc_id) - 1 AS position FROM documents"
ORACLE["concatenated_runs"] = REVIEWS + " SELECT 'base' AS run, query_id, label, NULL::VARCHAR AS error_cause FROM r WHERE version = 'b0' UNION ALL SELECT 'full', query_id, label, error_cause FROM r WHERE version = 'full'"
ORACLE["token_limits"] = r"WITH t AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda z: z <> '') AS w FROM benchmark) SELECT item_id, len(w) AS n_tokens, array_to_string(w[1:5], ' ') AS cut FROM t"
ORACLE["row_hashes"] = REVIEWS + """ SELECT query_id, version, sha256('{"label":"' || label || '","query_id":' || query_id || ',"version":"' || version || '"}') AS sha FROM r"""
ORACLE["unescaped_pages"] = f"WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) || ' &amp; &quot;x&quot;' AS t FROM pages) SELECT page_id, {clean('t')} AS title FROM t"
ORACLE["cached_pages"] = """WITH p AS (SELECT page_id, url, substr(md5(url), 1, 1) = '0' AS bad FROM pages)
SELECT page_id, sha256(url) || '.jpg' AS key, CASE WHEN bad THEN 'failed' ELSE 'fetched' END AS first_status, CASE WHEN bad THEN 'failed' ELSE 'cached' END AS second_status, CASE WHEN NOT bad THEN md5('page of ' || url) END AS content_md5 FROM p"""
ORACLE["committed_traces"] = ORACLE["trace_files"]
ORACLE["paged_collection"] = "SELECT doc_id, n_chars FROM documents"
ORACLE["looked_up_pages"] = f"WITH {WEB}, u AS (SELECT DISTINCT url AS id FROM lx JOIN pf ON item_id = page_id) SELECT id, CASE WHEN ('0x' || substr(md5(id), 1, 4))::INT % 7 <> 0 THEN 'title of ' || id END AS value FROM u"
ORACLE["file_checksums"] = """WITH f AS (SELECT doc_id // 100 AS bucket, string_agg(doc_id::VARCHAR || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)
SELECT bucket, length(t) AS length, sha256(t) AS sha256, sha256(array_to_string(list_transform(range((length(t) + 63) // 64), lambda i: sha256(substr(t, i * 64 + 1, 64))), chr(10))) AS tree_sha256 FROM f"""
