"""Whole answers: from questions to traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridix.operators.answering import Settings, answer_turns
from veridix.plans import adapters as A
from veridix.plans.oracle import KG, clean, f1, nums, rel, terms, toks
from veridix.plans.oracle import _CUES as CUES
from veridix.plans.queries import query, rounded
from veridix.plans.run_oracle import _RULES as RULES
from veridix.plans.run_oracle import NAMES

ORACLE: dict[str, str] = {}
#: The band of the gate, code points of evidence and words of an answer that the queries run with.
RUN = {"max_fields": 8, "max_chars": 600, "max_tokens": 3, "web_threshold": 0.05, "low": 0.45, "high": 0.6}


def stub_backend(prompts: list[str], images: list[object]) -> list[str]:
    """Stands for a model: its answer tells the prompt's length; now and then it doesn't know, or says nothing."""
    return ["Well, I do not know." if len(p) % 5 == 0 else "" if len(p) % 7 == 0 else f"{len(p)} signs of a prompt" for p in prompts]


def asked_parts(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("turn_id"), F.col("embedding").alias("image"))
    return A.part_queries(spark, d).join(e, "turn_id", "left")


def traces(spark, d, mode, variant):
    s = Settings(mode=mode, variant=variant, **RUN)
    return answer_turns(asked_parts(spark, d), stub_backend, A.image_search(spark, d), A.page_search(spark, d), s)


def shown(t):
    ids = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["evidence_id"], F.md5(x["text"]))), ",")
    names = F.array_join(F.transform("entity_candidates", lambda x: x["entity_name"]), ",")
    return rounded(t.select("turn_id", "search_query", "gate_action", "evidence_conflict", "entity_agreement_before", "entity_agreement", "entity_margin", "answer", "refusal_reason", "status", "answer_token_count", "search_call_count", "additional_search_query", F.array_join("selected_evidence_ids", ",").alias("selected"), ids("image_evidence").alias("image_evidence"), ids("web_evidence").alias("web_evidence"), ids("additional_web_evidence").alias("additional_web_evidence"), names.alias("candidates")))


@query
def answered_turns(spark, d):
    """The full variant: answers, expansions and abstentions by the gate, one trace row a question."""
    return shown(traces(spark, d, "task2", "full"))


@query
def expanded_turns(spark, d):
    """The variant that searches again for all it doesn't abstain from."""
    return shown(traces(spark, d, "task2", "a2_enrich_all"))


@query
def image_answers(spark, d):
    """The mode without web and gate."""
    return shown(traces(spark, d, "task1", "b0"))


# ---------------------------------------------------------------- the same in SQL


def _web(s: str, asked: str, k: int, items: int) -> str:
    """CTEs up to we{s}: web evidence of the requests in `asked` (turn_id, query, value), searched for k pages."""
    return f"""qa{s} AS (SELECT turn_id, query, list_distinct({toks('value')}) AS t FROM {asked}),
lt{s} AS (SELECT turn_id, query, item_id, round(2 * (o / len(it)) * (o / len(qt)) / (o / len(it) + o / len(qt)), 6) AS score FROM (SELECT turn_id, query, item_id, q.t AS qt, ia.t AS it, len(list_intersect(q.t, ia.t)) AS o FROM qa{s} q, ia) WHERE o > 0),
lx{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, item_id) AS pos FROM lt{s}) WHERE pos <= {k}),
wc{s} AS (SELECT turn_id, query, pos, score, coalesce(nullif({clean("coalesce(title, '')")}, ''), 'Untitled page') AS title, {clean("coalesce(snippet, '')")} AS snippet, {clean("coalesce(url, '')")} AS url FROM lx{s} JOIN pf ON item_id = page_id),
wr{s} AS (SELECT *, {rel(terms('query'), terms("title || ' ' || snippet"))} AS rel FROM wc{s} WHERE snippet <> '' AND score >= {RUN['web_threshold']}),
wd{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id, lower(url), lower(snippet) ORDER BY pos) AS dn FROM wr{s}) WHERE dn = 1),
we{s} AS (SELECT turn_id, rank, 'WEB' || rank AS evidence_id, title || ': ' || snippet AS text, score, url FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY rel DESC, score DESC, pos) AS rank FROM wd{s}) WHERE rank <= {items})"""


def _agree(s: str, image: str, web: str) -> str:
    """CTEs up to ar{s} (the ranked entities of the image evidence) and ac{s} (a row a turn: its scores and names)."""
    return f"""ag{s} AS (SELECT turn_id, CASE WHEN name = '' THEN '__unnamed_' || (rank - 1) ELSE array_to_string({toks('name')}, ' ') END AS key, min(rank) AS first_rank, max(score) AS best, arg_min(name, rank) AS entity_name, string_agg(attr, ' ' ORDER BY rank) AS attrs FROM {image} GROUP BY 1, 2),
aw{s} AS (SELECT turn_id, string_agg(text, ' ' ORDER BY rank) AS web_text FROM {web} GROUP BY 1),
ab{s} AS (SELECT turn_id, key, first_rank, entity_name, 0.5 * least(1.0, greatest(0.0, best)) + 0.35 * {f1(toks('entity_name'), toks('web_text'))} + 0.15 * {f1(toks('query'), toks('attrs'))} AS entity_score FROM ag{s} LEFT JOIN aw{s} USING (turn_id) JOIN pq USING (turn_id)),
ar{s} AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY entity_score DESC, first_rank) AS entity_rank FROM ab{s}),
ac{s} AS (SELECT turn_id, max(entity_score) FILTER (entity_rank = 1) AS top, coalesce(max(entity_score) FILTER (entity_rank = 2), 0.0) AS second, arg_min(entity_name, entity_rank) AS lead, string_agg(entity_name, ',' ORDER BY entity_rank) AS names FROM ar{s} GROUP BY 1)"""


def _line(table: str) -> str:
    return f"SELECT *, '[' || evidence_id || ' score=' || format('{{:.3f}}', score) || '] ' || text AS line FROM {table}"


def _answers(mode: str) -> str:
    """CTEs from pk (image evidence in the prompt's order), pw (web evidence) and turns (what is known of each turn) on, and
    the result."""
    web = f" || chr(10) || chr(10) || 'Web evidence:' || chr(10) || coalesce(nullif(web_lines, ''), 'none')" if mode == "task2" else ""
    said = lambda table: f"(SELECT turn_id, string_agg(evidence_id || '=' || md5(text), ',' ORDER BY rank) AS t, string_agg(evidence_id, ',' ORDER BY rank) AS ids FROM {table} GROUP BY 1)"
    return f"""kb AS (SELECT *, sum(length(line)) OVER (PARTITION BY turn_id ORDER BY rank) AS used FROM ({_line('pk')})), kj AS (SELECT turn_id, string_agg(line, chr(10) ORDER BY rank) AS t FROM kb WHERE used <= {RUN['max_chars']} GROUP BY 1),
pr AS (SELECT turns.*, coalesce(t, '') AS kg_lines FROM turns LEFT JOIN kj USING (turn_id)),
wb AS (SELECT w.*, {RUN['max_chars']} - length(kg_lines) AS room, sum(length(line)) OVER (PARTITION BY turn_id ORDER BY rank) AS used FROM ({_line('pw')}) w JOIN pr USING (turn_id)), wj AS (SELECT turn_id, string_agg(line, chr(10) ORDER BY rank) AS t FROM wb WHERE used <= room GROUP BY 1),
pt AS (SELECT pr.*, coalesce(t, '') AS web_lines FROM pr LEFT JOIN wj USING (turn_id)),
pp AS (SELECT *, length('{RULES}' || chr(10) || chr(10) || 'Image evidence:' || chr(10) || coalesce(nullif(kg_lines, ''), 'none'){web} || chr(10) || chr(10) || 'Question: ' || query) AS n FROM pt),
an AS (SELECT *, CASE WHEN gate_action = 'abstain' OR n % 5 = 0 OR n % 7 = 0 THEN 'I don''t know' ELSE n || ' signs of' END AS answer FROM pp)
SELECT an.turn_id, search_query, gate_action, conflict AS evidence_conflict, round(before, 6) AS entity_agreement_before, round(top, 6) AS entity_agreement, round(margin, 6) AS entity_margin, answer,
  CASE WHEN answer <> 'I don''t know' THEN NULL WHEN gate_action = 'abstain' THEN CASE WHEN conflict THEN 'conflicting_evidence' ELSE 'insufficient_evidence' END WHEN k.t IS NULL AND w.t IS NULL THEN 'no_retrieval' WHEN n % 5 <> 0 THEN 'empty_generation' ELSE 'insufficient_evidence' END AS refusal_reason,
  'ok' AS status, 3::BIGINT AS answer_token_count, calls AS search_call_count, again AS additional_search_query, concat_ws(',', k.ids, w.ids) AS selected, coalesce(k.t, '') AS image_evidence, coalesce(w.t, '') AS web_evidence, coalesce(x.t, '') AS additional_web_evidence, names AS candidates
FROM an LEFT JOIN {said('pk')} k ON k.turn_id = an.turn_id LEFT JOIN {said('pw')} w ON w.turn_id = an.turn_id LEFT JOIN {said('px')} x ON x.turn_id = an.turn_id"""


def _gated(action: str) -> str:
    low, high = RUN["low"], RUN["high"]
    return f"""WITH {KG}, {NAMES},
pf AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_replace(regexp_extract(html, '<p>(.*?)(?:</p>|<p>)', 1), '<[^>]+>', ' ', 'g') AS snippet FROM pages),
ia AS (SELECT page_id AS item_id, list_distinct({toks("title || ' ' || snippet")}) AS t FROM pf),
sq AS (SELECT turn_id, query, substr({clean("concat_ws(' ', names, query)")}, 1, 240) AS value FROM pq LEFT JOIN nn USING (turn_id)),
{_web('1', 'sq', 3, 3)},
ai AS (SELECT turn_id, rank, score, trim(split_part(text, ' | ', 1)) AS name, CASE WHEN contains(text, ' | ') THEN substr(text, length(split_part(text, ' | ', 1)) + 4) ELSE '' END AS attr FROM kg),
{_agree('1', 'ai', 'we1')},
tx AS (SELECT turn_id, string_agg(text, ' ' ORDER BY rank) AS image_text FROM kg GROUP BY 1),
g0 AS (SELECT sq.turn_id, sq.query, sq.value AS search_query, coalesce(top, 0.0) AS before, lead, (regexp_matches(sq.query, '(?i)\\b(?:{CUES})\\b') OR len({nums('sq.query')}) > 0) AS numeric, {nums('image_text')} AS a, {nums('web_text')} AS b FROM sq LEFT JOIN ac1 USING (turn_id) LEFT JOIN tx USING (turn_id) LEFT JOIN aw1 USING (turn_id)),
g1 AS (SELECT *, numeric AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 AS conflict FROM g0),
g2 AS (SELECT *, {action.format(low=low, high=high)} AS gate_action FROM g1),
g3 AS (SELECT *, CASE WHEN gate_action = 'expand' AND lead IS NOT NULL THEN substr(trim(trim(lead) || ' ' || trim(query)), 1, 240) END AS again FROM g2),
bd AS (SELECT turn_id, query, again AS value FROM g3 WHERE again IS NOT NULL),
{_web('2', 'bd', 5, 5)},
mb AS (SELECT *, 0 AS src FROM we1 WHERE turn_id IN (SELECT turn_id FROM bd) UNION ALL SELECT *, 1 FROM we2),
mk AS (SELECT *, row_number() OVER (PARTITION BY turn_id, CASE WHEN coalesce(url, '') <> '' THEN 'u:' || url ELSE 't:' || array_to_string({toks('text')}, ' ') END ORDER BY src, rank) AS dn FROM mb),
mw AS (SELECT turn_id, nr AS rank, 'WEB' || nr AS evidence_id, text, score FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY src, rank) AS nr FROM mk WHERE dn = 1)),
a2 AS (SELECT * FROM ai WHERE turn_id IN (SELECT turn_id FROM bd)),
{_agree('2', 'a2', 'mw')},
en AS (SELECT * FROM ar1 WHERE turn_id NOT IN (SELECT turn_id FROM bd) UNION ALL SELECT * FROM ar2), es AS (SELECT * FROM ac1 WHERE turn_id NOT IN (SELECT turn_id FROM bd) UNION ALL SELECT * FROM ac2),
pw AS (SELECT turn_id, rank, evidence_id, text, score FROM we1 WHERE turn_id NOT IN (SELECT turn_id FROM bd) UNION ALL SELECT * FROM mw), px AS (SELECT * FROM we2),
ik AS (SELECT kg.turn_id, kg.rank, evidence_id, text, kg.score, CASE WHEN name = '' THEN '__unnamed_' || (ai.rank - 1) ELSE array_to_string({toks('name')}, ' ') END AS key FROM kg JOIN ai ON kg.turn_id = ai.turn_id AND kg.rank = ai.rank),
pk AS (SELECT ik.turn_id, row_number() OVER (PARTITION BY ik.turn_id ORDER BY entity_rank, ik.rank) AS rank, evidence_id, text, score FROM ik JOIN en ON en.turn_id = ik.turn_id AND en.key = ik.key),
turns AS (SELECT g3.turn_id, query, search_query, gate_action, conflict, before, coalesce(again, '') AS again, coalesce(top, 0.0) AS top, coalesce(greatest(0.0, top - second), 0.0) AS margin, coalesce(names, '') AS names, 2 + (again IS NOT NULL)::BIGINT AS calls FROM g3 LEFT JOIN es USING (turn_id)),
{_answers('task2')}"""


ORACLE["answered_turns"] = _gated("CASE WHEN conflict OR before <= {low} THEN 'abstain' WHEN before < {high} THEN 'expand' ELSE 'answer' END")
ORACLE["expanded_turns"] = _gated("CASE WHEN before <= {low} THEN 'abstain' ELSE 'expand' END")
ORACLE["image_answers"] = f"""WITH {KG}, pk AS (SELECT turn_id, rank, evidence_id, text, score FROM kg), pw AS (SELECT * FROM pk WHERE false), px AS (SELECT * FROM pk WHERE false),
turns AS (SELECT turn_id, query, '' AS search_query, 'answer' AS gate_action, false AS conflict, 0.0::DOUBLE AS before, '' AS again, 0.0::DOUBLE AS top, 0.0::DOUBLE AS margin, '' AS names, 1::BIGINT AS calls FROM pq),
{_answers('task1')}"""
