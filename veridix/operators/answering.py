"""From questions to answers and traces as one plan: searches, evidence, agreement, the gate, a second search for the
turns that the gate sends there, prompts, generation, refusals."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridix.functions import text as X
from veridix.operators import evidence as E
from veridix.operators.retrieval import GENERATION_FAILED, NOT_CONFIGURED, SEARCH_FAILED
from veridix.session import written

IMAGE_HIT = "struct<score:double,entities:array<struct<entity_name:string,entity_attributes:array<struct<key:string,value:string>>>>>"
WEB_HIT = "struct<score:double,page_name:string,page_snippet:string,page_url:string>"
FOUND = ["turn_id", "hits", "error", "search_ms"]
#: requests (turn_id, value), hits a request, source -> FOUND; `retrieval.called_search` and `indexed` give it.
Search = Callable[[DataFrame, int, str], DataFrame]
#: Prompts and images of a batch -> an answer for each.
Backend = Callable[[list[str], list[object]], list[str]]
MODES = ("vision", "task1", "task2")


@dataclass(frozen=True)
class Settings:
    """The defaults are those under which published runs were made."""

    mode: str = "task1"
    variant: str = "b0"
    image_results: int = 3
    web_results: int = 3
    adaptive_k: int = 5
    max_fields: int = 10
    max_chars: int = 5500
    max_tokens: int = 75
    web_threshold: float = 0.2
    low: float = 0.3
    high: float = 0.6
    batch: int = 4
    version: str = "veridix"

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.variant not in E.VARIANTS:
            raise ValueError(f"unknown mode or variant: {self.mode}, {self.variant}")
        if not 0 <= self.low < self.high <= 1:
            raise ValueError("thresholds must be 0 <= low < high <= 1")


def indexed(requests: DataFrame, hits: DataFrame, order: str = "rank") -> DataFrame:
    """FOUND of a search that is a join: hits (turn_id, rank, hit), a request's few by rank; none: an empty list."""
    own = hits.groupBy("turn_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "hit"))), lambda x: x["hit"]).alias("hits"))
    kind = own.schema["hits"].dataType
    return requests.select("turn_id").join(own, "turn_id", "left").select("turn_id", F.coalesce("hits", F.array().cast(kind)).alias("hits"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("search_ms"))


def image_rows(found: DataFrame) -> DataFrame:
    """Image hits unnested to attributes, as kg_evidence takes them."""
    e = found.select("turn_id", F.posexplode("hits").alias("hit_pos", "h")).select("turn_id", "hit_pos", "h.score", F.posexplode("h.entities").alias("entity_pos", "e"))
    return e.select("turn_id", "hit_pos", "score", "entity_pos", "e.entity_name", F.posexplode("e.entity_attributes").alias("attr_pos", "a")).select("*", F.col("a.key").alias("field"), "a.value").drop("a")


def web_rows(found: DataFrame) -> DataFrame:
    return found.select("turn_id", F.posexplode("hits").alias("pos", "h")).select("turn_id", "pos", "h.*")


def gathered(evidence: DataFrame, source: str, name: str) -> DataFrame:
    """turn_id and its evidence in order of rank, a few items a turn."""
    item = F.struct("rank", F.struct("evidence_id", F.lit(source).alias("source"), "text", "score").alias("item"))
    return evidence.groupBy("turn_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))


def candidates(entities: DataFrame, name: str = "entity_candidates") -> DataFrame:
    """turn_id, its ranked entities with their scores, the best score and the margin."""
    one = F.struct("entity_rank", "entity_name", "entity_score", "image_score", "web_support", "attribute_support")
    return entities.groupBy("turn_id").agg(F.array_sort(F.collect_list(one)).alias(name), F.max("top_score").alias("top_score"), F.max("margin").alias("margin"))


def joined_texts(evidence: DataFrame, name: str) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return evidence.groupBy("turn_id").agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias(name))


def generated(prompts: DataFrame, backend: Backend, batch: int) -> DataFrame:
    """prompts (turn_id, prompt, image) -> turn_id, raw_answer, generation_error, generation_ms: batches of at most
    clip_batch(batch). A batch that fails leaves its error with each of its turns, which then don't know; another count of
    answers than of prompts raises."""
    kind, size = prompts.schema["turn_id"].dataType.simpleString(), X.clip_batch(batch)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), size):
                own = pdf.iloc[lo : lo + size]
                began, error = time.perf_counter(), None
                try:
                    answers = backend(own["prompt"].tolist(), own["image"].tolist())
                except Exception as e:  # noqa: BLE001  the record is the result
                    answers, error = [None] * len(own), GENERATION_FAILED.format(kind=type(e).__name__, error=e)
                if len(answers) != len(own):
                    raise RuntimeError(f"the backend returned {len(answers)} answers for {len(own)} questions")
                took = (time.perf_counter() - began) * 1000 / len(own)
                said = [X.IDK] * len(own) if error else [a or "" for a in answers]
                yield pd.DataFrame({"turn_id": own["turn_id"], "raw_answer": said, "generation_error": error, "generation_ms": took})

    return prompts.select("turn_id", "prompt", "image").mapInPandas(run, f"turn_id {kind}, raw_answer string, generation_error string, generation_ms double")


ITEM = "array<struct<evidence_id:string,source:string,text:string,score:double>>"
ENTITIES = "array<struct<entity_rank:int,entity_name:string,entity_score:double,image_score:double,web_support:double,attribute_support:double>>"
#: What a turn has where a mode or the gate leaves a step out.
DEFAULTS = {
    "search_query": ("string", ""), "additional_search_query": ("string", ""), "gate_action": ("string", "answer"), "evidence_conflict": ("boolean", False),
    "image_search_ms": ("double", 0.0), "web_search_ms": ("double", 0.0), "additional_web_search_ms": ("double", 0.0), "generation_ms": ("double", 0.0),
    "entity_agreement_before": ("double", 0.0), "entity_agreement": ("double", 0.0), "entity_margin": ("double", 0.0),
}
# The fields of a trace.
TRACE = ["agent_version", "task_mode", "query", "search_query", "image_evidence", "web_evidence", "selected_evidence_ids", "answer", "refusal_reason", "image_search_ms", "web_search_ms", "generation_ms", "total_ms", "answer_token_count", "status", "errors", "trace_schema", "experiment_variant", "entity_candidates", "entity_agreement_before", "entity_agreement", "entity_margin", "evidence_conflict", "gate_action", "additional_search_query", "additional_web_evidence", "additional_web_search_ms", "search_call_count"]


def answer_turns(turns: DataFrame, backend: Backend, image_search: Search | None = None, web_search: Search | None = None, settings: Settings | None = None, tokenize: Callable[[Column], Column] = X.split_words) -> DataFrame:
    """turns (turn_id, query[, image]), turn_id unique -> one trace row a turn: turn_id and TRACE.

    vision asks the backend alone, task1 searches images, task2 images and then the web. Only task2 has a gate: what it
    abstains from isn't generated; what it sends to expand (and has an entity to name) is searched a second time, merged
    and ranked again, and only that. Neither the conflict nor the gate's action is judged again after the second search.
    Every variant but b0 has its image evidence in the order of its entities.

    What a search or the backend returns is written once to the shared folder, so no call is made twice by a plan that
    reads it twice (a task that is retried calls again), and each index is read once a search. A search that fails leaves
    its error and no hits; see `generated` for a backend that fails. total_ms is the turn's own searches and its share
    of its batch. Turns without an id are left out; a null query is an empty one.
    """
    s = settings or Settings()
    image = F.col("image") if "image" in turns.columns else F.lit(None).cast("string")
    t = written(turns.where("turn_id is not null").select("turn_id", F.coalesce("query", F.lit("")).alias("query"), image.alias("image")))
    asked = t.select("turn_id", "query")

    def searched(search: Search | None, requests: DataFrame, k: int, source: str, hit: str) -> DataFrame:
        if search is None:
            told = SEARCH_FAILED.format(source=source, kind="RuntimeError", error=NOT_CONFIGURED)
            return requests.select("turn_id", F.array().cast(f"array<{hit}>").alias("hits"), F.lit(told).alias("error"), F.lit(0.0).alias("search_ms"))
        return written(search(requests, k, source).select(*FOUND))

    out, web, more, entities = t, None, None, None
    none = lambda kind: F.array().cast(kind)
    if s.mode == "vision":
        kg = None
    else:
        found = searched(image_search, t.select("turn_id", F.col("image").alias("value")), s.image_results, "image", IMAGE_HIT)
        kg = written(E.kg_evidence(image_rows(found).where(F.col("hit_pos") < s.image_results).join(asked, "turn_id"), s.max_fields))
        out = out.join(found.select("turn_id", F.col("error").alias("image_error"), F.col("search_ms").alias("image_search_ms")), "turn_id", "left")
    if s.mode == "task2":
        named = asked.join(E.leading_names(kg), "turn_id", "left")
        named = named.select("turn_id", "query", X.search_query(F.coalesce("names", none("array<string>")), F.col("query")).alias("search_query"))
        found = searched(web_search, named.select("turn_id", F.col("search_query").alias("value")), s.web_results, "web", WEB_HIT)
        web = written(E.web_evidence(web_rows(found).join(asked, "turn_id"), s.web_results, s.web_threshold))
        first = written(E.agreement(kg, web, asked))
        facts = named.join(candidates(first, "__c"), "turn_id", "left").join(joined_texts(kg, "__i"), "turn_id", "left").join(joined_texts(web, "__w"), "turn_id", "left")
        score, conflict = F.coalesce("top_score", F.lit(0.0)), E.numeric_conflict(F.col("query"), F.coalesce("__i", F.lit("")), F.coalesce("__w", F.lit("")))
        facts = facts.withColumns({"evidence_conflict": conflict, "entity_agreement_before": score}).withColumn("gate_action", E.gate_action(F.lit(s.variant), F.col("entity_agreement_before"), F.col("evidence_conflict"), s.low, s.high))
        again = F.when((F.col("gate_action") == "expand") & (F.size("__c") > 0), X.rewrite_query(F.col("__c")[0]["entity_name"], F.col("query")))
        gated = written(facts.select("turn_id", "query", "search_query", "evidence_conflict", "entity_agreement_before", "gate_action", again.alias("additional_search_query")))
        # only the turns in the band
        band = gated.where("additional_search_query is not null").select("turn_id", F.col("additional_search_query").alias("value"))
        extra = searched(web_search, band, s.adaptive_k, "web_extra", WEB_HIT)
        more = written(E.web_evidence(web_rows(extra).join(asked, "turn_id"), s.adaptive_k, s.web_threshold))
        inside = lambda df: df.join(band.select("turn_id"), "turn_id", "left_semi")
        outside = lambda df: df.join(band.select("turn_id"), "turn_id", "left_anti")
        merged = written(E.merge_web(inside(web), more))
        entities = outside(first).unionByName(E.agreement(inside(kg), merged, inside(asked)))
        web = outside(web).unionByName(merged)
        if s.variant != "b0":
            entities = written(entities)
            placed = E.items_by_entity(kg, entities)
            kg = placed.withColumn("rank", F.col("position")).select(*kg.columns)
        told = lambda f, name: f.select("turn_id", F.col("error").alias(f"{name}_error"), F.col("search_ms").alias(f"{name}_ms"))
        out = out.join(gated.drop("query"), "turn_id", "left").join(told(found, "web").withColumnRenamed("web_ms", "web_search_ms"), "turn_id", "left").join(told(extra, "extra").withColumnRenamed("extra_ms", "additional_web_search_ms"), "turn_id", "left")
        out = out.join(candidates(entities), "turn_id", "left").withColumnsRenamed({"top_score": "entity_agreement", "margin": "entity_margin"})
        out = out.join(gathered(more, "web", "additional_web_evidence"), "turn_id", "left")
    for evidence, source, name in ((kg, "image", "image_evidence"), (web, "web", "web_evidence")):
        if evidence is not None:
            out = out.join(gathered(evidence, source, name), "turn_id", "left")
    kinds = {"image_evidence": ITEM, "web_evidence": ITEM, "additional_web_evidence": ITEM, "entity_candidates": ENTITIES}
    for name, kind in kinds.items():
        out = out.withColumn(name, F.coalesce(F.col(name).cast(kind), none(kind)) if name in out.columns else none(kind))
    for name in ("image_error", "web_error", "extra_error"):
        out = out if name in out.columns else out.withColumn(name, F.lit(None).cast("string"))
    calls = {"vision": 0, "task1": 1, "task2": 2}[s.mode]
    second = F.col("additional_search_query").isNotNull().cast("int") if s.mode == "task2" else F.lit(0)
    out = out.withColumn("search_call_count", (F.lit(calls) + second).cast("int"))
    for name, (kind, value) in DEFAULTS.items():
        if name != "generation_ms":
            out = out.withColumn(name, F.coalesce(F.col(name).cast(kind), F.lit(value)) if name in out.columns else F.lit(value).cast(kind))

    empty = lambda: asked.select("turn_id", F.lit(0).alias("rank"), F.lit("").alias("evidence_id"), F.lit("").alias("text"), F.lit(0.0).alias("score")).where("false")
    shown = E.shared_budget(kg if kg is not None else empty(), web if web is not None else empty(), t, s.max_chars)
    shown = shown.select("turn_id", "image", E.prompt(F.lit(s.mode), F.col("query"), F.col("kg_lines"), F.col("web_lines")).alias("prompt"))
    if s.mode == "task2":
        shown = shown.join(gated.where("gate_action = 'abstain'").select("turn_id"), "turn_id", "left_anti")
    out = out.join(written(generated(shown, backend, s.batch)), "turn_id", "left").withColumn("generation_ms", F.coalesce("generation_ms", F.lit(0.0)))

    said = X.normalise_answer(F.coalesce("raw_answer", F.lit(X.IDK)))
    out = out.withColumn("__a", said)
    short = F.coalesce(F.nullif(X.truncate_tokens(F.col("__a.answer"), s.max_tokens, tokenize), F.lit("")), F.lit(X.IDK))
    out = out.withColumn("__b", X.normalise_answer(short)).withColumn("answer", F.col("__b.answer"))
    errors = F.array_compact(F.array("image_error", "web_error", "extra_error", "generation_error"))
    searching = F.col("image_error").isNotNull() | F.col("web_error").isNotNull() | F.col("extra_error").isNotNull()
    given = F.when(F.col("gate_action") == "abstain", F.when(F.col("evidence_conflict"), "conflicting_evidence").otherwise("insufficient_evidence"))
    bare = (F.size("image_evidence") == 0) & (F.size("web_evidence") == 0) & F.lit(s.mode != "vision")
    failed = F.col("generation_error").isNotNull()
    reason = E.refusal_reason(F.col("answer") == X.IDK, failed, searching, given, bare, F.coalesce("__a.reason", "__b.reason"))
    ids = F.transform(F.concat("image_evidence", "web_evidence"), lambda x: x["evidence_id"])
    status = F.when(failed, "generation_error").when(searching, "search_error").otherwise("ok")
    total = F.col("image_search_ms") + F.col("web_search_ms") + F.col("additional_web_search_ms") + F.col("generation_ms")
    out = out.withColumns({"agent_version": F.lit(s.version), "task_mode": F.lit(s.mode), "trace_schema": F.lit("v3"), "experiment_variant": F.lit(s.variant), "selected_evidence_ids": ids, "errors": errors, "status": status, "refusal_reason": reason, "total_ms": total, "answer_token_count": X.count_tokens(F.col("answer"), tokenize)})
    return out.select("turn_id", *TRACE)
