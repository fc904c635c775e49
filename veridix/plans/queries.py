"""The query catalogue over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.functions import text as X
from veridix.operators import calibrate as C
from veridix.operators import evidence as E
from veridix.operators import paired as P
from veridix.operators import scoring as S
from veridix.operators import telemetry as T
from veridix.operators import turns as U
from veridix.operators.generate import wave_generate
from veridix.operators.retrieval import cosine_top_k, lexical_top_k
from veridix.operators.vectors import cosine_search, vector_index
from veridix.plans import adapters as A
from veridix.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, whole numbers to bigint."""
    return df.select(*[r6(n).alias(n) if t in ("double", "float") else F.col(n).cast("long").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in df.dtypes])


@query
def turn_rows(spark, d):
    return rounded(A.turns(spark, d).select("session_id", "turn_idx", "is_ego", "total_turn_count", "interaction_id", "query", "ground_truth", "agent_response"))


@query
def turn_history(spark, d):
    t = U.with_history(A.turns(spark, d), ["turn_idx", "query", "agent_response", "interaction_id"])
    said = F.array_join(F.transform(U.messages("history"), lambda m: F.concat(m["role"], F.lit("="), F.md5(m["content"]))), "|")
    return rounded(t.select("session_id", "turn_idx", F.size("history").alias("n_history"), said.alias("messages"), F.array_join(F.transform("history", lambda h: h["interaction_id"]), ",").alias("history_ids")))


@query
def turn_flags(spark, d):
    return rounded(S.turn_flags(A.turns(spark, d)).select("session_id", "turn_idx", "is_exact_match", "is_miss", "is_semantically_correct", "is_correct", "status"))


def adjusted(spark, d):
    return S.early_stop(S.turn_flags(A.turns(spark, d)))


@query
def early_stop(spark, d):
    return rounded(adjusted(spark, d).select("session_id", "turn_idx", "is_correct", "is_miss", "stopped", "adj_correct", "adj_exact", "adj_miss"))


@query
def session_scores(spark, d):
    return rounded(S.session_scores(adjusted(spark, d)))


@query
def score_dictionary(spark, d):
    return rounded(S.score_dictionary(adjusted(spark, d)))


@query
def distinct_counts(spark, d):
    return A.turns(spark, d).agg(F.count_distinct("session_id").alias("n_sessions"), F.count_distinct("interaction_id").alias("n_interactions"))


@query
def first_n_sessions(spark, d):
    return rounded(U.first_sessions(A.turns(spark, d), 10).select("session_id", "turn_idx", "interaction_id"))


def scoped(spark, d):
    return P.scoped(P.checked(A.reviews(spark, d)))


@query
def label_metrics(spark, d):
    return rounded(P.label_metrics(scoped(spark, d), ["scope", "version"]))


@query
def paired_deltas(spark, d):
    return rounded(P.paired_deltas(P.label_metrics(scoped(spark, d), ["scope", "version"])))


@query
def bootstrap_ci(spark, d):
    return rounded(P.bootstrap_ci(P.pairs(scoped(spark, d))))


@query
def mcnemar(spark, d):
    return rounded(P.mcnemar(P.pairs(scoped(spark, d))))


@query
def transition_matrix(spark, d):
    return P.transitions(P.pairs(scoped(spark, d)))


@query
def error_causes(spark, d):
    return P.error_causes(scoped(spark, d))


@query
def refusal_quality(spark, d):
    return P.refusal_quality(P.pairs(scoped(spark, d)))


@query
def threshold_grid(spark, d):
    return rounded(C.threshold_grid(A.calibration(spark, d), GRID, 0.2))


@query
def threshold_best(spark, d):
    return rounded(C.best_threshold(rounded(C.threshold_grid(A.calibration(spark, d), GRID, 0.2))))


@query
def stratified_sample(spark, d):
    return rounded(C.stratified_sample(A.table(spark, d, "documents"), ["lang", "source"], "doc_id", 60, 7))


def _runs(spark, d):
    r = A.reviews(spark, d)
    return r.select("source_order", F.col("query_id").cast("string").alias("query"), "version", F.concat(F.lit(" "), "label", F.lit("-"), (F.col("n_chars") % 3).cast("string")).alias("answer"), F.lit("t").alias("ground_truth"))


@query
def blind_review_classes(spark, d):
    return rounded(C.blind_review(_runs(spark, d), 11))


@query
def run_alignment(spark, d):
    """Runs of the labelled documents alone, so versions lack the queries whose document has no label."""
    labelled = A.table(spark, d, "labels").select("doc_id").distinct()
    docs = A.table(spark, d, "documents").join(labelled, "doc_id", "left_semi")
    return C.align_runs(docs.select(F.floor(F.col("doc_id") / 20).cast("string").alias("query"), F.col("source").alias("version"), F.lit("t").alias("ground_truth")))


@query
def trace_summary(spark, d):
    return rounded(T.trace_summary(A.traces(spark, d), ["gpu"]))


@query
def nearest_rank_latency(spark, d):
    return rounded(T.latency_summary(A.traces(spark, d), ["event_type"]))


@query
def gpu_summary(spark, d):
    return rounded(T.gpu_summary(A.telemetry(spark, d)))


@query
def telemetry_in_run(spark, d):
    t = A.telemetry(spark, d)
    days = t.select(F.date_trunc("day", "ts").alias("day")).distinct()
    runs = days.select("day", (F.col("day") + F.expr("interval 6 hours")).alias("started"), (F.col("day") + F.expr("interval 9 hours")).alias("ended"))
    got = T.telemetry_in_runs(t, runs).groupBy("day", "gpu").agg(F.count("*").alias("n"), F.avg("util").alias("mean_util"), F.max("seconds").alias("last_second"))
    # means of whole hundredths fall on ties at six digits
    return got.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "gpu", "n", F.round("mean_util", 9).alias("mean_util"), r6("last_second").alias("last_second"))


@query
def prefetch_status(spark, d):
    p = A.table(spark, d, "pages").select("url", (F.col("page_id") % 5 == 0).alias("embedded"), (F.col("page_id") % 3 == 0).alias("cached"))
    return T.prefetch_status(p, "url", "embedded", "cached")


@query
def url_cache_keys(spark, d):
    u = F.col("url")
    return A.table(spark, d, "pages").select("page_id", X.cache_key_md5(u).alias("md5_key"), X.cache_key_sha256(u).alias("sha_key"), X.is_url(u).alias("is_url"))


@query
def thumbnail_rewrite(spark, d):
    made = F.concat(F.lit("https://upload.wikimedia.org/wikipedia/commons/a/ab/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    p = A.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, made).otherwise(F.col("url")).alias("u"))
    return p.select("page_id", X.thumbnail_url(F.col("u")).alias("thumbnail"))


@query
def clean_markup_pages(spark, d):
    p = A.table(spark, d, "pages").select("page_id", F.concat(F.lit("[[a|"), "url", F.lit("]]{{convert|7|ft|m|0}} {{x|y}} "), "html").alias("t"))
    two, one = X.clean_markup(F.col("t")), X.clean_markup_v1(F.col("t"))
    return rounded(p.select("page_id", F.md5(two).alias("v2_md5"), F.length(two).alias("v2_chars"), F.md5(one).alias("v1_md5"), F.length(one).alias("v1_chars")))


@query
def token_f1_benchmark(spark, d):
    docs = A.table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return rounded(lexical_top_k(A.table(spark, d, "benchmark").select("item_id", "text"), docs, 3).select("query_id", "item_id", "score", "rank"))


@query
def knn_topk(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    near = cosine_top_k(e.select("item_id", "embedding"), e.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding"), 5)
    return rounded(near.join(e.select("item_id", "label"), "item_id").select("query_id", "item_id", "score", "rank", "label"))


@query
def knn_by_cells(spark, d):
    """knn_topk's rows through cells that are left out where they can't reach the k-th score."""
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    index = vector_index(e, 256)
    near = cosine_search(index, e.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding"), 5)
    return rounded(near.join(e.select("item_id", "label"), "item_id").select("query_id", "item_id", "score", "rank", "label"))


@query
def kg_evidence(spark, d):
    return rounded(A.kg(spark, d))


@query
def web_evidence(spark, d):
    return rounded(A.web(spark, d))


@query
def evidence_budget(spark, d):
    return rounded(E.within_budget(A.kg(spark, d), 200).select("turn_id", "rank", "line", "used"))


def _sources(spark, d):
    """Image evidence, web evidence and questions; plans that use them twice build them once."""
    return A.kg(spark, d), A.web(spark, d), A.part_queries(spark, d)


def _agreement(kg, web, asked):
    return E.agreement(kg, web, asked)


@query
def entity_agreement(spark, d):
    return rounded(_agreement(*_sources(spark, d)))


def _conflicts(kg, web, asked):
    joined = lambda df, n: df.groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias(n))
    q = asked.join(joined(kg, "image_text"), "turn_id").join(joined(web, "web_text"), "turn_id", "left")
    return q.select("turn_id", X.is_numeric_question(F.col("query")).alias("is_numeric"), F.size(X.numbers(F.col("image_text"))).alias("n_image"), F.size(X.numbers(F.col("web_text"))).alias("n_web"), E.numeric_conflict(F.col("query"), F.col("image_text"), F.coalesce("web_text", F.lit(""))).alias("conflict"))


@query
def numeric_conflict(spark, d):
    return rounded(_conflicts(*_sources(spark, d)))


@query
def gate_actions(spark, d):
    kg, web, asked = _sources(spark, d)
    kg, web = written(kg), written(web)
    top = rounded(_agreement(kg, web, asked)).where("entity_rank = 1").select("turn_id", "top_score")
    both = top.join(_conflicts(kg, web, asked).select("turn_id", "conflict"), "turn_id").select("*", F.explode(F.array(*[F.lit(v) for v in E.VARIANTS])).alias("variant"))
    return both.select("turn_id", "variant", "top_score", "conflict", E.should_expand(F.col("top_score"), 0.45, 0.6).alias("in_band"), E.gate_action(F.col("variant"), F.col("top_score"), F.col("conflict"), 0.45, 0.6).alias("action"))


@query
def merge_web_results(spark, d):
    return rounded(E.merge_web(A.web(spark, d, 3), A.web(spark, d, 5)))


@query
def refusal_reasons(spark, d):
    t = A.turns(spark, d).withColumn("n", X.normalise_answer(F.col("agent_response")))
    idk = F.col("n.answer") == X.IDK
    reason = E.refusal_reason(idk, F.col("h") == 0, F.col("h") == 1, F.when(F.col("h") == 2, F.lit("conflicting_evidence")), F.col("h") == 3, F.col("n.reason"))
    return rounded(t.select("session_id", "turn_idx", idk.alias("is_idk"), reason.alias("refusal_reason")))


@query
def repeated_answers(spark, d):
    """Responses that come more than once."""
    return T.duplicates(A.turns(spark, d).withColumn("answer_md5", F.md5("agent_response")), ["answer_md5"])


@query
def sequence_equality(spark, d):
    e = A.table(spark, d, "events").select("event_id", "event_type")
    other = e.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, F.lit("x")).otherwise(F.col("event_type"))).where("event_id <> 5")
    return rounded(T.sequence_mismatches(e, other, "event_id", "event_type"))


@query
def set_equality(spark, d):
    """Documents and labels have different ids: every document without a label is a row."""
    return T.set_difference(A.table(spark, d, "documents").select("doc_id"), A.table(spark, d, "labels").select("doc_id"))


@query
def wave_generation(spark, d):
    return rounded(wave_generate(A.turns(spark, d).select("session_id", "turn_idx", "query")).select("session_id", "turn_idx", "agent_response"))
