"""Latency, trace and device summaries; run validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridix.functions.stats import percentiles
from veridix.functions.text import IDK
from veridix.operators.order import positions


def joined(summary: DataFrame, keys: list[str], *more: DataFrame) -> DataFrame:
    """Summaries of the same groups side by side; null keys meet."""
    for df in more:
        other = df.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in df.columns if c not in keys])
        on = [summary[k].eqNullSafe(other[f"__{k}"]) for k in keys]
        summary = (summary.join(other, on, "left") if keys else summary.crossJoin(F.broadcast(other))).drop(*[f"__{k}" for k in keys])
    return summary


def some(count: Column, what: str) -> Column:
    """The count; of nothing it raises. Only a summary without keys can meet that."""
    return F.when(count == 0, F.raise_error(F.lit(f"no {what}")).cast("long")).otherwise(count)


def trace_summary(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Latency and generation percentiles, search calls, additional evidence and actions of each group of traces."""
    action = lambda a: F.count_if(F.col("gate_action") == a).alias(f"n_{a}")
    g = traces.groupBy(*keys).agg(some(F.count("*"), "traces").alias("n"), F.avg("search_call_count").alias("mean_search_calls"), F.sum("search_call_count").alias("search_calls"), F.sum("additional_web_evidence").alias("additional_evidence"), action("answer"), action("expand"), action("abstain"))
    at = lambda name: {f"{name}p50_ms": ("linear", 0.5), f"{name}p95_ms": ("linear", 0.95)}
    return joined(g, keys, percentiles(traces, keys, "total_ms", at("")), percentiles(traces, keys, "generation_ms", at("generation_")))


def latency_summary(rows: DataFrame, keys: list[str], value: str = "total_ms") -> DataFrame:
    c = F.col(value)
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(c).alias("min_ms"), F.max(c).alias("max_ms"), F.avg(c).alias("mean_ms"))
    return joined(g, keys, percentiles(rows, keys, value, {"median_ms": ("linear", 0.5), "p50_nearest_ms": ("nearest", 0.5), "p95_nearest_ms": ("nearest", 0.95)}))


def latency_rows(traces: DataFrame) -> DataFrame:
    """One narrow row per trace, stages rounded half to even to three digits, evidence as counts."""
    ms = [F.bround(F.col(c), 3).alias(c.replace("_search", "")) for c in ("image_search_ms", "web_search_ms", "generation_ms", "total_ms")]
    return traces.select("trace_id", *ms, F.col("answer_token_count").alias("answer_tokens"), F.size(F.coalesce("image_evidence", F.array())).alias("image_evidence"), F.size(F.coalesce("web_evidence", F.array())).alias("web_evidence"))


def run_counters(traces: DataFrame, keys: list[str], most_tokens: int = 75) -> DataFrame:
    """Failures, empty retrieval, refusals and answers of over `most_tokens` tokens of each run."""
    nothing = lambda c: F.size(F.coalesce(c, F.array())) == 0
    return traces.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("run_failures"), F.count_if(nothing("image_evidence") & nothing("web_evidence")).alias("empty_retrieval"), F.count_if(F.col("answer") == IDK).alias("refusals"), F.count_if(F.col("answer_token_count") > most_tokens).alias("over_tokens"))


def evidence_stats(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Median evidence counts of each source and traces that have both; token range of the answers."""
    n = lambda c: F.size(F.coalesce(c, F.array()))
    t = traces.select(*keys, n("image_evidence").alias("image"), n("web_evidence").alias("web"), F.col("answer_token_count").alias("tokens"))
    g = t.groupBy(*keys).agg(F.count_if((F.col("image") > 0) & (F.col("web") > 0)).alias("both_sources"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"))
    middle = lambda c: percentiles(t, keys, c, {f"{c}_median": ("linear", 0.5)})
    return joined(g, keys, middle("image"), middle("web"), middle("tokens"))


def histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of each column occurs: field, value, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def gpu_summary(telemetry: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Peaks and mean utilisation of each device; without rows a summary of keys [] raises."""
    keys = ["gpu"] if keys is None else keys
    return telemetry.groupBy(*keys).agg(some(F.count("*"), "telemetry").alias("n"), F.max("mem_mib").alias("peak_mem_mib"), F.max("util").alias("peak_util"), F.avg("util").alias("mean_util"), F.max("temp_c").alias("peak_temp_c"), F.max("power_w").alias("peak_power_w"))


def telemetry_in_runs(telemetry: DataFrame, runs: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """telemetry (gpu, ts, ...) within runs' [started, ended], both ends included: an equi-join on time buckets, then
    the exact test, so neither side is broadcast and no pair outside a bucket is made."""
    b = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    spans = runs.where("started <= ended").withColumn("bucket", F.explode(F.sequence(b(F.col("started")), b(F.col("ended")))))
    both = telemetry.withColumn("bucket", b(F.col("ts"))).join(spans, "bucket").where(F.col("ts").between(F.col("started"), F.col("ended")))
    return both.withColumn("seconds", (F.unix_micros("ts") - F.unix_micros("started")) / F.lit(1e6)).drop("bucket")


def sequence_mismatches(a: DataFrame, b: DataFrame, order: str, value: str) -> DataFrame:
    """Positions from 1 at which two ordered columns differ, either side's surplus included."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        own = positions(df.select(F.col(order).alias("o"), F.col(value).alias(name)), ["o"])
        return own.select((F.col("position") + 1).alias("position"), name)

    both = ranked(a, "left_value").join(ranked(b, "right_value"), "position", "full")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of one side only, with the side; none if the sets are equal."""
    left, right = a.toDF("value").distinct(), b.toDF("value").distinct()
    return left.join(right, "value", "left_anti").withColumn("side", F.lit("left")).unionAll(right.join(left, "value", "left_anti").withColumn("side", F.lit("right")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def valid_runs(traces: DataFrame, expected: int = 30) -> DataFrame:
    """traces (run, query, status) -> per run whether it has exactly `expected` distinct queries, all with status ok."""
    return traces.groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("query").alias("n_queries"), F.bool_and(F.col("status") == "ok").alias("all_ok")).withColumn("valid", (F.col("n") == expected) & (F.col("n_queries") == expected) & F.col("all_ok"))


def accepted_runs(accepted: DataFrame, traces: DataFrame, results: DataFrame, thresholds_sha: str, expected: int = 30) -> DataFrame:
    """accepted (pair_dir, side, pair_valid, status, thresholds_sha256, ...) with its artifacts: traces (pair_dir, side,
    query, status, ...) and results (pair_dir, side, query) -> accepted with trace_count, result_count, set_gap (queries
    of one side only) and valid: the pair is valid, the run completed under these thresholds, traces and results are as
    many as expected, every trace is ok and both have the same queries. A run without artifacts isn't valid."""
    keys = ["pair_dir", "side"]
    t = traces.groupBy(*keys).agg(F.count("*").alias("trace_count"), F.bool_and(F.col("status") == "ok").alias("all_ok"))
    r = results.groupBy(*keys).agg(F.count("*").alias("result_count"))
    in_traces, in_results = traces.select(*keys, "query").distinct().withColumn("t", F.lit(1)), results.select(*keys, "query").distinct().withColumn("r", F.lit(1))
    gap = in_traces.join(in_results, [*keys, "query"], "full").groupBy(*keys).agg(F.count_if(F.col("t").isNull() | F.col("r").isNull()).alias("set_gap"))
    out = accepted.join(t, keys, "left").join(r, keys, "left").join(gap, keys, "left").na.fill(0, ["trace_count", "result_count", "set_gap"])
    ok = F.col("pair_valid") & (F.col("status") == "completed") & (F.col("thresholds_sha256") == thresholds_sha) & (F.col("trace_count") == expected) & (F.col("result_count") == expected) & F.col("all_ok") & (F.col("set_gap") == 0)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("all_ok")


def all_valid(runs: DataFrame, name: str = "run_key") -> DataFrame:
    """runs, or an error that names the first that isn't valid."""
    return runs.withColumn("valid", F.when(~F.col("valid"), F.raise_error(F.concat(F.lit("run failed validation: "), F.col(name).cast("string"))).cast("boolean")).otherwise(F.col("valid")))


def run_metrics(runs: DataFrame, traces: DataFrame, telemetry: DataFrame) -> DataFrame:
    """runs (pair_dir, side, gpu, ...) with the trace summary of their side and the device summary of their gpu."""
    t = trace_summary(traces, ["pair_dir", "side"])
    g = gpu_summary(telemetry, ["pair_dir", "gpu"]).withColumnRenamed("n", "telemetry_rows")
    return runs.join(t, ["pair_dir", "side"], "left").join(g, ["pair_dir", "gpu"], "left")


def prefetch_report(pages: DataFrame, url: str, embedded: str, cached: str) -> DataFrame:
    """pages with their status: embedded, else missing (no address), else cached, else failed."""
    status = F.when(F.col(embedded), "embedded").when(F.coalesce(F.col(url), F.lit("")) == "", "missing").when(F.col(cached), "cached").otherwise("failed")
    return pages.withColumn("status", status)


def prefetch_status(pages: DataFrame, url: str, embedded: str, cached: str) -> DataFrame:
    """How many pages have each status."""
    return prefetch_report(pages, url, embedded, cached).groupBy("status").agg(F.count("*").alias("n"))
