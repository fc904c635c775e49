"""Paired comparison of system versions from labelled reviews (query_id, version, label, error_cause, source_order)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridix.functions.stats import mcnemar_p, percentile_linear, ratio
from veridix.operators.order import positions

LABELS = ["correct", "partial", "incorrect", "missing"]
LABEL_METRICS = ["accuracy", "missing", "hallucination", "truthfulness", "coverage"]
BOOTSTRAP_METRICS = LABEL_METRICS[:4]


def checked(reviews: DataFrame) -> DataFrame:
    ok = F.col("label").isin(*LABELS)
    return reviews.withColumn("label", F.when(ok, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))).cast("string")))


def unsupported(reviews: DataFrame, keys: list[str], allowed: list[str] = LABELS) -> DataFrame:
    """keys, labels: the labels of each group that aren't allowed, sorted; groups without any have no row."""
    g = reviews.groupBy(*keys).agg(F.array_sort(F.array_except(F.collect_set("label"), F.array(*[F.lit(x) for x in allowed]))).alias("labels"))
    return g.where(F.size("labels") > 0)


def scoped(reviews: DataFrame, primary_from: int = 10, strict: bool = False) -> DataFrame:
    """Every row in scope `all`, those with source_order >= primary_from in `primary` too. Strict: an empty primary
    scope raises."""
    if strict and reviews.where(F.col("source_order") >= primary_from).isEmpty():
        raise ValueError(f"no review has a source_order of {primary_from} or more")
    both = F.when(F.col("source_order") >= primary_from, F.array(F.lit("all"), F.lit("primary"))).otherwise(F.array(F.lit("all")))
    return reviews.withColumn("scope", F.explode(both))


def primary_ids(reviews: DataFrame, primary_from: int = 10) -> DataFrame:
    """query_id, source_order, position from 0: the primary scope's queries in source order."""
    own = reviews.where(F.col("source_order") >= primary_from).groupBy("query_id").agg(F.min("source_order").alias("source_order"))
    return positions(own, ["source_order", "query_id"])


def label_metrics(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of the labels of each group; with keys [] over all rows, where none raises."""
    n = lambda x: F.count_if(F.col("label") == x)
    g = reviews.groupBy(*keys).agg(F.when(F.count("*") == 0, F.raise_error(F.lit("at least one label is required")).cast("long")).otherwise(F.count("*")).alias("total"), n("correct").alias("n_correct"), n("partial").alias("n_partial"), n("incorrect").alias("n_incorrect"), n("missing").alias("n_missing"))
    t, bad = F.col("total"), F.col("n_partial") + F.col("n_incorrect")
    return g.select(*keys, "total", "n_correct", "n_partial", "n_incorrect", "n_missing", ratio(F.col("n_correct"), t).alias("accuracy"), ratio(F.col("n_missing"), t).alias("missing"), ratio(bad, t).alias("hallucination"), (ratio(F.col("n_correct"), t) - ratio(bad, t)).alias("truthfulness"), (1 - ratio(F.col("n_missing"), t)).alias("coverage"))


def paired_deltas(metrics: DataFrame, baseline: str = "b0") -> DataFrame:
    base = metrics.where(F.col("version") == baseline).select("scope", *[F.col(m).alias(f"base_{m}") for m in LABEL_METRICS])
    return metrics.where(F.col("version") != baseline).join(base, "scope").select("scope", "version", *[(F.col(m) - F.col(f"base_{m}")).alias(f"delta_{m}") for m in LABEL_METRICS])


def pairs(reviews: DataFrame, baseline: str = "b0") -> DataFrame:
    """scope, version, query_id, base_label, label of every other version's row and the baseline's for its query."""
    base = reviews.where(F.col("version") == baseline).select("scope", "query_id", F.col("label").alias("base_label"))
    return reviews.where(F.col("version") != baseline).join(base, ["scope", "query_id"]).select("scope", "version", "query_id", "base_label", "label")


def mcnemar(paired: DataFrame) -> DataFrame:
    right, was = F.col("label") == "correct", F.col("base_label") == "correct"
    g = paired.groupBy("scope", "version").agg(F.count_if(was & ~right).alias("b"), F.count_if(~was & right).alias("c"))
    return g.withColumn("p_value", mcnemar_p(F.col("b"), F.col("c")))


def transitions(paired: DataFrame) -> DataFrame:
    return paired.groupBy("scope", "version", "base_label", "label").agg(F.count("*").alias("n"))


def error_causes(reviews: DataFrame) -> DataFrame:
    return reviews.where("label <> 'correct'").groupBy("scope", "version", "error_cause").agg(F.count("*").alias("n"))


def refusal_quality(paired: DataFrame) -> DataFrame:
    """Refusals by what the baseline answered; versions without refusals keep a row of zeros."""
    miss = F.col("label") == "missing"
    return paired.groupBy("scope", "version").agg(F.count_if(miss).alias("missing"), F.count_if(miss & (F.col("base_label") == "correct")).alias("harmful"), F.count_if(miss & (F.col("base_label") == "missing")).alias("also_missing"), F.count_if(miss & F.col("base_label").isin("partial", "incorrect")).alias("avoided"))


#: Quarters of draws (an MD5 gives four) that one row makes and sums.
QUARTERS = 1 << 16
_SIDES = {"accuracy": ("correct",), "missing": ("missing",), "hallucination": ("partial", "incorrect")}


def outcome_cells(paired: DataFrame) -> DataFrame:
    """pairs -> scope, pattern, n, outcomes: queries counted by what all versions answered (the pattern, its versions in
    order). With v versions beside the baseline there are at most 4 (4 + 1)^v cells, and never more than queries."""
    said = F.sort_array(F.collect_list(F.struct("version", "base_label", "label")))  # a row a version
    own = paired.groupBy("scope", "query_id").agg(said.alias("outcomes"))
    pattern = F.array_join(F.transform("outcomes", lambda x: F.concat_ws(":", x["version"], x["base_label"], x["label"])), ",")
    return own.groupBy("scope", pattern.alias("pattern")).agg(F.count("*").alias("n"), F.any_value("outcomes").alias("outcomes"))


def bootstrap_ci(paired: DataFrame, samples: int = 10_000, seed: int = 20260712) -> DataFrame:
    """pairs -> scope, version, metric, observed_delta, ci_low, ci_high, bootstrap_samples, seed: percentile intervals of
    every metric's delta over resamples of the queries with replacement, drawn alike for both arms and all versions.

    Queries are numbered by (pattern of outcomes, query), so queries of one outcome lie together: draw j of sample b of a
    scope names a number by a quarter of a hash of seed, scope, b and j div 4, and the number its cell by a search in the
    cells' ends. A row stands for up to 4 QUARTERS draws of one sample; it draws, counts cells and sends the sums on, so
    neither draws nor queries are shuffled or joined. The cells (see outcome_cells for their number) go to all tasks.
    One job, which counts the cells, runs while the plan is built.
    """
    spark = paired.sparkSession
    cells: dict[str, list] = {}
    for r in outcome_cells(paired).orderBy("scope", "pattern").collect():
        cells.setdefault(r["scope"], []).append((r["n"], {o["version"]: (o["base_label"], o["label"]) for o in r["outcomes"]}))
    ends, values, versions = {}, {}, {}
    for scope, rows in cells.items():
        versions[scope] = sorted({v for _, o in rows for v in o})
        ends[scope] = np.cumsum([n for n, _ in rows])
        # by cell, version: whether the version has the query, and its deltas
        delta = lambda o: [1, *[(o[1] in x) - (o[0] in x) for x in _SIDES.values()]] if o else [0] * 4
        values[scope] = np.array([[delta(o.get(v)) for v in versions[scope]] for _, o in rows], np.int64)
    if not cells:
        return spark.createDataFrame([], "scope string, version string, metric string, observed_delta double, ci_low double, ci_high double, bootstrap_samples bigint, seed bigint")
    sent = spark.sparkContext.broadcast((ends, values, versions))
    kinds = "scope string, version string, b long, present long, accuracy long, missing long, hallucination long"

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, values, versions = sent.value
        for pdf in parts:
            out = []
            for scope, b, lo in zip(pdf["scope"], pdf["b"].tolist(), pdf["lo"].tolist(), strict=True):
                n = int(ends[scope][-1])
                hi = min(lo + QUARTERS, -(-n // 4))
                said = f"{seed}-{scope}-{b}-"
                code = np.frombuffer(b"".join([hashlib.md5(f"{said}{q}".encode(), usedforsecurity=False).digest() for q in range(lo, hi)]), ">u4")[: n - 4 * lo]
                count = np.bincount(np.searchsorted(ends[scope], code.astype(np.int64) % n, side="right"), minlength=len(ends[scope]))
                out += [(scope, v, b, *x) for v, x in zip(versions[scope], np.tensordot(count, values[scope], 1).tolist(), strict=True)]
            yield pd.DataFrame(out, columns=[k.split()[0] for k in kinds.split(", ")])

    sizes = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(int(e[-1])).alias("n")) for s, e in ends.items()])
    todo = spark.range(samples).select(F.col("id").alias("b"), F.explode(sizes).alias("s"))
    todo = todo.select("b", "s.scope", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("s.n") - 1) / 4), F.lit(QUARTERS).cast("long"))).alias("lo"))
    sums = todo.select("scope", "b", "lo").mapInPandas(draw, kinds)
    per = sums.groupBy("scope", "version", "b").agg(*[(F.sum(m).cast("double") / F.nullif(F.sum("present"), F.lit(0))).alias(m) for m in _SIDES])
    per = per.withColumn("truthfulness", F.col("accuracy") - F.col("hallucination"))
    long = lambda df, *keep: df.select("scope", "version", *keep, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("delta")) for m in BOOTSTRAP_METRICS])).alias("x")).select("scope", "version", *keep, "x.*")
    ci = long(per).groupBy("scope", "version", "metric").agg(percentile_linear(F.col("delta"), 0.025).alias("ci_low"), percentile_linear(F.col("delta"), 0.975).alias("ci_high"), F.count("*").alias("bootstrap_samples"))  # as many values a group as samples
    seen = []
    for scope, v in values.items():
        total = np.tensordot(np.diff(ends[scope], prepend=0), v, 1).tolist()
        seen += [(scope, name, a / n, m / n, h / n, (a - h) / n) for name, (n, a, m, h) in zip(versions[scope], total, strict=True)]
    observed = long(spark.createDataFrame(seen, "scope string, version string, accuracy double, missing double, hallucination double, truthfulness double")).withColumnRenamed("delta", "observed_delta")
    return observed.join(ci, ["scope", "version", "metric"]).withColumn("seed", F.lit(seed).cast("long"))


def expand_reviews(assignments: DataFrame, reviews: DataFrame, queries: DataFrame) -> DataFrame:
    """assignments (response_id, query_id, version) with the reviews of their responses and their queries' order; a
    review or query that is missing, or that names another query, raises."""
    a = assignments.join(reviews.withColumnRenamed("query_id", "__q"), "response_id", "left").join(queries, "query_id", "left")
    bad = F.col("label").isNull() | F.col("source_order").isNull() | (F.col("__q") != F.col("query_id"))
    return a.withColumn("label", F.when(bad, F.raise_error(F.lit("assignments, reviews and queries disagree")).cast("string")).otherwise(F.col("label"))).drop("__q")
