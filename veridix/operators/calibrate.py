"""Threshold grid search, stratified sampling and blind review sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridix.functions.stats import ratio
from veridix.functions.text import IDK
from veridix.operators.order import seeded_shuffle


def threshold_grid(rows: DataFrame, grid: list[float], min_coverage: float = 0.0) -> DataFrame:
    """rows (score in [0, 1], b0_label, enriched_label) -> metrics of every pair of thresholds low < high of the grid.

    At or below low a row abstains (missing), at or above high it answers with the baseline's label, between them with
    the enriched one. A pair needs only counts, so rows are first counted by where the grid cuts their scores.
    """
    spark = rows.sparkSession
    marks = F.array(*[F.lit(float(g)) for g in grid])
    ok = F.when((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull(), F.raise_error(F.lit("score out of [0, 1]")).cast("double")).otherwise(F.col("score"))
    cells = rows.withColumn("score", ok).groupBy("score", "b0_label", "enriched_label").agg(F.count("*").alias("w"))
    cells = cells.groupBy(F.size(F.filter(marks, lambda m: m < F.col("score"))).alias("under"), F.size(F.filter(marks, lambda m: m <= F.col("score"))).alias("upto"), "b0_label", "enriched_label").agg(F.sum("w").alias("w"))
    table = spark.createDataFrame([(float(a), float(b), i, j) for i, a in enumerate(grid) for j, b in enumerate(grid) if a < b], "tau_low double, tau_high double, i int, j int")
    # at most 4 label classes squared times 2 * len(grid) + 1 cells meet the grid's pairs
    both = cells.crossJoin(F.broadcast(table))
    label = F.when(F.col("under") <= F.col("i"), "missing").when(F.col("upto") > F.col("j"), F.col("b0_label")).otherwise(F.col("enriched_label"))
    n = lambda *x: F.sum(F.when(F.col("label").isin(*x), F.col("w")).otherwise(0))
    g = both.withColumn("label", label).groupBy("tau_low", "tau_high").agg(F.sum("w").alias("total"), n("correct").alias("c"), n("missing").alias("m"), n("partial", "incorrect").alias("h"))
    t = F.col("total")
    out = g.select("tau_low", "tau_high", "total", ratio(F.col("c"), t).alias("accuracy"), ratio(F.col("m"), t).alias("missing"), ratio(F.col("h"), t).alias("hallucination"), (ratio(F.col("c"), t) - ratio(F.col("h"), t)).alias("truthfulness"), (1 - ratio(F.col("m"), t)).alias("coverage"))
    return out.withColumn("feasible", F.col("coverage") >= min_coverage)


def best_threshold(grid: DataFrame) -> DataFrame:
    """The feasible pair with most truthfulness, then accuracy, fewest missing, lowest thresholds; and how many pairs
    were feasible and rejected."""
    counts = grid.agg(F.count_if("feasible").alias("n_feasible"), F.count_if(~F.col("feasible")).alias("n_rejected"))
    best = grid.where("feasible").orderBy(F.desc("truthfulness"), F.desc("accuracy"), "missing", "tau_low", "tau_high").limit(1)
    return best.crossJoin(counts).drop("feasible")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, size: int, seed: int) -> DataFrame:
    """Round robin over strata: every stratum's first row by seeded hash, then every second, up to `size`.

    Ranks beyond `size` can't be taken, so each stratum keeps its `size` smallest hashes before rows are ranked.
    """
    h = lambda *c: F.md5(F.concat_ws("-", F.lit(str(seed)), *c))
    hashed = rows.select(*strata, key, h(F.col(key).cast("string")).alias("h"))
    w = Window.partitionBy(*strata).orderBy("h", key)
    ranked = hashed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size)
    order = [F.col("rn"), h(*[F.col(s).cast("string") for s in strata]), F.col(key)]
    picked = ranked.orderBy(*order).limit(size)
    return picked.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).select("position", key, *strata)


def align_runs(runs: DataFrame) -> DataFrame:
    """Queries that some version lacks, repeats, or has with another ground truth; none if the runs agree."""
    g = runs.groupBy("query").agg(F.count("*").alias("n"), F.count_distinct("version").alias("versions"), F.count_distinct("ground_truth").alias("truths"))
    all_versions = runs.agg(F.count_distinct("version").alias("__v"))  # one row
    return g.crossJoin(F.broadcast(all_versions)).where((F.col("n") != F.col("__v")) | (F.col("versions") != F.col("__v")) | (F.col("truths") != 1)).drop("__v")


def padded_id(prefix: str, number, width: int = 3):
    """Q001; longer numbers keep all digits."""
    s = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s))


def blind_review(runs: DataFrame, seed: int) -> DataFrame:
    """runs (source_order, query, version, answer) -> one row per distinct stripped answer of a query, with its versions
    and an order within the query that doesn't tell them: query_id, class_rank, answer, versions."""
    g = runs.groupBy("source_order", "query", F.trim("answer").alias("answer")).agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))
    w = Window.partitionBy("source_order").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("source_order").cast("string"), "answer")), "answer")
    return g.select(padded_id("Q", F.col("source_order") + 1).alias("query_id"), F.row_number().over(w).alias("class_rank"), "answer", "versions")


def review_sheet(runs: DataFrame, seed: int) -> DataFrame:
    """runs (source_order, query, ground_truth, version, answer) -> response_id (R001, in a seeded order of all classes
    that tells no version), query_id, source_order, query, ground_truth, answer, and empty label, error_cause, rationale."""
    g = runs.groupBy("source_order", "query", "ground_truth", F.trim("answer").alias("answer")).agg(F.count("*").alias("__n")).drop("__n")
    out = seeded_shuffle(g, ["source_order", "answer"], seed)
    blank = [F.lit("").alias(c) for c in ("label", "error_cause", "rationale")]
    return out.select(padded_id("R", F.col("position") + 1).alias("response_id"), padded_id("Q", F.col("source_order") + 1).alias("query_id"), "source_order", "query", "ground_truth", "answer", *blank)


def review_assignments(runs: DataFrame, sheet: DataFrame) -> DataFrame:
    """response_id, query_id, version: which versions gave which reviewed response."""
    own = runs.select("source_order", F.trim("answer").alias("answer"), "version")
    return own.join(sheet.select("response_id", "query_id", "source_order", "answer"), ["source_order", "answer"]).select("response_id", "query_id", "version")


def contract_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (prediction, ground_truth) of contract suites -> counts and rates of each run; a refusal is missing, every
    other answer that isn't the truth a hallucination."""
    right, idk = F.col("prediction") == F.col("ground_truth"), F.col("prediction") == IDK
    g = rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(right).alias("correct"), F.count_if(idk).alias("missing"))
    g = g.withColumn("hallucination", F.col("samples") - F.col("correct") - F.col("missing"))
    n = F.col("samples")
    return g.select("*", ratio(F.col("correct"), n).alias("accuracy"), ratio(F.col("missing"), n).alias("missing_rate"), ratio(F.col("hallucination"), n).alias("hallucination_rate"), ratio(F.col("correct") - F.col("hallucination"), n).alias("truthfulness"))
