"""Per-turn flags, the early-stop rule, session scores and global metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridix.functions.stats import ratio
from veridix.functions.text import is_exact_match, is_idk

METRICS = ["total", "correct_exact", "correct", "miss", "hallucination", "exact_accuracy", "accuracy", "missing", "hallucination_rate", "truthfulness_score", "mean_multi_turn_conversation_score"]


def turn_flags(turns: DataFrame, verdict: str | None = "verdict") -> DataFrame:
    """Adds is_exact_match, is_miss, is_semantically_correct, is_correct and status. The judge's verdict counts only
    where the answer is neither exact nor a refusal; without a judge nothing is semantically correct."""
    exact, miss = is_exact_match(F.col("agent_response"), F.col("ground_truth")), is_idk(F.col("agent_response"))
    judged = F.coalesce(F.col(verdict), F.lit(False)) if verdict else F.lit(False)
    out = turns.withColumns({"is_exact_match": exact, "is_miss": miss})
    out = out.withColumn("is_semantically_correct", F.col("is_exact_match") | (~F.col("is_miss") & judged))
    out = out.withColumn("is_correct", F.col("is_semantically_correct"))
    status = F.when(F.col("is_exact_match"), "exact").when(F.col("is_correct"), "semantic").when(F.col("is_miss"), "miss").otherwise("incorrect")
    return out.withColumn("status", status)


def early_stop(flags: DataFrame, session: str = "session_id", order: str = "turn_idx") -> DataFrame:
    """After the first two incorrect turns in a row (a refusal is incorrect) the session's later turns become misses.

    The flags' own columns stay as they are; the adjusted ones are adj_*.
    """
    w = Window.partitionBy(session).orderBy(order)
    pair = ~F.col("is_correct") & ~F.coalesce(F.lag("is_correct").over(w), F.lit(True))
    out = flags.withColumn("__pair", pair.cast("int"))
    out = out.withColumn("stopped", F.coalesce(F.max("__pair").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1).drop("__pair")
    go = ~F.col("stopped")
    return out.withColumns({"adj_correct": F.col("is_correct") & go, "adj_exact": F.col("is_exact_match") & go, "adj_miss": F.col("is_miss") | F.col("stopped")})


def session_scores(adjusted: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    one = lambda c: F.avg(c.cast("double"))
    wrong = ~F.col("adj_correct") & ~F.col("adj_miss")
    return adjusted.groupBy(*keys).agg((one(F.col("adj_correct")) - one(wrong)).alias("score"))


def score_dictionary(adjusted: DataFrame) -> DataFrame:
    """One row for scope `all` and one for `ego`: METRICS. Empty scopes give zeros; truthfulness is 0 up to one turn.

    Every scope's sums and its sessions' scores come from one pass of partial aggregation by session.
    """
    n = lambda c: F.sum(c.cast("long"))
    wrong = ~F.col("adj_correct") & ~F.col("adj_miss")
    per = adjusted.groupBy("session_id", "is_ego").agg(F.count("*").alias("total"), n(F.col("adj_exact")).alias("correct_exact"), n(F.col("adj_correct")).alias("correct"), n(F.col("adj_miss")).alias("miss"), n(wrong).alias("wrong"))
    scoped = per.withColumn("scope", F.explode(F.when(F.col("is_ego"), F.array(F.lit("all"), F.lit("ego"))).otherwise(F.array(F.lit("all")))))
    sums = scoped.groupBy("scope").agg(*[F.sum(c).alias(c) for c in ("total", "correct_exact", "correct", "miss")], F.avg((F.col("correct") - F.col("wrong")) / F.col("total")).alias("mean_multi_turn_conversation_score"))
    bad = F.col("total") - (F.col("correct") + F.col("miss"))
    out = sums.withColumn("hallucination", bad)
    t = F.col("total")
    truth = F.when(t > 1, ratio(2 * F.col("correct") + F.col("miss"), t) - 1).otherwise(0.0)
    return out.select("scope", "total", "correct_exact", "correct", "miss", "hallucination", ratio(F.col("correct_exact"), t).alias("exact_accuracy"), ratio(F.col("correct"), t).alias("accuracy"), ratio(F.col("miss"), t).alias("missing"), ratio(F.col("hallucination"), t).alias("hallucination_rate"), truth.alias("truthfulness_score"), "mean_multi_turn_conversation_score")


Judge = Callable[[str, str, str], bool | None]


def judged(turns: DataFrame, judge: Judge, attempts: int = 3) -> DataFrame:
    """turns (query, ground_truth, agent_response, ...) with `verdict` by an injected judge, asked only where the answer
    is neither exact nor a refusal; a judge that fails `attempts` times gives null."""
    asked = ~is_exact_match(F.col("agent_response"), F.col("ground_truth")) & ~is_idk(F.col("agent_response"))
    rows = turns.drop("verdict").withColumn("__asked", asked)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for q, t, r in zip(pdf["query"], pdf["ground_truth"], pdf["agent_response"], strict=True):
                for n in range(attempts):
                    try:
                        out.append(judge(q, t, r))
                        break
                    except Exception:  # noqa: BLE001  the judge may be away
                        if n + 1 == attempts:
                            out.append(None)
            yield pdf.assign(verdict=pd.Series(out, dtype=object, index=pdf.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.drop("verdict").schema)
    asked_rows = rows.where("__asked").drop("__asked").mapInPandas(run, fields + ", verdict boolean")
    return asked_rows.unionByName(rows.where("not __asked").drop("__asked").withColumn("verdict", F.lit(None).cast("boolean")))


def display_metrics(scores: DataFrame, turns: DataFrame) -> DataFrame:
    """scope, place, metric, value: the score rows as the printed panel shows them, over scopes `all` and `ego`."""
    both = F.explode(F.when(F.col("is_ego"), F.array(F.lit("all"), F.lit("ego"))).otherwise(F.array(F.lit("all"))))
    n = turns.withColumn("scope", both).groupBy("scope").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("interaction_id").alias("turns"))
    fixed = lambda c, d: F.replace(F.format_number(F.col(c), d), F.lit(","), F.lit(""))
    percent = lambda c: F.concat(F.replace(F.format_number(F.col(c) * 100, 2), F.lit(","), F.lit("")), F.lit("%"))
    whole = lambda c: F.col(c).cast("string")
    # The labels of the printed panel.
    shown = [("Total conversations", whole("sessions")), ("Total turns", whole("turns")), ("Avg MT conversation score", fixed("mean_multi_turn_conversation_score", 2)), ("Exact matches", whole("correct_exact")), ("Refusals", whole("miss")), ("Hallucinated responses", whole("hallucination")), ("Exact accuracy", percent("exact_accuracy")), ("Accuracy", percent("accuracy")), ("Missing rate", percent("missing")), ("Hallucination rate", percent("hallucination_rate")), ("Truthfulness score", fixed("truthfulness_score", 4))]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(shown)]))
    return scores.join(n, "scope").select("scope", cells.alias("x")).select("scope", "x.*")


def display_sample(flags: DataFrame, sessions: int = 3) -> DataFrame:
    """Turns of the first sessions by id with their status, as the panel lists them."""
    keep = flags.select("session_id").distinct().orderBy("session_id").limit(sessions)
    return flags.join(keep, "session_id", "left_semi").select("session_id", "turn_idx", "query", "agent_response", "ground_truth", "status")
