import random

import pytest
from pyspark.sql import functions as F

from veridix.operators import calibrate as C
from veridix.operators import evidence as E
from veridix.operators import paired as P
from veridix.operators import scoring as S
from veridix.operators import telemetry as T
from veridix.operators import turns as U
from veridix.operators.generate import Waves, wave_generate
from veridix.operators.retrieval import cosine_top_k

TURN = "struct<interaction_id:array<string>,query:array<string>>"
ANSWER = "struct<interaction_id:array<string>,ans_full:array<string>>"


def test_explode_turns_in_both_layouts(spark):
    cols = spark.createDataFrame([("s", None, (["i", "j"], ["q1", "q2"]), (["j", "i"], ["b", "a"]))], f"session_id string, image_url string, turns {TURN}, answers {ANSWER}")
    rows = spark.createDataFrame([("s", None, [("i", "q1"), ("j", "q2")], [("j", "b"), ("i", "a")])], "session_id string, image_url string, turns array<struct<interaction_id:string,query:string>>, answers array<struct<interaction_id:string,ans_full:string>>")
    for df in (cols, rows):
        got = [(r["turn_idx"], r["query"], r["ground_truth"], r["is_ego"], r["total_turn_count"]) for r in U.explode_turns(df).orderBy("turn_idx").collect()]
        assert got == [(0, "q1", "a", True, 2), (1, "q2", "b", True, 2)]
    bad = spark.createDataFrame([("s", "u", (["i"], ["q"]), (["x"], ["b"]))], cols.schema)
    with pytest.raises(Exception, match="no answer"):
        U.explode_turns(bad).collect()
    assert U.explode_turns(cols, ("s",)).count() == 0


def test_early_stop_equals_the_loop(spark):
    rng = random.Random(1)
    rows = [(s, t, ok, ok and rng.random() < 0.5, not ok and rng.random() < 0.3) for s in range(60) for t in range(rng.randint(1, 7)) for ok in [rng.random() < 0.5]]
    df = spark.createDataFrame(rows, "session_id int, turn_idx int, is_correct boolean, is_exact_match boolean, is_miss boolean")
    got = {(r["session_id"], r["turn_idx"]): (r["adj_correct"], r["adj_exact"], r["adj_miss"]) for r in S.early_stop(df).collect()}
    for s in range(60):
        own = sorted(r for r in rows if r[0] == s)
        stop = next((i for i in range(1, len(own)) if not own[i][2] and not own[i - 1][2]), len(own))
        for i, r in enumerate(own):
            assert got[r[0], r[1]] == ((False, False, True) if i > stop else (r[2], r[3], r[4]))


def test_gate_table(spark):
    cases = [("b0", 0.1, True, "answer"), ("a2", 0.4, True, "expand"), ("a2", 0.6, False, "answer"), ("a3", 0.2, False, "abstain"), ("a3", 0.8, True, "abstain"), ("a3", 0.5, False, "answer"), ("full", 0.2, False, "abstain"), ("full", 0.4, False, "expand"), ("full", 0.8, False, "answer"), ("a2_enrich_all", 0.3, False, "abstain"), ("a2_enrich_all", 0.9, True, "expand")]
    df = spark.createDataFrame(cases, "v string, s double, c boolean, want string")
    assert df.where(E.gate_action(F.col("v"), F.col("s"), F.col("c")) != F.col("want")).count() == 0
    with pytest.raises(ValueError, match="thresholds"):
        E.gate_action(F.lit("b0"), F.lit(0.5), F.lit(False), 0.6, 0.3)


def test_web_evidence_filters_and_dedupes(spark):
    hits = [(1, "tower", 1, 0.1, "p", "low", "u1"), (1, "tower", 2, 0.9, "Tower", "tall", "u2"), (1, "tower", 3, 0.8, "Tower", "tall", "u2"), (1, "tower", 4, 0.9, "p", "", "u3")]
    got = E.web_evidence(spark.createDataFrame(hits, "turn_id int, query string, pos int, score double, page_name string, page_snippet string, page_url string")).collect()
    assert [(r["evidence_id"], r["text"]) for r in got] == [("WEB1", "Tower: tall")]


def test_kg_evidence_ranks_by_relevance_and_keeps_ties_in_order(spark):
    rows = [(1, "Who is the architect of Tower", 0, 0.9, 0, "Tower", i, f, v) for i, (f, v) in enumerate([("height", "10"), ("architect", "[[F G]]"), ("floors", "7"), ("empty", "")])]
    rows += [(1, "Who is the architect of Tower", 1, 0.5, 0, "Tower", 0, "height", "10")]
    got = E.kg_evidence(spark.createDataFrame(rows, "turn_id int, query string, hit_pos int, score double, entity_pos int, entity_name string, attr_pos int, field string, value string")).orderBy("rank").collect()
    assert [(r["evidence_id"], r["text"]) for r in got] == [("KG1", "Tower | architect: F G"), ("KG2", "Tower | height: 10"), ("KG3", "Tower | floors: 7")]


def test_agreement_reranks(spark):
    image = spark.createDataFrame([(1, 1, "Texas | kind: state", 0.82), (1, 2, "Taiwan | kind: island", 0.79)], "turn_id int, rank int, text string, score double")
    web = spark.createDataFrame([(1, 1, "Taiwan facts")], "turn_id int, rank int, text string")
    got = E.agreement(image, web, spark.createDataFrame([(1, "which island")], "turn_id int, query string")).orderBy("entity_rank").collect()
    assert [r["entity_name"] for r in got] == ["Taiwan", "Texas"]
    assert got[0]["margin"] == pytest.approx(got[0]["top_score"] - got[0]["second_score"])


def test_numeric_conflict(spark):
    rows = [("What is the engine size", "2.0", "2.7", True), ("When", "1959", "in 1959", False), ("Who built it", "1", "2", False), ("When", "", "2", False)]
    df = spark.createDataFrame(rows, "q string, a string, b string, want boolean")
    assert df.where(E.numeric_conflict(F.col("q"), F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_calibration_prefers_truth_then_coverage(spark):
    rows = spark.createDataFrame([(0.2, "incorrect", "incorrect"), (0.5, "incorrect", "correct"), (0.8, "correct", "correct")], "score double, b0_label string, enriched_label string")
    grid = C.threshold_grid(rows, [0.2, 0.3, 0.5, 0.6])
    best = C.best_threshold(grid).first()
    slow = {}
    for lo in (0.2, 0.3, 0.5, 0.6):
        for hi in (0.2, 0.3, 0.5, 0.6):
            if lo < hi:
                labels = ["missing" if s <= lo else e if s < hi else b for s, b, e in [(0.2, "incorrect", "incorrect"), (0.5, "incorrect", "correct"), (0.8, "correct", "correct")]]
                slow[lo, hi] = (labels.count("correct"), labels.count("missing"))
    for r in grid.collect():
        assert (round(r["accuracy"] * 3), round(r["missing"] * 3)) == slow[r["tau_low"], r["tau_high"]]
    assert (best["tau_low"], best["tau_high"]) == (0.2, 0.6)
    with pytest.raises(Exception, match="score out"):
        C.threshold_grid(spark.createDataFrame([(1.5, "correct", "correct")], rows.schema), [0.2, 0.3]).collect()


def test_labels_are_checked(spark):
    with pytest.raises(Exception, match="unknown label"):
        P.checked(spark.createDataFrame([("x",)], "label string")).collect()


def test_refusals_keep_zero_rows(spark):
    r = spark.createDataFrame([("all", 1, "b0", "correct"), ("all", 1, "a1", "correct"), ("all", 1, "a2", "missing")], "scope string, query_id int, version string, label string")
    got = {x["version"]: (x["missing"], x["harmful"]) for x in P.refusal_quality(P.pairs(r)).collect()}
    assert got == {"a1": (0, 0), "a2": (1, 1)}


def test_merge_web_keeps_the_first(spark):
    cols = "turn_id int, rank int, evidence_id string, text string, score double, query_relevance double, url string"
    a = spark.createDataFrame([(1, 1, "WEB1", "t", 1.0, 1.0, "u1")], cols)
    b = spark.createDataFrame([(1, 1, "WEB1", "x", 1.0, 1.0, "u1"), (1, 2, "WEB2", "y", 1.0, 1.0, "u2"), (1, 3, "WEB3", "Y!", 1.0, 1.0, ""), (1, 4, "WEB4", "y", 1.0, 1.0, None)], cols)
    assert [(r["evidence_id"], r["text"]) for r in E.merge_web(a, b).orderBy("rank").collect()] == [("WEB1", "t"), ("WEB2", "y"), ("WEB3", "Y!")]


def test_budget_stops_at_the_first_overflow(spark):
    e = spark.createDataFrame([(1, 1, "A", 0.5, "xxxx"), (1, 2, "B", 0.5, "y" * 50), (1, 3, "C", 0.5, "z")], "turn_id int, rank int, evidence_id string, score double, text string")
    assert [r["evidence_id"] for r in E.within_budget(e, 45).collect()] == ["A"]


def test_sequences(spark):
    a = spark.createDataFrame([(i, "x") for i in range(10)], "o int, v string")
    assert T.sequence_mismatches(a, a, "o", "v").count() == 0
    assert T.sequence_mismatches(a, a.where("o <> 9"), "o", "v").count() == 1
    runs = spark.createDataFrame([("r", f"q{i}", "ok") for i in range(30)] + [("s", "q", "ok")] * 30, "run string, query string, status string")
    assert {r["run"]: r["valid"] for r in T.valid_runs(runs).collect()} == {"r": True, "s": False}


def test_cosine_ties_go_to_the_smaller_id(spark):
    e = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "item_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["item_id"] for r in cosine_top_k(e, q, 2).orderBy("rank").collect()] == [1, 3]


def test_waves_see_earlier_answers(spark):
    t = spark.createDataFrame([(1, 0, "a b", None), (1, 1, "c", None), (2, 0, "d", "forced")], "session_id long, turn_idx long, query string, forced_answer string")
    got = {(r["session_id"], r["turn_idx"]): r["agent_response"] for r in wave_generate(t).collect()}
    assert got == {(1, 0): "0:a", (1, 1): "2:c", (2, 0): "forced"}
    with pytest.raises(Exception, match="another number"):
        wave_generate(t, lambda q, h: []).collect()


def test_waves_fill_batches_from_open_sessions():
    """Batches are full while sessions allow, hold one turn of a session, and every history is the session's so far."""
    rng = random.Random(5)
    rows = [(s, t, f"q{s}-{t}", "forced" if rng.random() < 0.2 else None) for s in range(60) for t in range(rng.choice([1, 1, 2, 3, 30]))]
    batches = []

    def backend(queries, histories):
        batches.append(queries)
        sessions = [q[1:].split("-")[0] for q in queries]
        assert len(set(sessions)) == len(sessions)
        for q, h in zip(queries, histories, strict=True):
            s, t = q[1:].split("-")
            assert [m["content"] for m in h if m["role"] == "user"] == [f"q{s}-{i}" for i in range(int(t))]
            assert all(m["content"] in ("forced", f"a q{s}-{i // 2}") for i, m in enumerate(h) if m["role"] == "assistant")
        return [f"a {q}" for q in queries]

    waves = Waves(iter(rows), backend, 8)
    got = list(waves.answers())
    assert sorted(got) == sorted((s, t, q, a or f"a {q}") for s, t, q, a in rows) and not waves.open and waves.waiting == 0
    assert max(map(len, batches)) == 8 and len(batches) < len(rows) / 4


def test_waves_of_a_long_session_hold_few_turns(monkeypatch):
    monkeypatch.setattr("veridix.operators.generate.WAITING", 10)
    rows = [(0, t, "q", None) for t in range(500)] + [(s, 0, "q", None) for s in range(1, 5)]
    waves, most = Waves(iter(rows), lambda q, h: [str(len(x)) for x in h], 4), 0
    for n, row in enumerate(waves.answers()):
        most = max(most, waves.waiting)
        assert row[3] == str(2 * row[1])
    assert n == 503 and most <= 10


def test_waves_are_one_scan_and_one_shuffle(spark):
    rows = [(s, t, f"{s} {t}", None) for s in range(40) for t in range(s % 7 + 1)] + [(None, 0, "x", None)]
    t = spark.createDataFrame(rows, "session_id long, turn_idx long, query string, forced_answer string").repartition(5)
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    got = {(r["session_id"], r["turn_idx"]): r["agent_response"] for r in wave_generate(t, cut=cut, batch=3).collect()}
    assert got == {(s, i): f"{2 * i}:{s}" for s, i, _, _ in rows if s is not None}
    assert len(plans) == 1 and plans[0].count("RepartitionByExpression [session_id") == 1 and "Window" not in plans[0]


def test_stratified_sample_takes_every_stratum_first(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b") for i in range(53)], "id int, s string")
    got = C.stratified_sample(df, ["s"], "id", 6, 1).collect()
    assert sum(r["s"] == "b" for r in got) == 3
