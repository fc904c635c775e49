import random
from collections import Counter
from statistics import median

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridix.functions import text as X
from veridix.functions.stats import percentiles, percentiles_by_rounds
from veridix.operators import calibrate as C
from veridix.operators import evidence as E
from veridix.operators import order as O
from veridix.operators import paired as P
from veridix.operators import retrieval as R
from veridix.operators import scoring as S
from veridix.operators import telemetry as T
from veridix.operators import turns as U
from veridix.sources import files as X2


def linear(values, p):
    v = sorted(values)
    x = p * (len(v) - 1)
    a = int(x)
    return v[a] + (v[min(a + 1, len(v) - 1)] - v[a]) * (x - a)


def nearest(values, p):
    return sorted(values)[round(p * (len(values) - 1))]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_percentiles_equal_sorting(spark, monkeypatch, accuracy):
    """Also where the sketch is coarse, so most rows lie outside the brackets, and with ties and a group of one."""
    monkeypatch.setattr("veridix.functions.stats.ACCURACY", accuracy)
    rng = random.Random(3)
    rows = [(g, float(rng.choice([rng.randint(0, 9), rng.random() * 1000]))) for g in ("a", "a", "a", "b", None) for _ in range(rng.randint(200, 900))] + [("one", 5.0), ("none", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = {"p50": ("linear", 0.5), "p95": ("linear", 0.95), "n50": ("nearest", 0.5), "n95": ("nearest", 0.95), "low": ("linear", 0.0), "top": ("nearest", 1.0)}
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", points).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g]
        for name, (kind, p) in points.items():
            assert r[name] == pytest.approx((linear if kind == "linear" else nearest)(own, p), abs=1e-9), (g, name)
        assert r["p50"] == pytest.approx(median(own))
    whole = percentiles(df, [], "v", {"m": ("linear", 0.5)}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(median([v for _, v in rows if v is not None]))
    fixture = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    assert tuple(percentiles(fixture, [], "v", {"a": ("linear", 0.5), "b": ("linear", 0.95)}).first()) == pytest.approx((2.5, 3.85))


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_percentiles_by_rounds_equal_sorting(spark, monkeypatch, accuracy):
    """Brackets narrowed to 20 rows: ties, values of all sizes, a group of one value, small groups and null keys; a coarse
    sketch costs rounds only."""
    monkeypatch.setattr("veridix.functions.stats.ACCURACY", accuracy)
    rng = random.Random(4)
    rows = [(g, float(rng.choice([rng.randint(0, 9), rng.random() * 1000, 10.0 ** rng.randint(-200, 200)]))) for g in ("a", None) for _ in range(1000)]
    rows += [("one", 5.0)] * 100 + [("few", float(i)) for i in range(7)] + [("none", None)] * 30 + [("two", float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = {"p50": ("linear", 0.5), "n95": ("nearest", 0.95), "top": ("nearest", 1.0)}
    got = {r["g"]: r for r in percentiles_by_rounds(df, ["g"], "v", points, held=50, cells=10).collect()}
    assert set(got) == {"a", None, "one", "few", "two"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g]
        for name, (kind, p) in points.items():
            assert r[name] == pytest.approx((linear if kind == "linear" else nearest)(own, p)), (g, name)
    (whole,) = percentiles_by_rounds(df, [], "v", {"m": ("linear", 0.5)}, held=50, cells=10).collect()
    assert whole["m"] == pytest.approx(median([v for _, v in rows if v is not None]))
    assert percentiles_by_rounds(df.limit(0), ["g"], "v", points).count() == 0


def test_positions_pages_and_shuffles(spark):
    ids = list(range(500))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").repartition(7)
    assert {r["id"]: r["position"] for r in O.positions(df, ["id"]).collect()} == {i: i for i in range(500)}
    got = {r["id"]: (r["page"], r["place"]) for r in O.pages(df, ["id"], 64).collect()}
    assert got == {i: divmod(i, 64) for i in range(500)}
    assert O.positions(df.limit(0), ["id"]).count() == 0
    one, two = ([r["id"] for r in O.seeded_shuffle(df, ["id"], s).orderBy("position").collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) == list(range(500)) and one != two
    with pytest.raises(ValueError, match="at least one"):
        O.pages(df, ["id"], 0)
    with pytest.raises(ValueError, match="there are"):
        O.first_of(O.positions(df, ["id"]), "position", 501)


def test_group_positions_are_dense(spark):
    df = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 7), (None, 1), (None, 2)], "g string, k long").repartition(3)
    got = O.group_positions(df, "g", "k", buckets=16).collect()
    for g, n in (("a", 300), ("b", 1), (None, 2)):
        assert sorted(r["position"] for r in got if r["g"] == g) == list(range(n))


def test_concatenated_rows_keep_their_run(spark):
    a, b = spark.createDataFrame([(1,)], "x long"), spark.createDataFrame([(2, "y")], "x long, y string")
    assert {(r["run"], r["x"], r["y"]) for r in O.concatenated({"a": a, "b": b}).collect()} == {("a", 1, None), ("b", 2, "y")}
    with pytest.raises(ValueError, match="nothing"):
        O.concatenated({})


def test_bootstrap_equals_the_loop(spark):
    rng = random.Random(4)
    labels = ["correct", "partial", "incorrect", "missing"]
    rows = [("all", v, q, rng.choice(labels), q) for v in ("b0", "a1", "a2") for q in range(12)]
    r = spark.createDataFrame(rows, "scope string, version string, query_id long, label string, source_order long")
    pairs = P.pairs(r)
    got = {(x["version"], x["metric"]): x for x in P.bootstrap_ci(pairs, 200, 5).collect()}
    label = {(v, q): lab for _, v, q, lab, _ in rows}
    pattern = lambda q: ",".join(f"{v}:{label['b0', q]}:{label[v, q]}" for v in ("a1", "a2"))
    by = sorted(range(12), key=lambda q: (pattern(q), q))  # queries of one outcome lie together
    import hashlib

    def score(version, qs, metric):
        c = Counter(label[version, q] for q in qs)
        acc, miss, hall = c["correct"] / len(qs), c["missing"] / len(qs), (c["partial"] + c["incorrect"]) / len(qs)
        return {"accuracy": acc, "missing": miss, "hallucination": hall, "truthfulness": acc - hall}[metric]

    draws = [[by[int(hashlib.md5(f"5-all-{b}-{j // 4}".encode()).hexdigest()[8 * (j % 4) :][:8], 16) % 12] for j in range(12)] for b in range(200)]
    assert set(got) == {(v, m) for v in ("a1", "a2") for m in P.BOOTSTRAP_METRICS}
    for (v, m), x in got.items():
        deltas = [score(v, qs, m) - score("b0", qs, m) for qs in draws]
        assert x["observed_delta"] == pytest.approx(score(v, range(12), m) - score("b0", range(12), m))
        assert (x["ci_low"], x["ci_high"]) == pytest.approx((linear(deltas, 0.025), linear(deltas, 0.975)))
        assert (x["bootstrap_samples"], x["seed"]) == (200, 5)


def test_bootstrap_in_pieces_and_without_some_rows(spark, monkeypatch):
    """A sample that many rows draw together gives what one row gives; a version may lack queries; no pairs, no rows."""
    rng = random.Random(8)
    rows = [(s, v, q, "correct", rng.choice(P.LABELS)) for s in ("all", "primary") for v in ("a1", "a2") for q in range(30) if v == "a1" or q % 3]
    pairs = spark.createDataFrame(rows, "scope string, version string, query_id long, base_label string, label string")
    whole = sorted(map(tuple, P.bootstrap_ci(pairs, 50).collect()))
    monkeypatch.setattr(P, "QUARTERS", 3)
    assert sorted(map(tuple, P.bootstrap_ci(pairs, 50).collect())) == whole and len(whole) == 16
    assert P.bootstrap_ci(pairs.where("false")).count() == 0
    plan = P.bootstrap_ci(pairs, 50)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas") :]
    assert "Exchange" not in below[: below.index("Range")]


def test_empty_scopes_and_labels_raise(spark):
    r = spark.createDataFrame([("b0", 1, "correct", 3)], "version string, query_id long, label string, source_order long")
    assert P.scoped(r).count() == 1
    with pytest.raises(ValueError, match="source_order"):
        P.scoped(r, strict=True)
    with pytest.raises(Exception, match="at least one label"):
        P.label_metrics(r.limit(0), []).collect()
    assert P.unsupported(r, ["version"], ["missing"]).first()["labels"] == ["correct"]


def test_lexical_top_k_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    say = lambda: " ".join(["the", *(rng.choice(words) for _ in range(rng.randint(0, 9)))]) if rng.random() < 0.95 else None
    items, queries = [(i, say()) for i in range(120)], [(i, say()) for i in range(40)]
    sets = lambda t: set((t or "").split())
    want = {}
    for q, t in queries:
        scored = []
        for i, u in items:
            o = len(sets(t) & sets(u))
            if o:
                p, r = o / len(sets(u)), o / len(sets(t))
                scored.append((-(int(2 * p * r / (p + r) * 1e6 + 0.5) / 1e6), i))
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(sorted(scored)[:4])}
    a, b = spark.createDataFrame(items, "item_id long, text string").repartition(4), spark.createDataFrame(queries, "query_id long, text string")
    for size, cells in ((64 << 20, 1 << 22), (200, 64)):
        monkeypatch.setattr(R, "QUERY_BYTES", size)
        monkeypatch.setattr(R, "CELLS", cells)
        got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in R.lexical_top_k(a, b, 4).collect()}
        assert got == want


def test_lexical_search_reads_few_postings(spark, monkeypatch):
    """Far fewer entries than queries times items, in one range or many; a stop word in all texts adds none."""
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{int(rng.paretovariate(0.25))}" for _ in range(n))
    items, queries = [(i, say(rng.randint(3, 60))) for i in range(1500)], [(i, say(12)) for i in range(30)]
    q = {i: set(t.split()) for i, t in queries}

    def entries(extra, most):
        a = spark.createDataFrame([(i, f"{extra} {t}") for i, t in items], "item_id long, text string").coalesce(1)
        asked = R.hashed_tokens(spark.createDataFrame([(i, f"{extra} {t}") for i, t in queries], "query_id long, text string"), "query_id").collect()
        ranges = pa.Table.from_batches(R.lexical_index(a, most).toArrow().to_batches()).combine_chunks().to_batches()[0]
        read, out = [0], {}
        for r in asked:
            best = (np.zeros(0, np.int64), np.zeros(0))
            for i in range(ranges.num_rows):
                best = R.Postings(ranges, i).search(np.array(r["t"], np.int64), best, 5, read)
            out[r["query_id"]] = best[0].tolist()
        return ranges.num_rows, read[0], out

    one, read, found = entries("", 5000)
    assert one == 1 and read < 0.5 * len(items) * len(queries)
    for i, ids in found.items():
        f1 = lambda t: 2 * len(q[i] & set(t.split())) / (len(q[i]) + len(set(t.split())))
        assert ids == [j for _, j in sorted((-round(f1(t), 6), j) for j, t in items)[:5]]
    many, read_many, same = entries("", 100)
    assert many == 15 and same == found and read_many < len(items) * len(queries)
    _, with_stop, _ = entries("the", 5000)
    assert with_stop < 1.2 * read


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        R.with_retries(fail, 3, waits.append)
    assert waits == [1, 2] and len(calls) == 3
    assert R.with_retries(lambda: 5, 1) == 5
    with pytest.raises(ValueError, match="positive"):
        R.with_retries(lambda: 5, 0)


def test_sources_by_mode():
    image, text = lambda v, k: ["image"], lambda v, k: ["text"]
    assert R.unified_search("task2", image, text)("a", 1) == ["text"] and R.unified_search("task2", image, text)(b"x", 1) == ["image"]
    with pytest.raises(RuntimeError, match="not configured"):
        R.unified_search("task1", image, text)("a", 1)
    with pytest.raises(ValueError, match="unknown mode"):
        R.unified_search("x")


def test_fetched_pictures(spark):
    def get(url):
        if url == "gone":
            raise OSError("404")
        return b"\x89PNG\r\n\x1a\n..." if url == "png" else b"<html>"

    got = {r["url"]: (r["content"] is not None, r["error"]) for r in R.fetched(spark.createDataFrame([("png",), ("png",), ("page",), ("gone",), (None,)], "url string"), get, 1).collect()}
    assert got == {"png": (True, None), "page": (False, "not an image"), "gone": (False, "OSError: 404")}


def test_shared_budget_gives_the_web_what_is_left(spark):
    cols = "turn_id int, rank int, evidence_id string, text string, score double"
    kg = spark.createDataFrame([(1, 1, "KG1", "x" * 20, 0.5), (1, 2, "KG2", "y" * 20, 0.5)], cols)
    web = spark.createDataFrame([(1, 1, "WEB1", "z" * 20, 0.5), (2, 1, "WEB1", "z" * 20, 0.5)], cols)
    turns = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "turn_id int, query string")
    got = {r["turn_id"]: (r["kg_lines"].count("\n") + bool(r["kg_lines"]), bool(r["web_lines"])) for r in E.shared_budget(kg, web, turns, 80).collect()}
    assert got == {1: (2, False), 2: (0, True), 3: (0, False)}


def test_leading_names_differ_in_more_than_case(spark):
    items = spark.createDataFrame([(1, 1, "Tower | a: b"), (1, 2, "TOWER | c: d"), (1, 3, " | x"), (1, 4, "Bridge"), (1, 5, "Gate | y")], "turn_id int, rank int, text string")
    assert E.leading_names(items).first()["names"] == ["Tower", "Bridge"]


def test_first_generation_lines(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 0, "[[A|Tower]]", 0, "height", "10"), (1, 1, 0.9, 0, "[[A|Tower]]", 1, "empty", ""), (1, 2, None, 0, "", 0, "k", "v"), (1, 3, 0.1, 0, "late", 0, "k", "v")], "turn_id int, hit_pos int, score double, entity_pos int, entity_name string, attr_pos int, field string, value string")
    assert E.image_lines_v1(hits, 2).first()["evidence"] == "[Image KG 1, score=0.900] Tower; height: 10\n[Image KG 2] k: v"
    web = spark.createDataFrame([(1, 1, 0.5, "T", "", "u"), (1, 2, 0.25, None, "snip", None), (1, 3, 0.25, "T", "more", "u")], "turn_id int, pos int, score double, page_name string, page_snippet string, page_url string")
    assert E.web_lines_v1(web).first()["evidence"] == "[Web 2, score=0.250] Untitled page: snip\n[Web 3, score=0.250] T (u): more"
    assert E.info_lines(web).first()["evidence"] == "[Info 2] snip\n[Info 3] more"


def test_search_query_of_the_first_generation(spark):
    df = spark.createDataFrame([("who is it,", "a tower;", ["one", "", "two", "three", None])], "q string, s string, h array<string>")
    assert df.select(X.search_query_v1(F.col("q"), F.col("s"), F.col("h"))).first()[0] == "who is it a tower two three"


def test_whole_table_of_character_references(spark):
    df = spark.createDataFrame([("&eacute;&#233;&#xe9; &hellip; {{URL|x}}",), (None,)], "t string")
    assert [r[0] for r in df.select(X.clean_markup(F.col("t"), X.unescape_all)).collect()] == ["ééé … x", None]


def test_tokens_and_hashes(spark):
    df = spark.createDataFrame([(" a b  c\td ",), (None,)], "t string")
    assert [tuple(r) for r in df.select(X.count_tokens(F.col("t")), X.truncate_tokens(F.col("t"), 2)).collect()] == [(4, "a b"), (0, "")]
    assert X.canonical_sha256({"b": 1, "a": [2]}) == X.canonical_sha256({"a": [2], "b": 1})
    assert (X.clip_batch(0), X.clip_batch(5), X.clip_batch(99)) == (1, 5, 16)
    got = [r[0] for r in spark.range(40).select(X.seeded_answer(3, F.col("id"))).collect()]
    assert got == [r[0] for r in spark.range(40).select(X.seeded_answer(3, F.col("id"))).collect()] and all(2 <= len(x) <= 16 for x in got) and len(set(got)) > 30


def test_runs_without_artifacts_are_not_valid(spark):
    runs = spark.createDataFrame([("r1", "p", "a", True, "completed", "s"), ("r2", "p", "b", True, "completed", "s")], "run_key string, pair_dir string, side string, pair_valid boolean, status string, thresholds_sha256 string")
    t = spark.createDataFrame([("p", "a", f"q{i}", "ok") for i in range(3)], "pair_dir string, side string, query string, status string")
    got = T.accepted_runs(runs, t, t.drop("status"), "s", 3)
    assert {r["run_key"]: r["valid"] for r in got.collect()} == {"r1": True, "r2": False}
    with pytest.raises(Exception, match="failed validation: r2"):
        T.all_valid(got).collect()


def test_summaries_of_nothing_raise(spark):
    t = spark.createDataFrame([], "gpu int, mem_mib double, util double, temp_c double, power_w double")
    with pytest.raises(Exception, match="no telemetry"):
        T.gpu_summary(t, []).collect()
    assert T.gpu_summary(t).count() == 0


def test_judges_that_fail(spark):
    t = spark.createDataFrame([("q1", "x", "x"), ("q2", "x", "I don't know"), ("q3", "x", "y"), ("boom", "x", "z")], "query string, ground_truth string, agent_response string")

    def judge(q, truth, response):
        if q == "boom":
            raise OSError
        return True

    assert {r["query"]: r["verdict"] for r in S.judged(t, judge).collect()} == {"q1": None, "q2": None, "q3": True, "boom": None}


def test_history_is_checked(spark):
    t = spark.createDataFrame([(1, 0, "q", ""), (1, 1, "q", "a")], "session_id int, turn_idx int, query string, agent_response string")
    with pytest.raises(Exception, match="no response"):
        U.checked_history(U.with_history(t, ["query", "agent_response"])).collect()


def test_contract_scores(spark):
    rows = spark.createDataFrame([("s", "a", "a"), ("s", "b", "a"), ("s", "I don't know", "a"), ("s", "a", "a")], "suite string, prediction string, ground_truth string")
    r = C.contract_scores(rows, ["suite"]).first()
    assert (r["samples"], r["correct"], r["missing"], r["hallucination"], r["truthfulness"]) == (4, 2, 1, 1, 0.25)


def test_empty_csv_and_assets(spark, tmp_path):
    X2.write_csv(spark.createDataFrame([], "a string"), f"file://{tmp_path}/out/empty.csv")
    parts = list((tmp_path / "out" / "empty.csv").glob("part-*"))
    assert [p.read_text() for p in parts] == ["\n"]
    with pytest.raises(ValueError, match="missing asset: no.csv"):
        X2.copy_assets(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/copy", ["empty.csv", "no.csv"])
    assert not (tmp_path / "copy").exists()
    X2.copy_assets(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/copy", ["empty.csv"])
    assert (tmp_path / "copy" / "empty.csv").is_dir()
    X2.atomic_json(str(tmp_path / "x.json"), {"b": 1})
    assert (tmp_path / "x.json").read_text().startswith("{")


def test_review_files_are_checked(spark, tmp_path):
    (tmp_path / "r.csv").write_text("response_id,label\nR1,correct\nR1,missing\n")
    with pytest.raises(ValueError, match="unique"):
        X2.read_review_csv(spark, str(tmp_path / "r.csv"), ["label"])
    with pytest.raises(ValueError, match="lacks"):
        X2.read_review_csv(spark, str(tmp_path / "r.csv"), ["cause"])
    results = spark.createDataFrame([("q", "t", "a")], "query string, ground_truth string, agent_response string")
    review = spark.createDataFrame([("x", "correct", "", "")], "query string, label string, cause string, note string")
    with pytest.raises(Exception, match="no review of: q"):
        X2.reviewed_results(results, review).collect()


def test_tokenizer_sources(tmp_path):
    (tmp_path / "tokenizer.json").write_text("{}")
    at = str(tmp_path / "tokenizer.json")
    assert X2.tokenizer_source({"A": str(tmp_path)}, ["A"], "d") == ("file", at) == X2.tokenizer_source({"B": at}, ["A", "B"], "d")
    assert X2.tokenizer_source({"A": "some/name"}, ["A"], "d") == ("name", "some/name") and X2.tokenizer_source({}, ["A"], "d") == ("name", "d")
