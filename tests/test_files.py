import json
import random
import time

import pytest

from veridix.operators.scoring import early_stop
from veridix.sources import files as S
from veridix.streaming.live import early_stop_ordered, early_stop_stream, gpu_windows, read_trace_stream, session_activity


def test_telemetry_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("2026/07/16 10:00:00.500, 1, A800, 40, 100.5 W, 200 MiB, 400 MiB, 80 %\nshort, line\n")
    r = S.read_telemetry_csv(spark, str(tmp_path / "t.csv")).collect()
    assert len(r) == 1 and (r[0]["gpu"], r[0]["mem_mib"], r[0]["util"]) == (1, 200.0, 80.0)


def test_traces(spark, tmp_path):
    assert S.read_traces(spark, str(tmp_path)).count() == 0
    (tmp_path / "agent_trace_v3.jsonl").write_text('{"query": "q", "total_ms": 1.5}\n\n{"query": "r"}\n')
    assert [r["query"] for r in S.read_traces(spark, str(tmp_path)).orderBy("query").collect()] == ["q", "r"]


def test_run_csv_is_validated(spark, tmp_path):
    (tmp_path / "r.csv").write_text("query,ground_truth\na,1\na,2\n")
    with pytest.raises(ValueError, match="unique"):
        S.read_run_csv(spark, str(tmp_path / "r.csv"), ["query"])
    with pytest.raises(ValueError, match="lacks"):
        S.read_run_csv(spark, str(tmp_path / "r.csv"), ["agent_response"])


def test_manifest(spark, tmp_path):
    at = tmp_path / "m.json"
    at.write_text(json.dumps([{"source_index": 4}, {"source_index": 2}]))
    assert [(r["pos"], r["row_id"]) for r in S.read_manifest(spark, str(at)).orderBy("pos").collect()] == [(0, 4), (1, 2)]
    at.write_text(json.dumps([{"source_index": 4}, {"source_index": 4}]))
    with pytest.raises(ValueError, match="unique"):
        S.read_manifest(spark, str(at))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, True)], "session_id long, turn_idx int, is_correct boolean")
    rows.write.parquet(str(tmp_path / "in"))
    q = early_stop_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["session_id"], r["turn_idx"]): r["stopped"] for r in spark.sql("select * from stops").collect()} == {(1, 0): False, (1, 1): False, (1, 2): True, (2, 0): False}
    t = spark.sql("select timestamp'2026-01-01 00:00:10' ts, 1 gpu, 50.0D util, 10.0D mem_mib")
    assert gpu_windows(t).first()["n"] == 1


@pytest.fixture()
def rocksdb(spark):
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in settings.items():  # without batches of no data a run ends; timers wait for the next file then
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def fed(spark, tmp_path, keep_ms, batches, pause=0.0):
    """The rows that a query over files gives, a file a run, and how many rows its state holds in the end."""
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("session_id long, turn_idx int, is_correct boolean").json(str(tmp_path / "in"))
    out, held = [], 0
    for n, rows in enumerate(batches):
        (tmp_path / f"{n}.json").write_text("".join(json.dumps(dict(zip(("session_id", "turn_idx", "is_correct"), r, strict=True))) + "\n" for r in rows))
        (tmp_path / f"{n}.json").rename(tmp_path / "in" / f"{n}.json")
        q = early_stop_ordered(source, keep_ms).writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(60)
            held = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
        finally:
            q.stop()
        time.sleep(pause)
    return {(r["session_id"], r["turn_idx"]): r["stopped"] for r in out}, held


def test_early_stop_takes_turns_in_any_order(spark, tmp_path, rocksdb):
    rng = random.Random(3)
    rows = [(s, i, rng.random() < 0.5) for s in range(12) for i in range(rng.randint(1, 6))]
    batch = spark.createDataFrame([(*r, False, False) for r in rows], "session_id long, turn_idx int, is_correct boolean, is_exact_match boolean, is_miss boolean")
    want = {(r["session_id"], r["turn_idx"]): r["stopped"] for r in early_stop(batch).collect()}
    rng.shuffle(rows)
    got, held = fed(spark, tmp_path, 3_600_000, [rows[:15], rows[15:20] + rows[:4], rows[20:]])
    assert got == want and any(want.values()) and held > 0


def test_early_stop_forgets_sessions(spark, tmp_path, rocksdb):
    """What waits is judged when the time is over, and the session's state is gone; another's is there."""
    one, two = [(1, 0, False), (1, 2, False), (1, 3, True)], [(2, 0, True)]
    got, before = fed(spark, tmp_path, 1000, [one])
    assert got == {(1, 0): False} and before > 0
    (tmp_path / "x").mkdir()
    got, held = fed(spark, tmp_path / "x", 1000, [one, two], pause=3)
    assert got == {(1, 0): False, (1, 2): False, (1, 3): True, (2, 0): False} and held < before


def test_traces_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"trace_id": "1", "gate_action": "answer"}\n{"trace_id": "2", "gate_action": "abstain"}\n')
    q = read_trace_stream(spark, str(tmp_path / "in")).groupBy("gate_action").count().writeStream.format("memory").queryName("actions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.jsonl").write_text('{"trace_id": "3", "gate_action": "answer"}\n')
    q.processAllAvailable()
    q.stop()
    assert {r["gate_action"]: r["count"] for r in spark.sql("select * from actions").collect()} == {"answer": 2, "abstain": 1}


def test_sessions_end_after_a_gap(spark):
    e = spark.sql("select timestamp(concat('2026-01-01 00:', m, ':00')) ts, s session_id from values ('00', 1), ('05', 1), ('30', 1), ('01', 2) t(m, s)")
    got = session_activity(e).collect()
    assert sorted((r["session_id"], r["n"]) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_split_falls_back_to_the_first(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(5).write.parquet(str(tmp_path / "b"))
    assert [S.read_parquet(spark, str(tmp_path), x).count() for x in ("b", "z")] == [5, 3]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no splits"):
        S.read_parquet(spark, str(tmp_path / "none"), "x")


def test_page_content_where_pages_share_an_address(spark):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two"), (3, "v", "three")], "page_id long, url string, html string")
    hits = spark.createDataFrame([(7, 2, "u"), (8, 1, "u"), (9, 4, "w")], "turn_id int, page_id long, page_url string")
    by_id = S.with_page_content(hits, pages, "page_id", "page_id").orderBy("turn_id").collect()
    assert [(r["turn_id"], r["page_id"], r["page_content"]) for r in by_id] == [(7, 2, "two"), (8, 1, "one"), (9, 4, None)]
    assert [r["page_content"] for r in S.with_page_content(hits, pages).orderBy("turn_id").collect()] == ["one", "one", None]
