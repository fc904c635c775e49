"""Questions to traces with stub searches and backends."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veridix.operators.answering import IMAGE_HIT, TRACE, WEB_HIT, Settings, answer_turns
from veridix.operators.retrieval import called_search

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
TASK2 = dict(mode="task2", low=0.3, high=0.5, web_threshold=0.1)


def entity(name, **attributes):
    return {"entity_name": name, "entity_attributes": [{"key": k, "value": v} for k, v in attributes.items()]}


def images(value, k):
    if value == "broken":
        raise OSError("no index")
    known = {"tower": [(0.8, entity("Old Tower", architect="Ann Lee", height="120 m"))], "weak": [(0.2, entity("A Shed", owner="Bo"))], "twins": [(0.6, entity("North Hall", opened="1901")), (0.59, entity("South Hall", opened="1902"))]}
    return [{"score": s, "entities": [e]} for s, e in known.get(value, [])][:k]


def web(value, k):
    page = lambda name, snippet, url: {"score": 0.9, "page_name": name, "page_snippet": snippet, "page_url": url}
    if value.startswith("Old Tower who") and k == 5:
        return [page("Lee", "Ann Lee built it.", "u1"), page("Old Tower", "Old Tower", "u2")]
    if value.startswith("North Hall") and k == 5:
        raise OSError("down")
    return [page("Lee", "Ann Lee built it.", "u1")][:k]


def told(backend, log=None):
    """A backend, and a search that writes what it is asked to a file."""

    def search(f, hit):
        def noted(value, k):
            if log is not None:
                with open(log, "a", encoding="utf-8") as out:
                    out.write(f"{value} {k}\n")
            return f(value, k)

        return lambda requests, k, source: called_search(requests, noted, k, hit, source)

    return dict(backend=backend, image_search=search(images, IMAGE_HIT), web_search=search(web, WEB_HIT))


def echo(prompts, images):
    return [p.split("Question: ")[1] + "!" for p in prompts]


def turns(spark, *rows):
    return spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(rows)], "turn_id long, query string, image string")


def rows_of(df):
    assert df.columns == ["turn_id", *TRACE] and len(TRACE) == 28
    got = {r["turn_id"]: r for r in df.collect()}
    assert len(got) == df.count()
    return got


def test_the_gate_sends_turns_to_a_second_search(spark, tmp_path):
    log = tmp_path / "calls"
    t = turns(spark, ("who built it", "tower"), ("who owns it", "weak"), ("when was it opened", "twins"), ("nothing there", "unknown"), (None, "tower"))
    got = rows_of(answer_turns(t, settings=Settings(variant="full", **TASK2), **told(echo, log)))
    a = got[0]
    assert (a["gate_action"], a["search_call_count"], a["additional_search_query"]) == ("expand", 3, "Old Tower who built it")
    assert a["entity_agreement"] > 0.5 > a["entity_agreement_before"] > 0.3  # ranked anew, and not judged again
    assert [x["evidence_id"] for x in a["web_evidence"]] == ["WEB1", "WEB2"] and [x["evidence_id"] for x in a["additional_web_evidence"]] == ["WEB1", "WEB2"]
    assert a["selected_evidence_ids"] == [x["evidence_id"] for x in [*a["image_evidence"], *a["web_evidence"]]]
    assert (a["answer"], a["refusal_reason"], a["status"], a["errors"]) == ("who built it!", None, "ok", [])
    b = got[1]
    assert (b["gate_action"], b["answer"], b["refusal_reason"], b["generation_ms"], b["search_call_count"]) == ("abstain", "I don't know", "insufficient_evidence", 0.0, 2)
    c = got[2]
    assert (c["gate_action"], c["status"], c["errors"]) == ("expand", "search_error", ["web_extra search failed: OSError: down"])
    assert c["answer"] == "when was it opened!" and c["refusal_reason"] is None and c["additional_web_evidence"] == []
    assert [x["entity_name"] for x in c["entity_candidates"]] == ["North Hall", "South Hall"]
    d = got[3]
    assert (d["gate_action"], d["entity_candidates"], d["entity_agreement"], d["image_evidence"]) == ("abstain", [], 0.0, [])
    assert got[4]["query"] == ""
    calls = log.read_text().splitlines()
    assert sorted(calls) == sorted(set(calls)) or calls.count("tower 3") == 2  # two turns show the tower
    assert len(calls) == sum(r["search_call_count"] for r in got.values())


def test_conflicts_and_the_order_of_evidence(spark):
    def pages(value, k):
        return [{"score": 0.9, "page_name": "South Hall", "page_snippet": "South Hall was opened in 1950.", "page_url": "u"}]

    kw = told(echo) | {"web_search": lambda r, k, source: called_search(r, pages, k, WEB_HIT, source)}
    t = turns(spark, ("when was it opened", "twins"))
    full = rows_of(answer_turns(t, settings=Settings(variant="full", **TASK2), **kw))[0]
    assert (full["gate_action"], full["evidence_conflict"], full["refusal_reason"]) == ("abstain", True, "conflicting_evidence")
    first = rows_of(answer_turns(t, settings=Settings(variant="b0", **TASK2), **kw))[0]
    ranked = rows_of(answer_turns(t, settings=Settings(variant="a1", **TASK2), **kw))[0]
    assert [x["text"].split(" |")[0] for x in first["image_evidence"]] == ["North Hall", "South Hall"]
    assert [x["text"].split(" |")[0] for x in ranked["image_evidence"]] == ["South Hall", "North Hall"]  # the web supports it
    assert first["gate_action"] == ranked["gate_action"] == "answer"


def test_modes_without_a_gate(spark):
    t = turns(spark, ("what is it", "tower"), ("and this", "broken"))
    v = rows_of(answer_turns(t, settings=Settings(mode="vision"), **told(echo)))
    assert {(r["search_call_count"], r["answer"], r["image_search_ms"], r["gate_action"]) for r in v.values()} == {(0, "what is it!", 0.0, "answer"), (0, "and this!", 0.0, "answer")}
    one = rows_of(answer_turns(t, settings=Settings(mode="task1"), **told(lambda p, i: ["I do not know" for _ in p])))
    assert [one[i]["refusal_reason"] for i in (0, 1)] == ["insufficient_evidence", "search_error"]
    assert one[1]["errors"] == ["image search failed: OSError: no index"] and one[1]["status"] == "search_error" and one[0]["web_evidence"] == []
    bare = rows_of(answer_turns(turns(spark, ("what", "unknown")), settings=Settings(mode="task1"), **told(lambda p, i: [None for _ in p])))
    assert (bare[0]["answer"], bare[0]["refusal_reason"]) == ("I don't know", "no_retrieval")
    off = rows_of(answer_turns(t, echo, settings=Settings(mode="task1")))
    assert off[0]["errors"] == ["image search failed: RuntimeError: search pipeline is not configured"]


def test_backends_that_fail(spark):
    def fails(prompts, images):
        if any("second" in p for p in prompts):
            raise ValueError("too long")
        return ["a b c d" for _ in prompts]

    t = turns(spark, ("first", "tower"), ("second", "tower")).coalesce(1)
    got = rows_of(answer_turns(t, settings=Settings(batch=1, max_tokens=3), **told(fails)))
    assert (got[0]["answer"], got[0]["answer_token_count"], got[0]["status"]) == ("a b c", 3, "ok") and got[0]["generation_ms"] > 0
    assert (got[1]["answer"], got[1]["status"], got[1]["refusal_reason"], got[1]["errors"]) == ("I don't know", "generation_error", "generation_error", ["generation failed: ValueError: too long"])
    with pytest.raises(Exception, match="returned 0 answers"):
        answer_turns(t, settings=Settings(), **told(lambda p, i: []))
    with pytest.raises(ValueError, match="unknown mode"):
        Settings(mode="task3")
    with pytest.raises(ValueError, match="thresholds"):
        Settings(low=0.7)


def test_no_turns_and_turns_without_an_id(spark):
    none = turns(spark, ("x", "tower")).where("false")
    assert rows_of(answer_turns(none, settings=Settings(variant="full", **TASK2), **told(echo))) == {}
    t = turns(spark, ("x", "tower")).select(F.lit(None).cast("long").alias("turn_id"), "query", "image")
    assert rows_of(answer_turns(t, settings=Settings(), **told(echo))) == {}
