"""The cache, the committed sink, paged collections and file hashes."""

import hashlib
import json
import os
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veridix.operators.retrieval import is_image
from veridix.functions.text import cache_key_md5
from veridix.sources import paged, sinks
from veridix.sources.cache import ContentCache, file_hashes, pinned

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def urls(spark, *names):
    return spark.createDataFrame([(n, "x") for n in names], "url string, key string").repartition(3)


def logged(log, answer):
    """A get that writes what it is asked for to a file."""

    def get(url):
        with open(log, "a", encoding="utf-8") as f:
            f.write(f"{url} {os.getpid()}\n")
        return answer(url)

    return get


def asked(log):
    return [x.split()[0] for x in open(log, encoding="utf-8")] if os.path.exists(log) else []


def test_a_second_fetch_asks_for_nothing(spark, tmp_path):
    log = tmp_path / "calls"
    cache = ContentCache(spark, str(tmp_path / "cache"))
    names = [f"http://h{i % 3}.org/p{i}" for i in range(30)]
    first = {r["url"]: r for r in cache.fetch(urls(spark, *names, *names[:9], None), logged(log, lambda u: u.upper().encode())).collect()}
    assert sorted(asked(log)) == sorted(names)
    assert {u: (bytes(r["content"]), r["error"], r["cached"]) for u, r in first.items()} == {u: (u.upper().encode(), None, False) for u in names}
    assert first[names[0]]["key"] == hashlib.sha256(names[0].encode()).hexdigest() + ".jpg"
    second = cache.fetch(urls(spark, *names), logged(log, lambda u: b"other")).collect()
    assert len(asked(log)) == 30 and all(r["cached"] and bytes(r["content"]) == r["url"].upper().encode() for r in second)
    more = {r["url"]: r["cached"] for r in cache.fetch(urls(spark, names[0], "http://new.org/"), logged(log, lambda u: b"n")).collect()}
    assert more == {names[0]: True, "http://new.org/": False} and asked(log)[30:] == ["http://new.org/"]


def test_errors_and_bad_content_are_asked_for_again(spark, tmp_path):
    log = tmp_path / "calls"
    cache = ContentCache(spark, str(tmp_path / "cache"), cache_key_md5, is_image)
    jpeg = b"\xff\xd8\xff picture"

    def poor(url):
        if url.endswith("gone.png"):
            raise OSError("gone")
        return b"<html>" if url.endswith("page") else jpeg

    names = ["http://a/gone.png", "http://a/page", "http://a/x.png"]
    got = {r["url"]: (r["error"], r["content"] is not None) for r in cache.fetch(urls(spark, *names), logged(log, poor), attempts=2, sleep=lambda s: None).collect()}
    assert got == {names[0]: ("OSError: gone", False), names[1]: ("the content fails the check", False), names[2]: (None, True)}
    assert sorted(asked(log)) == sorted([names[0], *names])
    again = cache.fetch(urls(spark, *names), logged(log, lambda u: jpeg)).collect()
    assert all(r["error"] is None and bytes(r["content"]) == jpeg for r in again) and sorted(asked(log)[4:]) == sorted(names[:2])
    assert cache.held(urls(spark, *names)).where("key = md5('http://a/x.png') || '.png'").count() == 1


def test_a_run_that_breaks_leaves_no_entry(spark, tmp_path):
    at = tmp_path / "cache"
    cache = ContentCache(spark, str(at))

    def stop(url):
        if url.endswith("7"):
            os._exit(1)  # the worker dies
        return b"x"

    with pytest.raises(Exception, match=".*"):
        cache.fetch(urls(spark, *[f"http://h/{i}" for i in range(20)]), stop)
    assert cache.batches() == [] and cache.entries().count() == 0 and not any((at / "_writing").iterdir())
    assert cache.fetch(urls(spark, "http://h/1"), lambda u: b"ok").first()["cached"] is False
    assert len(cache.batches()) == 1
    # bytes that are not those that were stored count as missing
    stored = spark.read.parquet(f"{at}/entries").drop("batch").withColumn("content", F.lit(b"rot").cast("binary"))
    stored.write.parquet(f"{at}/entries/batch=000000000005-x")
    seen = cache.held(urls(spark, "http://h/1")).first()
    assert bytes(seen["content"]) == b"ok"


def test_a_host_is_asked_by_few_tasks(spark, tmp_path):
    cache = ContentCache(spark, str(tmp_path / "cache"))
    got = cache.fetch(urls(spark, *[f"http://one.org/{i}" for i in range(60)]), lambda u: str(__import__("pyspark").TaskContext.get().partitionId()).encode(), tasks_a_host=2)
    assert 1 <= got.select("content").distinct().count() <= 2
    with pytest.raises(ValueError, match="at least one task"):
        cache.fetch(urls(spark, "u"), lambda u: b"", tasks_a_host=0)


SCHEMA = "trace_id string, n bigint, note string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, len(i), None if i == "b" else "é\n") for i in ids], SCHEMA).repartition(2)


def test_a_batch_is_there_once(spark, tmp_path):
    at = str(tmp_path / "trace")
    assert sinks.read_committed(spark, at, SCHEMA).count() == 0
    for batch, ids in (("0", ["a", "b"]), ("1", ["ccc"]), ("0", ["a", "b"]), ("2", [])):
        sinks.append_once(rows(spark, *ids), at, batch)
    got = sorted(tuple(r) for r in sinks.read_committed(spark, f"file://{at}", SCHEMA).collect())
    assert got == [("a", 1, "é\n"), ("b", 1, None), ("ccc", 3, "é\n")]
    named = {f for m in (tmp_path / "trace/commits").iterdir() for f in json.loads(m.read_text())["files"]}
    assert named == {f.name for f in (tmp_path / "trace/data").iterdir()}  # the second attempt's files are gone
    with pytest.raises(Exception, match="letters"):
        sinks.append_once(rows(spark, "a"), at, "a/b")


def test_a_task_that_fails_once_adds_nothing(tmp_path):
    at = str(tmp_path / "trace")
    batch = pa.RecordBatch.from_pydict({"trace_id": ["a", "b"], "n": [1, 2]})
    writer = sinks.CommittedJson({"path": at, "batch_id": "7"}).writer(None, False)

    def breaks():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(breaks())
    kept = [writer.write(iter([batch])), writer.write(iter([]))]
    writer.commit([*kept, None])
    late = writer.write(iter([batch]))  # the same batch once more
    writer.commit([late])
    (said,) = [json.loads(x.read_text()) for x in (tmp_path / "trace/commits").iterdir()]
    assert said == {"batch_id": "7", "files": [k.file for k in kept], "rows": 2}
    assert not (tmp_path / "trace/data" / late.file).exists()


def test_a_write_that_fails_is_aborted(spark, tmp_path):
    at = str(tmp_path / "trace")
    bad = rows(spark, "a", "b").withColumn("n", F.when(F.col("trace_id") == "b", F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        sinks.append_once(bad, at, "0")
    assert sinks.read_committed(spark, at, SCHEMA).count() == 0
    sinks.append_once(rows(spark, "a"), at, "0")
    assert sinks.read_committed(spark, at, SCHEMA).count() == 1


def test_streams_append_once(spark, tmp_path):
    rows(spark, "a", "b").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has lost its checkpoint and writes batch 0 again
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(lambda df, i: sinks.append_once(df, str(tmp_path / "out"), str(i))).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sinks.read_committed(spark, str(tmp_path / "out"), SCHEMA).count() == 2


def test_json_documents_are_replaced_whole(spark, tmp_path):
    for payload in ({"b": 1, "a": "é"}, [2]):
        sinks.commit_json(spark, str(tmp_path / "x.json"), payload)
        assert json.loads((tmp_path / "x.json").read_text()) == payload
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".json" or "tmp" in p.name and not p.name.startswith(".")] == ["x.json"]


def test_pages_are_asked_for_in_turn(spark, tmp_path):
    log = tmp_path / "calls"
    held = [(i, f"page {i}") for i in range(5)]

    def page(limit, offset):
        with open(log, "a", encoding="utf-8") as f:
            f.write(f"{limit} {offset}\n")
        return held[offset : offset + limit]

    df = paged.read_paged(spark, lambda: 5, page, "id int, name string", 2)
    assert not log.exists()
    assert sorted(map(tuple, df.collect())) == held
    assert sorted(log.read_text().splitlines()) == ["1 4", "2 0", "2 2"]
    assert [(s.first, s.last) for s in paged.page_spans(1000, 10, 3)] == [(0, 340), (340, 680), (680, 1000)]
    assert paged.read_paged(spark, lambda: 0, page, "id int, name string", 2).count() == 0
    with pytest.raises(Exception, match="from 4 on has 1"):
        paged.read_paged(spark, lambda: 6, page, "id int, name string", 2).collect()
    with pytest.raises(ValueError, match="at least one row"):
        paged.read_paged(spark, lambda: 5, page, "id int", 0)


def test_ids_are_looked_up_once(spark, tmp_path):
    log = tmp_path / "calls"

    def lookup(ids):
        with open(log, "a", encoding="utf-8") as f:
            f.write(" ".join(map(str, sorted(ids))) + "\n")
        return {i: f"v{i}" for i in ids if i != 3}

    ids = spark.createDataFrame([(i,) for i in [1, 2, 3, 1, 2, None]], "id int")
    got = sorted(map(tuple, paged.looked_up(ids, lookup, size=2).collect()))
    assert got == [(1, "v1"), (2, "v2"), (3, None)]
    assert sorted(" ".join(log.read_text().split("\n")).split()) == ["1", "2", "3"] and all(len(x.split()) <= 2 for x in log.read_text().splitlines())


def test_files_are_pinned_by_their_hash(spark, tmp_path):
    for name, body in (("a.txt", b"x" * 1000), ("deep/b.txt", b"b"), ("empty.txt", b""), ("c.bin", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["name"]: (r["length"], r["sha256"], r["tree_sha256"]) for r in file_hashes(spark, str(tmp_path), "*.txt", 300).collect()}
    tree = sha("\n".join(sha(b"x" * n) for n in (300, 300, 300, 100)).encode())
    assert got == {"a.txt": (1000, sha(b"x" * 1000), tree), "deep/b.txt": (1, sha(b"b"), sha(sha(b"b").encode()))}
    manifest = spark.createDataFrame([(n, v[1]) for n, v in got.items()], "name string, sha256 string")
    assert pinned(file_hashes(spark, str(tmp_path), "*.txt"), manifest).count() == 2
    (tmp_path / "a.txt").write_bytes(b"x" * 999 + b"y")
    with pytest.raises(Exception, match="a.txt has changed"):
        pinned(file_hashes(spark, str(tmp_path), "*.txt"), manifest).collect()
    (tmp_path / "a.txt").unlink()
    with pytest.raises(Exception, match="a.txt is missing"):
        pinned(file_hashes(spark, str(tmp_path), "*.txt"), manifest).collect()
