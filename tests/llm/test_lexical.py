import math
import os
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veridix.llm import common, lexical

TERM = re.compile(lexical.PATTERN)
SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string, doc_id long, score string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Every document's score for every item, by the contract's words."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, {t: w.count(t) for t in set(w)}, len(w)) for i, w in held if w]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = {}
    for _, tf, _ in held:
        for t in tf:
            df[t] = df.get(t, 0) + 1
    out = []
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    for item, words in asked.items():
        scored = []
        for doc, tf, n in held:
            m = 100 - 90 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words if t in tf)
            if s > 0 and doc is not None:
                scored.append((-s, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def made(rng):
    words = ["Ta", "ri", "no9", "été", "STRAßE", "x", "the", "of", *[f"w{i}" for i in range(60)]]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, text(rng.randint(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(12)] + [docs[5], (7, None), (8, ""), (9, " ,; "), (None, text(30)), (400, text(20_000))]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(20, None), (21, ""), (22, "unheard"), (3, "no9 w59"), (None, "ta"), (23, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [200, 8 << 20])
def test_search_equals_brute_force(spark, shard_bytes):
    docs, items = made(random.Random(1))
    d = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], "doc_id long, text string, item_id string, score double").repartition(3)
    q = spark.createDataFrame([(i, t, 5, "clash") for i, t in items], ITEMS)
    index = lexical.index_documents(d, shard_bytes)
    got = sorted(tuple(r) for r in lexical.search_index(index, q).collect())
    assert got == brute(docs, items)
    assert (index.count() > 50) == (shard_bytes == 200)


def test_items_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 300)
    docs, items = made(random.Random(2))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in lexical.ranked_search(d, q, 3).collect()) == brute(docs, items, 3)


def test_stops_early():
    """A rare term ranks the top: the frequent term's list is left after the first rounds."""
    n = 5000
    vocabulary = pa.array(["rare", "often"])
    tf = [9 if i % 500 == 0 else 1 for i in range(n)]
    term, count, first = [], [], [0]
    for i in range(n):
        rows = ([0] if i % 400 == 0 else []) + [1]
        term += rows
        count += [tf[i]] * len(rows)
        first.append(len(term))
    one = lambda x, t: pa.array([x], pa.list_(t))
    b = pa.RecordBatch.from_arrays([pa.array([vocabulary.to_pylist()]), one(list(range(n)), pa.int64()), one([20] * n, pa.int32()), one(first, pa.int32()), one(term, pa.int32()), one(count, pa.int32())], names=["vocabulary", "doc_id", "n", "first", "term", "tf"])
    s = lexical.Shard(b, 0, vocabulary, n, 20 * n)
    read = [0]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ids, score = s.search(np.array([0, 1]), np.array([5000, 300]), none, 5, read)
    every = s.scores(np.arange(n), np.array([0, 1]), np.array([5000, 300]))
    order = np.lexsort((np.arange(n), -every))[:5]
    assert ids.tolist() == order.tolist() and score.tolist() == every[order].tolist()
    assert read[0] < 60


def test_empty_tables(spark, no_docs):
    q = spark.createDataFrame([(1, "ta", 5, "x")], ITEMS)
    assert lexical.ranked_search(no_docs, q).count() == 0
    d = spark.createDataFrame([(1, "ta"), (2, "no")], "doc_id long, text string")
    assert lexical.ranked_search(d, q.where("false")).count() == 0
    assert [tuple(r) for r in lexical.ranked_search(d, q).collect()] == brute([(1, "ta"), (2, "no")], [(1, "ta")])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_query_equals_sql(spark):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = c.execute(lexical.ORACLE["op12_lexical"])
    names = [x[0] for x in want.description]
    df = lexical.op12_lexical(spark, SF)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_written_index_is_read_a_few_shards_at_a_time(spark):
    """A reader decodes a whole row group at once: the index's groups must not grow with what a task indexes."""
    d = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    n = common.tables_written()
    lexical.ranked_search(d, spark.createDataFrame([(1, "t5")], "item_id long, text string"))
    files = sorted(Path(common._WRITTEN[n][1].removeprefix("file://")).glob("*.parquet"))
    groups = [m.row_group(i).num_rows for m in map(pq.read_metadata, files) for i in range(m.num_row_groups)]
    assert sum(groups) >= 3000 // common.BATCH_ROWS and max(groups) <= lexical.GROUP_ROWS
