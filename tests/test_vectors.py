import tracemalloc

import numpy as np
import pytest

from veridix.operators import retrieval as R
from veridix.operators import vectors as V
from veridix.operators.retrieval import cosine_top_k


def frames(spark, items, queries):
    t = lambda rows, key: spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, embedding array<double>").repartition(3)
    return t(items, "item_id"), t(queries, "query_id")


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in df.collect())


def test_cells_give_the_full_scan(spark, monkeypatch):
    """Groups, unrelated vectors, copies and rows without a vector; blocks of few items, queries in several blocks."""
    monkeypatch.setattr(V, "TOGETHER", 7)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([np.repeat(centres, 60, 0) + 0.1 * rng.normal(size=(720, 16)), rng.normal(size=(150, 16)), np.repeat(centres[:1], 40, 0)])
    items = [(int(i), v) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    items += [(9001, None), (9002, [0.0] * 16), (None, x[0]), (9003, [float("nan")] * 16)]
    queries = [(i, x[i * 13]) for i in range(60)] + [(500, rng.normal(size=16)), (501, None)]
    a, q = frames(spark, items, queries)
    index = V.vector_index(a, 50)
    assert index.items.sum() == len(x) and index.blocks.max() > 1 and index.table.count() == index.blocks.sum()
    clean = a.where("embedding is not null and item_id is not null and not isnan(embedding[0])")
    assert ranked(V.cosine_search(index, q, 4)) == ranked(cosine_top_k(clean, q, 4))
    assert V.share_skipped(index, q, 4) > 0.6


def test_few_items_and_none(spark):
    a, q = frames(spark, [(1, [1, 0]), (2, [0, 1]), (3, [1, 0])], [(7, [2, 0])])
    index = V.vector_index(a)
    assert ranked(V.cosine_search(index, q, 5)) == [(7, 1, 1, 1.0), (7, 2, 3, 1.0), (7, 3, 2, 0.0)]
    assert V.cosine_search(index, q.where("false"), 5).count() == 0
    assert V.vector_index(a.where("false")) is None
    with pytest.raises(ValueError, match="differ in length"):
        V.vector_index(frames(spark, [(1, [1, 0]), (2, [0, 1, 2])], [])[0])


def test_nearest_holds_few_scores_at_once(monkeypatch):
    """Blocks of any size give what one sort of all scores gives, ties to the smaller item, in memory that doesn't grow with
    the queries and items that meet."""
    rng = np.random.default_rng(3)
    q, x = rng.integers(-2, 3, (700, 4)).astype(float), rng.integers(-2, 3, (900, 4)).astype(float)
    q, x = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30) for v in (q, x))
    items = rng.permutation(5000)[: len(x)]
    want = [[(int(items[j]), s[j]) for j in np.lexsort((items, -s))[:3]] for s in np.round(q @ x.T, 6)]
    for cells, meeting in ((1 << 20, 512), (1000, 70)):
        monkeypatch.setattr(R, "CELLS", cells)
        monkeypatch.setattr(R, "MEETING", meeting)
        near = R.Nearest(np.arange(len(q)), q, 3)
        for lo in range(0, len(x), 250):
            near.meet(items[lo : lo + 250], x[lo : lo + 250])
        got = {}
        for b in near.found():
            for r in b.to_pylist():
                got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
        assert [got[i] for i in range(len(q))] == want
    near = R.Nearest(np.arange(4096), rng.normal(size=(4096, 8)), 5)
    monkeypatch.setattr(R, "CELLS", 1 << 20)
    tracemalloc.start()
    near.meet(np.arange(10_000), rng.normal(size=(10_000, 8)))
    assert tracemalloc.get_traced_memory()[1] < 150 << 20  # all pairs' scores alone are 330 MB
    tracemalloc.stop()
