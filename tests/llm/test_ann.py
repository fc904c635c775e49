import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridix.llm import ann

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows, queries, k):
    """Every pair's cosine; an id's vectors are one query and one candidate."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    length = {}
    for _, v in ok:
        length[len(v)] = length.get(len(v), 0) + 1
    dim = max(length, key=lambda d: (length[d], d), default=0)
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    for q in {i for i, _ in ok if i in queries}:
        best = {}
        for a in (v for i, v in ok if i == q):
            for i, v in ok:
                if i != q:
                    s = float(ann.cosines(a[None], v[None])[0])
                    best[i] = max(best.get(i, -2.0), s)
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {q: [(i, -s) for s, i in r] for q, r in out.items()}


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for rows in got.values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:]))
    return {q: [(i, s) for _, i, s in rows] for q, rows in got.items()}


def test_small_table_is_exact(spark):
    """Ties, copies, repeated rows, opposite and parallel vectors, an id with two vectors, and rows that take no part."""
    rng = np.random.default_rng(1)
    f = lambda v: [float(x) for x in np.float32(v)]
    rows = [(i, f(rng.normal(size=8))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(9)] + [rows[3], rows[3], (3, rows[9][1]), (200, f([-x for x in rows[4][1]])), (201, f([2 * x for x in rows[4][1]]))]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [None] + [1.0] * 7), (304, [float("nan")] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7), (None, f(rng.normal(size=8))), (306, f(rng.normal(size=5)))]
    t = spark.createDataFrame([(i, v, 1, 7, "clash") for i, v in rows], SCHEMA).repartition(3)
    ids = [0, 3, 4, 105, 200, 300, 302, 306]
    got = answers(ann.nearest(t, t.where(F.col("vec_id").isin(ids)), 5))
    want = brute(rows, set(ids), 5)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    for q, r in got.items():
        assert [s for _, s in r] == pytest.approx([s for _, s in want[q]], abs=1e-15)


def test_fewer_candidates_than_asked(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0], 0, 0, ""), (2, [0.0, 1.0], 0, 0, ""), (3, [1.0, 1.0], 0, 0, "")], SCHEMA)
    assert answers(ann.nearest(t, t)) == {1: [(3, pytest.approx(math.sqrt(0.5))), (2, 0.0)], 2: [(3, pytest.approx(math.sqrt(0.5))), (1, 0.0)], 3: [(1, pytest.approx(math.sqrt(0.5))), (2, pytest.approx(math.sqrt(0.5)))]}
    assert answers(ann.nearest(t.where("vec_id = 1"), t.where("vec_id = 1"))) == {}
    assert answers(ann.nearest(t, t.where("false"))) == {}
    assert ann.nearest(t.where("false"), t).count() == 0
    with pytest.raises(ValueError, match="too few ids"):
        ann.search_index(ann.build_index(t, 2), t, 2)


def test_many_shards_recall(spark):
    """Unrelated vectors, a tight group of a third of them and copies; cells are split, and cells out of reach are left."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(1, 24))
    x = np.concatenate([rng.normal(size=(1500, 24)), centre + 0.01 * rng.normal(size=(1000, 24)), np.repeat(rng.normal(size=(1, 24)), 60, 0), rng.normal(size=(40, 24)).repeat(10, 0) + 0.02 * rng.normal(size=(400, 24))]).astype(np.float32)
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    t = spark.createDataFrame([(i, v, 1, 1, "") for i, v in rows], SCHEMA)
    index = ann.build_index(t, 6, shard_rows=200)
    assert index.parts.max() > 1 and index.table.count() == index.parts.sum()
    assert index.table.agg(F.sum("n")).first()[0] == len({tuple(v) for _, v in rows})
    q = t.where("vec_id % 20 = 0")
    got = answers(ann.search_index(index, q))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 5)
    assert set(got) == set(want) and all(len(r) == 5 for r in got.values())
    found = np.mean([len({i for i, _ in got[k]} & {i for i, _ in want[k]}) / 5 for k in want])
    assert found >= 0.97
    exact = {k: dict(r) for k, r in want.items()}
    assert all(s == pytest.approx(exact[k][i], abs=1e-14) for k, r in got.items() for i, s in r if i in exact[k])


def test_every_node_is_reached():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(700, 12)), rng.normal(size=(7, 12)).repeat(90, 0) + 1e-4 * rng.normal(size=(630, 12)), rng.normal(size=(2, 12))):
        graph = ann.build(ann.unit(x))
        seen, front = {0}, [0]
        while front:
            front = [int(j) for i in front for j in graph[0][i] if j >= 0 and not (j in seen or seen.add(int(j)))]
        assert len(seen) == len(x)
        assert all(len(g) == len(x) // ann.LINKS**k for k, g in enumerate(graph))
        assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for g in graph for r in g)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in ann.read_table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    got = answers(ann.op13_neighbours(spark, SF))
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[k]} & {i for i, _ in want[k]}) / 5 for k in want]) >= 0.95
