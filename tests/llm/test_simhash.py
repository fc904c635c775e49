import random

import numpy as np
import pyarrow as pa
import xxhash

from veridix.llm import simhash as S
from veridix.llm.graph import connected_components


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_and_components_equal_brute_force(spark, docs, rows):
    known = docs.where("doc_id is not null")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_components(known).collect()}
    fps = {r[0]: slow_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_rows_are_kept(docs, no_docs):
    assert S.simhash_components(docs).count() == docs.count()
    assert S.simhash_components(no_docs).count() == 0


def test_dense_blocks_lose_no_component(spark):
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(120)}
    fps = sorted({int(np.uint64(x).view(np.int64)) for x in fps})
    nodes = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    near = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if i < j and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = components(range(len(fps)), near)
    for dense in (256, 3):
        found = {r["id"]: r["root"] for r in connected_components(S.hamming_links(nodes, 2, dense)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_pivot_rows_bound_the_distance(spark):
    rng = random.Random(3)
    pairs = [(a, a ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 9)))) for a in (rng.getrandbits(63) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    tested = df.select((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).alias("near"), S.within(S.pivot_table(F.col("a")), S.pivot_table(F.col("b")), 2).alias("kept"))
    assert tested.where("near and not kept").count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (900, 901)], "a long, b long").repartition(4)
    got = {r["id"]: r["root"] for r in connected_components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and got[901] == got[900] == 900
    assert connected_components(edges.limit(0)).count() == 0


def test_near_duplicate_groups_equal_brute_force(docs, rows):
    own = {r[0]: r[1] for r in rows if r[0] is not None}
    sets = {i: S.shingle_set(t) for i, t in own.items()}
    want = components(own, [(a, b) for a in own for b in own if a < b and S.jaccard(sets[a], sets[b]) >= 0.8])
    assert {r["doc_id"]: r["component_id"] for r in S.near_duplicate_groups(docs.where("doc_id is not null")).collect()} == want


def test_loose_copies_of_one_text_lose_no_link(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]

    def edited(words, n):
        w = list(words)
        for _ in range(n):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [f"x{rng.randrange(4)}"], [w[i], f"y{rng.randrange(4)}"]])
        return w

    texts = [edited(base, rng.choice([0, 1, 2, 3, 4, 6, 9])) for _ in range(120)]
    tail = [f"tail{i}" for i in range(40)]
    texts += [edited(base, 1) + edited(tail, 1) for _ in range(10)]
    texts += [edited(base[:n], 1) for n in (60, 70, 80, 84, 88, 92, 96, 100, 104, 108, 112) for _ in range(3)]
    texts += [edited(texts[i], 1) for i in range(40)]
    own = {i: " ".join(t) for i, t in enumerate(texts)}
    sets = {i: S.shingle_set(t) for i, t in own.items()}
    alike = [(a, b) for a in own for b in own if a < b and S.jaccard(sets[a], sets[b]) >= 0.8]
    pairs = [(0, b, own[0], own[b]) for b in own if b]
    stars = spark.createDataFrame(pairs, "a long, b long, s string, t string").mapInArrow(S._stars(5, 0.8), S.STAR)
    told = {r["b"]: r["hit"] for r in stars.select("b", "hit").collect()}
    found = {(r["a"], r["b"]) for r in S.star_candidates(stars, 0.8).collect()}
    wanted = {(a, b) for a, b in alike if a and a in told and b in told and not (told[a] and told[b])}
    assert wanted <= found and len(found) < len(told) ** 2 / 6
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicate_groups(df).collect()}
    assert got == components(own, alike)


def joined_rows(df):
    """Rows that the joins of df's plan made."""
    df.collect()
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            rows += p.metrics().apply("numOutputRows").value() if "Join" in name else 0
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_loose_copies_make_rows_in_proportion(spark):
    """Copies of one text share what their centre lost of it; that pairs none of them."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]

    def edited():
        w = list(base)
        for i in rng.sample(range(300), 9):
            w[i] = f"x{rng.randrange(10**6)}"
        return " ".join(w)

    def made(n):
        centre = edited()
        pairs = [(0, b, centre, edited()) for b in range(1, n + 1)]
        stars = spark.createDataFrame(pairs, "a long, b long, s string, t string").mapInArrow(S._stars(5, 0.8), S.STAR)
        return joined_rows(S.star_candidates(stars, 0.8))

    assert made(180) <= 4.5 * made(60)


def test_one_id_with_unlike_texts_loses_no_row(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(1, text("x"), "k"), (1, text("y"), "l"), (1, text("y"), "l"), (2, text("z"), "m"), (3, text("x"), "n"), (None, text("x"), "o"), (4, None, "p"), (5, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lo string")
    got = sorted(((r["doc_id"], (r["text"] or "")[:2], r["lo"]) for r in S.keep_one_of_each_group(df).collect()), key=str)
    assert got == sorted([(1, "x0", "k"), (1, "y0", "l"), (2, "z0", "m"), (4, "", "p"), (None, "x0", "o")], key=str)
    groups = sorted((r["doc_id"], r["component_id"]) for r in S.near_duplicate_groups(df).collect())
    assert groups == [(1, 1), (1, 1), (1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]


def test_shingle_rows_equal_the_sets():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "B", "c"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 30, 400)] + ["a  b\nc\td e f", "A B c D E f"]
    for k in (1, 3, 5):
        h, at = S.shingle_rows(pa.array(texts), k)
        own = [set(h[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
        want = [S.shingle_set(t, k) for t in texts]
        assert [len(x) for x in own] == [len(x) for x in want]
        for i, x in enumerate(own):
            for j, y in enumerate(own):
                assert len(x & y) == len(want[i] & want[j])
