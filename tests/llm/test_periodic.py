import hashlib
import random
import re
import zlib

import numpy as np

from veridix.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6):
    """Every maximal stretch with every period, by comparing words."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            part = words[i : i + size]
            if size >= max(least, 4 * q) and not any(part[r:] == part[: size - r] for r in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    """The query's row by the contract's words, in plain Python."""
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def loopy(rng):
    """A document of few words with loops, some within others."""
    k = rng.randint(1, 4)
    w = [rng.randrange(k) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        if len(w) > 8:
            a, p = rng.randrange(len(w)), rng.randint(1, 8)
            for i in range(a + p, min(len(w), a + rng.randint(4, 60))):
                w[i] = w[i - p]
    if rng.random() < 0.4:
        inner = [rng.randrange(k) for _ in range(rng.randint(1, 4))] * rng.randint(1, 6) + [9]
        w += inner * rng.randint(1, 6) + w[: rng.randint(0, 9)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = [loopy(rng) for _ in range(rng.randint(1, 6))]
        bounds = np.cumsum([0] + [len(d) for d in docs])
        s, k, q = periodic.periodic_runs(np.array([w for d in docs for w in d], np.int64) * 7919, bounds)
        own = np.searchsorted(bounds, s, side="right") - 1
        for i, d in enumerate(docs):
            assert [(a - bounds[i], b, c) for a, b, c, o in zip(s, k, q, own, strict=True) if o == i] == brute(d)


def test_blocks_are_the_longest_earlier_strings():
    rng = random.Random(2)
    for _ in range(60):
        w = loopy(rng)
        if len(w) < 2:
            continue
        want, i = [], 0
        while i < len(w):
            want.append(i)
            i += max([1] + [k for k in range(1, len(w) - i + 1) if any(w[j : j + k] == w[i : i + k] for j in range(i))])
        sa, levels = periodic.suffix_names(np.array(w))
        assert sa.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        assert periodic.blocks(sa, levels).tolist() == want


def test_query_rows(spark, docs, rows):
    extra = [(1000 + i, " ".join(f"w{x}" for x in loopy(random.Random(i))), None, None, None, None, None, None) for i in range(60)]
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = sorted((tuple(r) for r in periodic.run_digests(table, periodic.looped).collect()), key=str)
    assert got == sorted((contract(r[0], r[1]) for r in [*rows, *extra]), key=str)
    assert sum(r[1] for r in got) > 30


def test_general_form_and_empty_tables(spark, no_docs):
    t = spark.createDataFrame([(1, "so a b a b\ta b a b end"), (1, "x " * 5), (None, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(t).collect()}
    assert got == {(1, 10): ([(1, 8, 2)], "so a b end"), (1, 5): ([], "x x x x x"), (None, 0): ([], "")}
    assert periodic.find_runs(t, least=4).where("n_words = 5").first()["runs"] == [(0, 5, 1)]
    assert periodic.find_runs(no_docs).count() == 0 and periodic.run_digests(no_docs, periodic.looped).count() == 0


def test_a_long_loop():
    """A text of 60,000 words that goes round every 7,001."""
    words = np.random.default_rng(3).integers(0, 500, 60_000)
    words[5_000:] = words[5_000 + np.arange(55_000) % 7_001]
    s, k, q = periodic.periodic_runs(words, np.array([0, 60_000]))
    long = q > 100
    assert (s[long].tolist(), k[long].tolist(), q[long].tolist()) == ([5_000], [55_000], [7_001]) or (s[long][0] < 5_000 and q[long].tolist() == [7_001])
