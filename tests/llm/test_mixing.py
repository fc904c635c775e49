import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from veridix.llm import mixing as M


def summed(*states):
    rows = [r for s in states for r in s.rows()]
    keys = sorted({r[:2] for r in rows})
    return [(*k, M._sum_rows(True)((*k, 0), pd.DataFrame({"v": [v for *x, v in rows if tuple(x) == k]}))["v"].iloc[0]) for k in keys]


def test_counts_and_base_equal_brute_force(docs, rows, no_docs):
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), None]
    out = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 5 == 1
    count = Counter(w for r in rows if not out(r[0]) for w in split(r[1]))
    n, v = sum(count.values()), len(count)
    want = {r[0]: (out(r[0]), len(split(r[1])), sum(count[w] > 0 for w in split(r[1])), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(r[1]))) for r in rows}
    for vocabulary in (1 << 17, 7):
        got = M.score_documents(docs, vocabulary).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (*w[:3], n)
            assert math.isclose(r["base_score"], w[3], rel_tol=1e-9, abs_tol=1e-6)
            assert r["score"] <= 1e-9
    assert M.score_documents(no_docs).count() == 0


def test_token_probabilities_add_up():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 30, 4000).astype(np.uint64)
    count = Counter(h.tolist())
    code = M.Code.build(sorted(count.items(), key=lambda x: -x[1])[:20], 5)
    state = M.Learner(code, 20)
    row = np.repeat(np.arange(40), 100)
    for _ in range(3):
        state.learn(h, row)
    model = M.Model.build(code, 20, summed(state))
    every = np.array([int(x) for x in code.hashes] + [999], np.uint64)  # the last one stands for all others
    for prefix in (h[:1], h[:7]):
        total = 0.0
        for x in every:
            t = np.append(prefix, x)
            total += 10 ** model.token_scores(t, np.zeros(len(t), int), code.symbols(t))[-1]
        assert math.isclose(total, 1, rel_tol=1e-5)


def test_context_helps():
    h = np.tile(np.arange(1, 9, dtype=np.uint64), 500)
    code = M.Code.build([(i, 500) for i in range(1, 9)], 1)
    state = M.Learner(code, 20)
    for i in range(0, 4000, 400):
        state.learn(h[i : i + 400], np.zeros(400, int))
    model = M.Model.build(code, 20, summed(state))
    assert model.token_scores(h[:400], np.zeros(400, int), code.symbols(h[:400])).mean() > math.log10(1 / 8) / 3


def test_every_decision_corrects_the_weights_and_the_map(monkeypatch):
    monkeypatch.setattr(M, "STEP", 1000)
    h = np.random.default_rng(1).integers(1, 30, 3000).astype(np.uint64)
    code = M.Code.build([(i, 100 + i) for i in range(1, 25)], 5)
    state = M.Learner(code, 20)
    row = np.repeat(np.arange(30), 100)
    state.learn(h, row)
    bit = np.concatenate([x[-1] for x in M.decisions(code, h, row, code.symbols(h), 20)])
    assert state.seen.sum() == state.map.sum() == len(bit) and state.map[:, 1].sum() == bit.sum()
    assert [sum(n.sum() for n in state.n)] == [M.ORDERS * len(bit)]


def test_states_add_up_and_counts_pass_32_bits():
    code = M.Code.build([(i, 100 + i) for i in range(1, 25)], 5)
    a, b = M.Learner(code, 16), M.Learner(code, 16)
    h = np.random.default_rng(2).integers(1, 30, 500).astype(np.uint64)
    for s in (a, b):
        s.learn(h, np.zeros(500, int))
    one = dict(((k, b), v) for k, b, v in summed(a))
    for k, b, v in summed(a, b):
        kind = np.float64 if k == M.ORDERS else np.int64
        assert np.allclose(np.frombuffer(v, kind), 2 * np.frombuffer(one[k, b], kind))
    most = np.full((4, 2), np.iinfo(np.int32).max, np.int32).tobytes()
    two = M._sum_rows(True)((0, 0, 0), pd.DataFrame({"v": [most, most]}))["v"].iloc[0]
    four = M._sum_rows(False)((0, 0, 0), pd.DataFrame({"v": [two, two]}))["v"].iloc[0]
    assert np.frombuffer(four, np.int64).tolist() == [4 * (2**31 - 1)] * 8


def test_table_grows_with_the_tokens():
    assert [M.slot_bits(n) for n in (0, 1 << 20, 1 << 22, 1 << 40)] == [M.LEAST_BITS, 19, 20, M.MOST_BITS]
