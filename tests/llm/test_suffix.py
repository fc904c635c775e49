from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veridix.llm import suffix as S


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 4))
def test_suffix_array_and_prefixes(t, times):
    t = np.array(t * times, np.int64)
    n = len(t)
    want = sorted(range(n), key=lambda i: t[i:].tolist())
    assert S.suffix_array(t).tolist() == want

    def common(a, b):
        k = 0
        while max(a, b) + k < n and t[a + k] == t[b + k]:
            k += 1
        return k

    assert S.adjacent_prefixes(t, np.array(want, int)).tolist() == [0, *[common(want[i - 1], want[i]) for i in range(1, n)]][:n]


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        keep = np.ones(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                keep[i : i + length] = False
        spans = int((np.diff(np.concatenate([[1], keep, [1]]).astype(int)) == -1).sum())
        out.append((len(t), int((~keep).sum()), spans, np.frombuffer(t, np.uint8)[keep].tobytes()))
    return sorted(out)


def test_removed_bytes_equal_brute_force(docs, rows, no_docs):
    texts = [(r[1] or "").encode() for r in rows]
    for length, gram, dense in ((400, 32, 4096), (60, 8, 4096), (60, 8, 1)):
        got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(docs, length, gram, dense).collect())
        assert got == brute(texts, length)
    assert S.remove_repeats(no_docs).count() == 0
