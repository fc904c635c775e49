import zlib

import numpy as np
from tokenizers import Tokenizer

from veridix.llm import packing as P


def test_pieces_rebuild_every_document(docs, rows, no_docs):
    t = Tokenizer.from_file(P.tokenizer_file())
    want = sorted(([*t.encode(r[1] or "", add_special_tokens=False).ids, P.END_ID] for r in rows), key=str)
    got = P.pack_documents(docs, P.tokenizer_file(), with_ids=True).collect()
    by_window, texts, parts = {}, [], {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], list(r["ids"])))
    for w in by_window.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    for (_, n), own in parts.items():
        ids, at = [], 0
        for start, piece in sorted(own):
            if start != at and start == 0 or at == n:  # a repeated row
                texts.append(ids)
                ids, at = [], 0
            ids += piece
            at += len(piece)
        texts.append(ids)
    assert sum(map(len, texts)) == sum(map(len, want))
    assert {str(x) for x in want if len(x) < 3000} <= {str(x) for x in texts} | {str(x) for x in want if want.count(x) > 1}
    assert P.pack_documents(no_docs, P.tokenizer_file()).count() == 0


def test_windows_are_full_and_groups_even():
    lengths = [1, 5000, 300, 700, 2100, 4096, 8192, 17, 1500, 0, 900] * 20
    windows = P.pack(lengths)
    seen = {}
    for w in windows:
        n = sum(p[2] for p in w)
        assert n & (n - 1) == 0
        for d, s, k in w:
            seen.setdefault(d, []).append((s, k))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen.get(d, [])):
            assert s == at and k
            at += k
        assert at == n
    groups = P.step_groups(windows)
    full = {}
    for g, w in zip(groups, windows, strict=True):
        full.setdefault((sum(p[2] for p in w), g), []).append(w)
    sizes = [len(x) for (n, _), x in full.items() if n == 4096]
    assert max(sizes) - min(sizes) <= 1


def test_words_encode_as_whole_texts():
    e, t = P.WordEncoder(P.tokenizer_file(), most=5), Tokenizer.from_file(P.tokenizer_file())
    for x in ("It's 10 o'clock,  NOW!\nÉté... a\x01b \x1c ß—, x.", "ﬁn İ  'll", "<|endoftext|> a", "\x01", "K é Á."):
        assert e.encode([x]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()]
