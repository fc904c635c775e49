"""Operator 1: hierarchical multi-length packing.

Documents are routed to context-size tiers by their token count (longer ones give whole long windows first).
Each tier is packed into windows of its own size; the gap of a long window is filled from shorter tiers, by the
longest whole piece that fits and at last by cutting a piece to the exact remainder. Windows are dealt to step
groups of equal token counts and near-equal attention cost.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import bounded, read_table, settle

#: Context sizes, powers of two; the last is the longest window.
TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task holds before it packs them, so memory is bounded whatever a partition holds.
HELD = 1 << 22
#: Tokens of a step group.
STEP = 8 * TIERS[-1]
#: The id that ends a document.
END_ID = 2

Piece = tuple[int, int, int]  # document number, start, length
Window = list[Piece]


def _take(pool: list[tuple[int, int, int]], most: int) -> Piece | None:
    """The longest piece of the pool (sorted by length) that has at most `most` tokens."""
    at = bisect_right(pool, (most, 1 << 62, 1 << 62))
    if not at:
        return None
    n, doc, start = pool.pop(at - 1)
    return doc, start, n


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[Window]:
    """Windows over documents of the given token counts. Every token lies in one piece; a window's pieces add up
    to a power of two, so none is padded. No documents, or only empty ones, give no windows."""
    top = tiers[-1]
    out: list[Window] = []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start)

    def route(doc: int, start: int, n: int) -> None:
        if n:
            insort(pools[next(i for i, t in enumerate(tiers) if n <= t)], (n, doc, start))

    def cut(i: int, most: int) -> Piece | None:
        """A piece of at most `most` tokens off tier i's shortest entry that is at least as long, else whole."""
        if not pools[i]:
            return None
        at = min(bisect_right(pools[i], (most, -1, -1)), len(pools[i]) - 1)
        n, doc, start = pools[i].pop(at)
        if n > most:
            route(doc, start + most, n - most)
        return doc, start, min(n, most)

    for doc, n in enumerate(lengths):
        whole = n // top * top
        out += [[(doc, s, top)] for s in range(0, whole, top)]
        route(doc, whole, n - whole)
    for i in range(len(tiers) - 1, -1, -1):
        while pools[i]:
            n, doc, start = pools[i].pop()
            window, gap = [(doc, start, n)], tiers[i] - n
            while gap:
                got = next((p for p in (_take(pools[j], gap) for j in range(i - 1, -1, -1)) if p), None)
                got = got or next((p for p in (cut(j, gap) for j in range(i + 1)) if p), None)
                if not got:
                    break
                window.append(got)
                gap -= got[2]
            out += [window] if not gap else _split(window)
    return out


def _split(window: Window) -> list[Window]:
    """The last, unfilled window as windows whose sizes are the powers of two of its token count."""
    left = sum(p[2] for p in window)
    out: list[Window] = []
    todo = window[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, n = todo.pop()
            k = min(n, room)
            out[-1].append((doc, start, k))
            room -= k
            if k < n:
                todo.append((doc, start + k, n - k))
    return out


def step_groups(windows: list[Window], step: int = STEP) -> list[int]:
    """A group number per window. Windows of one size share groups of step // size windows; by falling attention
    cost (the sum of squared piece lengths) they are dealt to and fro, so the groups of a size cost about the same."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by.setdefault(sum(p[2] for p in w), []).append(i)
    group, first = [0] * len(windows), 0
    for size in sorted(by, reverse=True):
        own = sorted(by[size], key=lambda i: (-sum(p[2] ** 2 for p in windows[i]), i))
        n = -(-len(own) // max(1, step // size))
        for rank, i in enumerate(own):
            turn, k = divmod(rank, n)
            group[i] = first + (n - 1 - k if turn % 2 else k)
        first += n
    return group


#: Closing marks; after an ASCII letter they are a pre-token of their own.
_TAIL = b".,!?;:|"
#: Stands between words that are encoded in one call.
_MARK = b"\x01"
#: Words of a-z and the lower-case letters of Latin-1.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class WordEncoder:
    """Ids of whole texts by a word-level BPE file that drops white space: each distinct word is encoded once.

    No pre-token of such a tokenizer spans ASCII white space, and it lower-cases, so the ids of the lower-cased
    words in order are the text's ids.
    """

    def __init__(self, path: str, most: int = 1_200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core; threads only cost CPU time
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # a word of lower-case letters is one pre-token and needs no normaliser; of ASCII letters, no byte mapping
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mapped = Tokenizer.from_file(path)
        self.mapped.normalizer = normalizers.Sequence([])
        self.mapped.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        known = self.known
        if len(known) > self.most:
            short = {w: x for w, x in known.items() if len(w) <= 7}  # the frequent ones, mostly
            known = self.known = short if len(short) < self.most // 2 else {}
        plain, mapped, other, tailed = set(), set(), set(), []
        for w in set().union(*words).difference(known):
            stem = w.rstrip(_TAIL)
            if len(stem) < len(w) and stem[-1:].isalpha():
                tailed.append((w, stem))
                if stem in known:
                    continue
                w = stem
            (plain if w.isalpha() else mapped if _LATIN.fullmatch(w) else other).add(w)
        self._learn(self.plain, b".", list(plain))
        self._learn(self.mapped, b".", list(mapped))
        self._learn(self.tokenizer, _MARK, [w for w in other if _MARK not in w])
        for w in other:
            if _MARK in w:
                known[w] = self._ids(w)
        for w, stem in tailed:
            tail = w[len(stem) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self._ids(tail)
            known[w] = known[stem] + self.tails[tail]
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in words]

    def _ids(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, tokenizer, mark: bytes, words: list[bytes]) -> None:
        (stop,) = tokenizer.encode(mark.decode(), add_special_tokens=False).ids
        parts = [words[i : i + 500] for i in range(0, len(words), 500)]
        found = tokenizer.encode_batch_fast([(b" " + mark + b" ").join(p).decode("utf-8", "replace") for p in parts], add_special_tokens=False)
        for part, e in zip(parts, found, strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ids == stop)
            starts, ends, raw = np.append(0, at + 1).tolist(), np.append(at, len(ids)).tolist(), ids.tobytes()
            for w, i, j in zip(part, starts, ends, strict=True):
                self.known[w] = raw[4 * i : 4 * j]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, cached_words: int) -> WordEncoder:
    """One encoder a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].most = cached_words
    return _ENCODERS[path]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_tokens long, step_id long"


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, with_ids: bool = False, cached_words: int = 1_200_000, forget: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row per piece (see SCHEMA), with the ids themselves if asked for.

    Each task packs what it reads, HELD tokens at a time, without a shuffle; sequence_id and step_id start at the
    task's number times 2**33. Null and empty texts are one token, the end id. Rows with equal or null ids are
    packed as separate documents. An empty table gives no rows; other columns are ignored. cached_words bounds what a
    Python worker keeps of words' ids, about 200 bytes each; forget: nor does it keep its tokenizer beyond the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, cached_words)
        base = TaskContext.get().partitionId() << 33
        first = [0, 0]
        ids: list[int | None] = []
        held: list[bytes] = []
        end = np.array([END_ID], "<u4").tobytes()

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = [len(x) // 4 for x in held]
            windows = pack(sizes, tiers)
            groups = step_groups(windows)
            rows = []
            for k, (w, g) in enumerate(zip(windows, groups, strict=True)):
                at, size = 0, sum(p[2] for p in w)
                for doc, start, n in w:
                    crc = zlib.crc32(memoryview(held[doc])[4 * start : 4 * (start + n)])
                    rows.append((ids[doc], start, n, crc, sizes[doc], base + first[0] + k, at, size, base + first[1] + g, doc))
                    at += n
            first[0] += len(windows)
            first[1] += max(groups, default=-1) + 1
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i : i + 20_000], strict=True))
                arrays = [pa.array(c, pa.int64()) for c in cols[:9]]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(held[d], "<u4")[s : s + n].astype(np.int32) for d, s, n in zip(cols[9], cols[1], cols[2], strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)
            ids.clear()
            held.clear()

        total = 0
        for b in bounded(batches):
            for i, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids.append(i)
                held.append(x + end)
                total += len(x) // 4 + 1
                if total >= HELD:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()
        if forget:
            _ENCODERS.clear()
            del enc
        settle()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file())


QUERIES = {"op1_packing": op1_packing}
ORACLE: dict[str, str] = {}
