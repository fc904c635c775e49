"""Operator 2: edit-aware token counts.

A document keeps its pre-tokens in leaves, and over the leaves a tree of token sums. An edit re-encodes the
pre-tokens it touches and their neighbours, as far as the old and the new division of the text differ, and updates
the sums on the way to the root; the rest of the text isn't looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import bounded, read_table

#: Pre-tokens of a leaf.
LEAF = 64
#: Code points that are divided beyond an edit before the old and the new division are compared.
CONTEXT = 64


class Counter:
    """Token counts of pre-tokens by a byte-pair vocabulary; each distinct pre-token is encoded once."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 400_000) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.most = most

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in pieces]


class Document:
    """A text with its leaves (lists of pre-tokens) and a tree of (code points, tokens) sums over them."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        pieces = counter.split.findall(text)
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.encoded = 0  # pre-tokens that edits had to encode again
        self._grow()

    def _grow(self) -> None:
        n = 1
        while n < len(self.leaves):
            n *= 2
        self.width = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, leaf in enumerate(self.leaves):
            self.chars[n + i] = sum(map(len, leaf))
            self.tokens[n + i] = sum(self.counter.count(leaf))
        for i in range(n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at` (the last one at the end), and the leaf's first code point."""
        i, first = 1, 0
        while i < self.width:
            i *= 2
            if at >= first + self.chars[i] and self.chars[i + 1]:
                first += self.chars[i]
                i += 1
        return min(i - self.width, len(self.leaves) - 1), first

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.leaves[leaf] = pieces
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(self.counter.count(pieces))
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of the code points from start to end (clipped to the text)."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        # from two pre-tokens before the edit: the pattern looks at most one pre-token ahead and one back
        lo, first = self._find(max(0, start - 1))
        k, at = 0, first
        own = self.leaves[lo]
        while k < len(own) and at + len(own[k]) < start:
            at += len(own[k])
            k += 1
        back = 2
        while back and (k or lo):
            if k == 0:
                lo -= 1
                own = self.leaves[lo]
                k = len(own)
                continue
            k -= 1
            at -= len(own[k])
            back -= 1
        # old pre-tokens from there on, until the division after the edit is the old one again
        old: list[str] = []
        hi, j, size = lo, k, 0
        reach = CONTEXT
        while True:
            while size < end - at + reach and hi < len(self.leaves):
                part = self.leaves[hi]
                if j >= len(part):
                    hi, j = hi + 1, 0
                    continue
                old.append(part[j])
                size += len(part[j])
                j += 1
            text = "".join(old)
            fresh = self.counter.split.findall(text[: start - at] + new + text[end - at :])
            done = hi >= len(self.leaves) or all(i >= len(p) for i, p in [(j, self.leaves[hi])]) and hi == len(self.leaves) - 1
            if done:
                keep_old, keep_new = len(old), len(fresh)
                break
            # ends of old and new pre-tokens counted from the far side; the last two may be cut by the window
            shift = len(new) - (end - start)
            ends = {}
            n = at
            for i, p in enumerate(old):
                n += len(p)
                ends[n + shift] = i + 1
            n, found = at, None
            for i, p in enumerate(fresh[:-2]):
                n += len(p)
                if n >= start + len(new) + 1 and n in ends and ends[n] <= len(old) - 2:
                    found = (ends[n], i + 1)
                    break
            if found:
                keep_old, keep_new = found
                break
            reach *= 4
        fresh = fresh[:keep_new]
        self.encoded += len(fresh)
        self._replace(lo, k, keep_old, fresh)

    def _replace(self, lo: int, k: int, n_old: int, fresh: list[str]) -> None:
        """Put `fresh` in place of n_old pre-tokens from pre-token k of leaf lo on."""
        kept = self.leaves[lo][:k]
        hi, left = lo, n_old
        j = k
        while left:
            step = min(left, len(self.leaves[hi]) - j)
            left -= step
            j += step
            if left:
                self._set(hi, []) if hi > lo else None
                hi, j = hi + 1, 0
        if hi == lo:
            merged = kept + fresh + self.leaves[lo][j:]
        else:
            self._set(hi, self.leaves[hi][j:])
            merged = kept + fresh
        if len(merged) <= 4 * LEAF:
            self._set(lo, merged)
        else:  # a leaf that has grown too much is split and the tree built again
            self.leaves[lo : lo + 1] = [merged[i : i + LEAF] for i in range(0, len(merged), LEAF)]
            self.leaves = [x for x in self.leaves if x] or [[]]
            self._grow()


def production_edits(n: int) -> list[tuple[int, int, str]]:
    """The query's edits of a text of n code points: an insertion, a removal, a replacement and an appended line, each
    in the text that the edits before it left."""
    return [(n // 3, n // 3, " (see note 7) "), (2 * n // 3, 2 * n // 3 + 16, ""), (n // 2, n // 2 + 3, "Edit"), (1 << 60, 1 << 60, "\nEnd of revision 2.\n")]


_COUNTERS: dict[tuple[str, str], Counter] = {}
SCHEMA = "doc_id long, n_tokens_before long, n_tokens_after long, n_leaves long, n_pretokens long, n_reencoded long, n_chars_after long"


def count_edited(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text[, edits array<struct<start, stop, new>>]) -> see SCHEMA: counts before and after the edits.

    Without a column `edits`, production_edits are made. Edits lie in the text as the ones before them left it and are
    clipped to it; null edits change nothing. Null texts are empty. Rows are independent; an empty table gives no
    rows; other columns are ignored.
    """
    own = "edits" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pattern)
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*key)
        counter = _COUNTERS[key]
        for b in bounded(batches):
            rows = []
            lists = b.column(2).to_pylist() if own else [None] * b.num_rows
            for i, text, edits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lists, strict=True):
                text = text or ""
                d = Document(text, counter)
                before, pieces = d.total, sum(map(len, d.leaves))
                todo = [(e["start"], e["stop"], e["new"] or "") for e in edits or [] if e] if own else production_edits(len(text))
                for s, e, new in todo:
                    d.edit(s, e, new)
                rows.append((i, before, d.total, len(d.leaves), pieces, d.encoded, d.length))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    cols = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col("edits")] if own else [])]
    return docs.select(*cols).mapInArrow(run, SCHEMA)


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_edited(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op2_edit_counts": op2_edit_counts}
ORACLE: dict[str, str] = {}
