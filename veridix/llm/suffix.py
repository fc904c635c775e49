"""Operator 8: suffix-array dedup by two-stage sorting.

A suffix smaller than its successor is sorted directly; every other suffix is induced from those by bucket scans
over the first byte. Adjacent common prefixes follow from the sorted order. Everything here is whole-array numpy.

On a corpus, repeated strings are first located: every window of LENGTH bytes selects its smallest GRAM-byte hash
(its anchor), equal windows select the same one, and only windows whose anchor occurs elsewhere too go on, with
the text they cover, to the task that sorts that anchor's suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import bounded, bytes_of, cut, prefix_sums, read_table, span_hash

LENGTH, GRAM = 400, 32
#: An anchor with more different pieces than this isn't sorted in one task; its windows are grouped by hash.
DENSE = 4096
#: Bytes of text that a task sorts at a time.
CHUNK = 1 << 20
#: Bits of the map of wanted texts, the one thing that is sent to all tasks: 4 MB whatever the input.
MAP_BITS = 25


def _rank(key: np.ndarray) -> np.ndarray:
    """Dense ranks."""
    order = np.argsort(key)
    s = key[order]
    new = np.zeros(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is not."""
    n = len(t)
    small = np.zeros(n, bool)
    if n > 1:
        differs = t[1:] != t[:-1]
        at = np.where(differs, np.arange(n - 1), n)
        nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
        ok = nxt < n
        small[:-1][ok] = t[nxt[ok]] < t[nxt[ok] + 1]
    return small


def _sort_small(t: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The suffixes smaller than their successors, sorted directly.

    Each is named by its bytes up to the next such suffix; names are then compared by doubling.
    """
    pos = np.flatnonzero(small)
    m = len(pos)
    if m < 2:
        return pos
    n = len(t)
    nxt = np.append(pos[1:], n)
    sym = (t.astype(np.uint64) << np.uint64(1)) | small  # at equal bytes the smaller type sorts last
    size = np.minimum(nxt + 1, n) - pos
    name = np.zeros(m, np.int64)
    live = np.arange(m)
    done = 0
    while len(live):
        word = np.zeros(len(live), np.uint64)
        for k in range(done, done + 6):  # six symbols of ten bits
            ok = k < size[live]
            at = np.minimum(pos[live] + k, n - 1)
            word = (word << np.uint64(10)) | np.where(ok, sym[at] + np.uint64(1), np.uint64(0))
        if done == 0:
            name = _rank(word)
        else:  # refine the names of the long ones; the finished ones of a name sort first
            full = np.zeros(m, np.uint64)
            full[live] = _rank(word) + 1
            name = _rank(name * (m + 1) + full.astype(np.int64))
        done += 6
        live = live[size[live] > done]
        if len(live):
            count = np.bincount(name)
            live = live[count[name[live]] > 1]
    step = 1
    while name.max() + 1 < m:
        nxt_name = np.zeros(m, np.int64)
        nxt_name[:-step] = name[step:] + 1
        name = _rank(name * (m + 1) + nxt_name)
        step *= 2
        if step >= m:
            break
    return pos[np.argsort(name, kind="stable")]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of t (small non-negative integers). A suffix that is a prefix of another sorts first."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.int64)
    small = suffix_types(t)
    direct = _sort_small(t, small)
    sigma = int(t.max()) + 1
    count = np.bincount(t, minlength=sigma)
    head = np.concatenate([[0], np.cumsum(count)])
    sa = np.full(n, -1, np.int64)
    fill = head[:-1].copy()  # where each bucket's next induced suffix goes
    by = t[direct]
    bounds = np.searchsorted(by, np.arange(sigma + 1))

    def induce(found: np.ndarray) -> np.ndarray:
        """Place the larger-type predecessors of a sorted run of suffixes; those in the same bucket come back."""
        prev = found[found > 0] - 1
        prev = prev[~small[prev]]
        c = t[prev]
        order = np.argsort(c, kind="stable")
        prev, c = prev[order], c[order]
        chars, first, num = np.unique(c, return_index=True, return_counts=True)
        for ch, i, k in zip(chars.tolist(), first.tolist(), num.tolist(), strict=True):
            sa[fill[ch] : fill[ch] + k] = prev[i : i + k]
            fill[ch] += k
        return prev

    prev = np.array([n - 1])  # the last suffix is first in its bucket
    sa[fill[t[n - 1]]] = n - 1
    fill[t[n - 1]] += 1
    for ch in range(sigma):
        if not count[ch]:
            continue
        at = head[ch]
        while at < fill[ch]:  # a run of equal bytes feeds its own bucket
            stop = int(fill[ch])
            prev = sa[at:stop].copy()
            at = stop
            induce(prev)
        own = direct[bounds[ch] : bounds[ch + 1]]
        sa[head[ch + 1] - len(own) : head[ch + 1]] = own
        if len(own):
            induce(own)
    return sa


def adjacent_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[r] of suffixes sa[r-1] and sa[r]; lcp[0] is 0.

    In text order a prefix shrinks by one from its predecessor's unless the two partners' preceding bytes differ;
    only at those places bytes are compared, eight at a time.
    """
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = np.ones(n, bool)
    ok = (i > 0) & (phi > 0)
    fresh[ok] = t[i[ok] - 1] != t[phi[ok] - 1]
    fresh |= phi < 0
    padded = np.concatenate([t.astype(np.int32) + 1, np.zeros(16, np.int32)])
    at = np.flatnonzero(fresh & (phi >= 0))
    size = np.zeros(n, np.int64)
    live, k = at, 0
    while len(live):
        a, b = live, phi[live]
        same = np.ones(len(live), bool)
        for s in range(8):
            same &= (padded[np.minimum(a + k + s, n)] == padded[np.minimum(b + k + s, n)]) & (a + k + s < n) & (b + k + s < n)
            size[live] += same
        live, k = live[same], k + 8
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    plcp = np.maximum(size[last] - (i - last), 0)
    return plcp[sa]


def longest_matches(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the joined pieces how long a string from there occurs at another place; and piece offsets.

    Matches end at the pieces' ends.
    """
    off = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])]).astype(np.int64)
    t = np.zeros(int(off[-1]), np.int64)
    for p, a in zip(pieces, off.tolist(), strict=False):
        t[a : a + len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + 1
    sa = suffix_array(t)
    lcp = adjacent_prefixes(t, sa)
    best = np.zeros(len(t), np.int64)
    best[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    left = np.repeat(off[1:] - 1, np.diff(off)) - np.arange(len(t))
    return np.minimum(best, left), off


def anchors(a: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of one text's bytes: anchor hashes, the first and last window start that select each, hashes of the pieces
    that those windows cover, and whether a piece has several places of its anchor.

    Ties go to the last gram; the tie rule looks at the window alone, so equal windows agree.
    """
    n = len(a)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z > 0
    sums = prefix_sums(a)
    i = np.arange(n - gram + 1)
    h = span_hash(sums, i, i + gram)
    at = _window_minima(h, length - gram + 1)
    change = np.flatnonzero(np.diff(at)) + 1
    chosen = h[at]
    change = change[chosen[change] != chosen[change - 1]]  # a periodic stretch selects equal grams: one run
    lo = np.append(0, change)
    hi = np.append(change - 1, len(at) - 1)
    return chosen[lo].view(np.int64), lo, hi, span_hash(sums, lo, hi + length).view(np.int64), at[lo] != at[hi]


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the smallest of h[i:i+w], the last of equals: 20 low bits hold the place, at any length."""
    span = (1 << 20) - 2 * w
    if len(h) <= span:
        return _sliding_min_fixed(h, w)
    parts = []
    for s in range(0, len(h) - w + 1, span):
        part = h[s : min(len(h), s + span + w - 1)]
        parts.append(_sliding_min_fixed(part, w) + s)
    return np.concatenate(parts)


def _sliding_min_fixed(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    blocks = -(-n // w)
    mask = np.uint64((1 << 20) - 1)
    key = (h & ~mask) | (mask - np.arange(n, dtype=np.uint64))
    key = np.concatenate([key, np.full(blocks * w - n, np.iinfo(np.uint64).max, np.uint64)]).reshape(blocks, w)
    left = np.minimum.accumulate(key, axis=1).reshape(-1)
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (mask - (np.minimum(right[: n - w + 1], left[w - 1 : n]) & mask)).astype(np.int64)


def _find(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, anchor, lo, hi, piece, own); a text that the task has met is not searched again."""
    met: set[int] = set()
    for b in bounded(batches):
        a, off = bytes_of(b.column(1))
        out: list[tuple[np.ndarray, ...]] = []
        for k, i in enumerate(b.column(0).to_pylist()):
            if i in met:
                continue
            met.add(i)
            h, lo, hi, piece, own = anchors(a[off[k] : off[k + 1]], length, gram)
            if len(h):
                out.append((np.full(len(h), i, np.int64), h, lo, hi, piece, own))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "anchor", "lo", "hi", "piece", "own"])


def _only(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = ids.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _slices(length: int):
    """(id, text, spots) -> (anchor, id, lo, single, bytes)."""
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("lo", pa.int64()), ("single", pa.bool_()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            a, off = bytes_of(b.column(1))
            rows: list[tuple] = []
            for k, (i, spots) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                x = a[off[k] : off[k + 1]]
                rows += [(w["anchor"], i, w["lo"], w["single"], x[w["lo"] : w["hi"] + length].tobytes()) for w in spots]
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def repeated_spans(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per piece the runs of bytes covered by `length`-byte strings that occur at another place of the pieces."""
    best, off = longest_matches(pieces)
    out = []
    for p, o in zip(pieces, off.tolist(), strict=False):
        at = np.flatnonzero(best[o : o + len(p)] >= length)
        if not len(at):
            out.append([])
            continue
        br = np.flatnonzero(np.diff(at) > length)
        out.append(list(zip(at[np.append(0, br + 1)].tolist(), (at[np.append(br, len(at) - 1)] + length).tolist(), strict=True)))
    return out


def _sort(length: int, most: int):
    """Rows in anchor order -> (id, s, e) runs of repeated bytes; some whole anchors are sorted at a time."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        spans = [(i, lo + s, lo + e) for (i, lo, single, _), found in zip(held, repeated_spans([h[3] for h in held], length), strict=True) if single for s, e in found]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*spans, strict=True) if spans else ([], [], []))], names=["id", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in bounded(batches):
            for anchor, i, lo, single, piece in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= most and anchor != last:
                    yield flush(held)
                    held, size = [], 0
                held.append((i, lo, single, piece))
                last = anchor
                size += len(piece)
        if held:
            yield flush(held)

    return run


def _window_hashes(length: int):
    """(anchor, id, lo, single, bytes) -> (h, id, s): every window of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            for i, lo, piece in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                x = np.frombuffer(piece, np.uint8)
                at = np.arange(len(x) - length + 1)
                h = span_hash(prefix_sums(x), at, at + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(at), i, np.int64)), pa.array(at + lo)], names=["h", "id", "s"])

    return run


def _cover(length: int):
    """(doc_id, text, spans) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            a, off = bytes_of(b.column(1))
            out: list[list] = [[], [], [], [], []]
            for k, (i, spans, whole) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x = a[off[k] : off[k + 1]]
                n = len(x)
                merged: list[list[int]] = []
                if whole and n >= length:
                    merged = [[0, n]]
                else:
                    for s, e in sorted((w["s"], w["e"]) for w in spans or []):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                keep = np.ones(n, bool)
                for s, e in merged:
                    keep[s:e] = False
                for col, v in zip(out, (i, n, n - int(keep.sum()), len(merged), x[keep].tobytes()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, dense: int = DENSE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary): every byte covered by a `length`-byte
    string that also starts elsewhere, in the same text or another, is removed; judged on the input.

    Null texts are empty and texts shorter than `length` are kept whole; copies of a text of at least `length`
    bytes go whole; repeated rows and equal or null ids are separate documents; an empty table gives no rows;
    other columns are ignored. Equal texts share a 64-bit id and are searched once a task. Pieces that occur
    more than once are repeated as a whole; one of each goes to the suffix sort of its anchor, where only pieces
    that differ meet. An anchor with over `dense` different pieces is not gathered: its windows are grouped by hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = rows.withColumn("id", F.xxhash64(F.xxhash64("text"), F.md5("text")))
    long = named.where(F.octet_length("text") >= length).select("id", "text")
    found = cut(long.mapInArrow(lambda it: _find(it, length, gram), "id long, anchor long, lo long, hi long, piece long, own boolean"))
    place = F.struct("id", "lo", "hi")
    pieces = cut(found.groupBy("anchor", "piece").agg(F.min(place).alias("one"), (F.min(place) != F.max(place)).alias("many"), F.max("own").alias("own")))
    repeated = found.join(pieces.where("many").select("anchor", "piece"), ["anchor", "piece"], "left_semi").select("id", F.col("lo").alias("s"), (F.col("hi") + length).alias("e")).distinct()
    # a piece meets the others of its anchor; one with several places of it may hold repeats of its own
    meet = pieces.groupBy("anchor").agg(F.count("*").alias("n"), F.max("own").alias("some")).where("n > 1 or some").drop("some")
    wanted = pieces.join(meet, "anchor").select(F.col("one.id").alias("id"), F.struct("anchor", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), (~F.col("many")).alias("single"), (F.col("n") > dense).alias("dense")).alias("spot"))
    wanted = cut(wanted.groupBy("id").agg(F.collect_list("spot").alias("spots")))

    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    shift = F.shiftrightunsigned("id", 64 - MAP_BITS) + 1  # bit positions count from 1
    blocks = wanted.groupBy(F.bitmap_bucket_number(shift).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(shift)).alias("m")).collect()  # 2**25 bits at most
    for r in blocks:
        first = (r["k"] - 1) * 4096
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        bits[first : first + len(part)] |= part[: len(bits) - first]
    sent = spark.sparkContext.broadcast(bits)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in bounded(batches):
            ids = np.asarray(b.column(0))
            ok = _only(ids, sent.value)
            for k in np.flatnonzero(ok).tolist():
                ok[k] = int(ids[k]) not in met
                met.add(int(ids[k]))
            yield b.filter(pa.array(ok))

    texts = long.mapInArrow(select, "id long, text string").groupBy("id").agg(F.first("text").alias("text"))
    sliced = cut(texts.join(wanted.withColumn("spots", F.filter("spots", lambda w: ~w["dense"])), "id").mapInArrow(_slices(length), "anchor long, id long, lo long, single boolean, bytes binary"))
    spans = sliced.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort(length, CHUNK), "id long, s long, e long")
    crowded = wanted.withColumn("spots", F.filter("spots", lambda w: w["dense"])).where(F.size("spots") > 0)
    windows = texts.join(crowded, "id").mapInArrow(_slices(length), "anchor long, id long, lo long, single boolean, bytes binary").mapInArrow(_window_hashes(length), "h long, id long, s long")
    shared = windows.groupBy("h").agg((F.min(F.struct("id", "s")) != F.max(F.struct("id", "s"))).alias("many")).where("many").select("h")
    more = windows.join(shared, "h", "left_semi").select("id", "s", (F.col("s") + length).alias("e"))
    parts = [repeated, spans]
    if not crowded.isEmpty():
        parts.append(more)
    all_spans = parts[0]
    for p in parts[1:]:
        all_spans = all_spans.unionAll(p)
    by_text = all_spans.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    whole = named.where(F.octet_length("text") >= length).groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1").select("id", F.lit(True).alias("whole"))
    marks = cut(by_text.join(whole, "id", "full"))
    ready = named.join(marks, "id", "left").select("doc_id", "text", F.when(F.col("whole").isNull(), F.col("spans")).alias("spans"), F.coalesce("whole", F.lit(False)).alias("whole"))
    return ready.mapInArrow(_cover(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix": op8_suffix}
ORACLE: dict[str, str] = {}
