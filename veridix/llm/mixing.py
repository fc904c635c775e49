"""Operator 4: language-model scoring by online logistic context mixing.

A token is coded as binary decisions along its Huffman path. Each decision is predicted from hashed contexts (none,
the latest frequent token, the previous two); the predictions meet in the logistic domain under weights that a gate picks
by the contexts' confidence, and an adaptive map refines the mixed probability. Every training task runs online
over its documents: predict, correct the weights and the map, count. Counts and maps add up over all tasks, weights
average, and the sum scores every document.

Events are those of the base score: each distinct training token, and one unknown token. The VOCABULARY most
frequent tokens have paths of their own; the others share an escape path and split its probability by their
counts, which are joined from the whole table of token counts.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import LOWER, WHITE, bounded, bytes_of, cut, mix64, prefix_sums, read_table, runs, span_hash

#: Tokens with a path of their own at most, and bits of the slots of each hashed context: the table is broadcast, so it
#: grows with the training tokens, TOKENS_A_SLOT of them a slot, between these bounds.
VOCABULARY, LEAST_BITS, MOST_BITS, TOKENS_A_SLOT = 1 << 17, 16, 20, 3
#: Context of order one is the text's latest token among so many most frequent ones.
RANKS = 64
#: Decisions after which the weights and the map are corrected; all decisions do.
STEP = 1 << 16
ORDERS = 3
GATES, KNOTS = 64, 33
#: Leading bits by which a token's hash is looked up.
_TOP = 18
#: The hash that stands for the end of a text.
END = np.uint64(0xE9D0F7E2D5A1B3C7)
_BLOCK = 1 << 14
#: Tables of a block that a task adds up.
FAN = 64


def slot_bits(tokens: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, (tokens // TOKENS_A_SLOT).bit_length()))


def held_out(doc_id) -> bool:
    """Of a row without an id the text "null" is taken."""
    return zlib.crc32(str("null" if doc_id is None else int(doc_id)).encode()) % 5 == 1


def tokens(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte lengths and rows of the tokens: each text's words, then one end."""
    low = LOWER[a]
    starts, ends, row = runs(~WHITE[low], off)
    h = span_hash(prefix_sums(low), starts, ends)
    n = len(off) - 1
    at = np.searchsorted(row, np.arange(n), side="right")
    return np.insert(h, at, END), np.insert(ends - starts, at, 0), np.insert(row, at, np.arange(n))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, inner nodes and bits of the symbols' paths; symbols in order of rising offset."""
    n = len(counts)
    if n == 1:
        return np.array([0, 0]), np.zeros(0, np.int32), np.zeros(0, np.uint8)
    heap = [(int(c), i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    parent, side = [0] * (2 * n - 1), [0] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = node
        side[b[1]] = 1
        heapq.heappush(heap, (a[0] + b[0], node))
    root = 2 * n - 2
    off, nodes, bits = [0], [], []
    for s in range(n):
        path = []
        x = s
        while x != root:
            path.append((parent[x] - n, side[x]))
            x = parent[x]
        nodes += [p[0] for p in path[::-1]]
        bits += [p[1] for p in path[::-1]]
        off.append(len(nodes))
    return np.array(off), np.array(nodes, np.int32), np.array(bits, np.uint8)


@dataclass
class Code:
    """The coded tokens: sorted hashes with their symbol, rank and count; the last symbol is the escape."""

    hashes: np.ndarray
    symbol: np.ndarray
    count: np.ndarray  # by symbol
    start: np.ndarray  # first hash of each run with the same _TOP bits
    off: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def build(cls, top: list[tuple[int, int]], rest: float) -> Code:
        """top: (unsigned hash, count) by falling count; rest: what all other tokens and the unknown one weigh."""
        h = np.array([t[0] for t in top], np.uint64)
        count = np.array([t[1] for t in top], np.float64)
        order = np.argsort(h)
        h = h[order]
        start = np.searchsorted(h >> np.uint64(64 - _TOP), np.arange((1 << _TOP) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(h, order, count, start, *huffman(np.append(count, max(1, round(rest)))))

    @property
    def nodes(self) -> int:
        return max(1, len(self.count))

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbols of the hashes: the hashes of the same top bits are met one by one, few at most."""
        out = np.full(len(h), len(self.count))
        top = (h >> np.uint64(64 - _TOP)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            spot = at[left]
            same = self.hashes[spot] == h[left]
            out[left[same]] = self.symbol[spot[same]]
            at[left] += 1
            left = left[~same & (spot + 1 < end[left])]
        return out


def contexts(h: np.ndarray, row: np.ndarray, sym: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's contexts: the text's latest frequent token, the previous two tokens."""
    n = len(h)
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    one = np.zeros(n, np.uint64)
    one[1:] = h[:-1]
    one[first] = 0
    two = np.zeros(n, np.uint64)
    two[1:] = one[:-1]
    two[first] = 0
    latest = np.append(-1, np.maximum.accumulate(np.where(sym < RANKS, np.arange(n), -1))[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.where(latest >= start, sym[latest] + 1, 0).astype(np.uint64)  # 0: none in this text yet
    with np.errstate(over="ignore"):
        return [(mix64(x) >> np.uint64(32)).astype(np.uint32) for x in (rank + np.uint64(1), one * np.uint64(3) + two)]


def decisions(code: Code, h: np.ndarray, row: np.ndarray, sym: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """The tokens in runs of about STEP decisions: first and last token, and of every decision its token's number in the
    run, its slot in each order's table, and its bit."""
    if not len(h):
        return
    seen = contexts(h, row, sym)
    size = (code.off[1:] - code.off[:-1])[sym]
    ends = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], STEP), side="right"), len(h)))
    for i, j in zip(np.append(0, cuts)[:-1], cuts, strict=True):
        if i == j:
            continue
        own = size[i:j]
        token = np.repeat(np.arange(j - i), own)
        at = (code.off[sym[i:j]] - np.append(0, np.cumsum(own)[:-1]))[token]
        at += np.arange(len(token))
        node, bit = code.node[at], code.bit[at]
        u = node.view(np.uint32) * np.uint32(0x9E3779B1)
        u += np.uint32(0x85EBCA77)
        slots = [node.astype(np.int64)]
        for c in seen:
            x = c[i:j][token]
            x ^= u
            x *= np.uint32(0xC2B2AE3D)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x27D4EB2F)
            x >>= np.uint32(32 - bits)
            slots.append(x.astype(np.int64))
        yield i, j, token, slots, bit


_CONF = np.array([0, 1, 2, 2, 3, 3, 3, 3] + [4] * 8 + [5] * 48 + [6] * 192 + [7], np.uint8)


def stretch(n: np.ndarray) -> np.ndarray:
    """Log-odds of counted bits (rows of zeros and ones) as 32-bit floats, whose lowest three bits are the confidence
    class: a decision reads both at once."""
    x = n.astype(np.float32)
    odds = np.log((x[:, 1] + np.float32(0.4)) / (x[:, 0] + np.float32(0.4)))
    return (odds.view(np.uint32) & np.uint32(0xFFFFFFF8)) | _CONF[np.minimum(x[:, 0] + x[:, 1], 256).astype(np.int64)]


def read(tables: list[np.ndarray], slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Log-odds of each order, and the gate that their confidences pick."""
    got = [t[s] for t, s in zip(tables, slots, strict=True)]
    gate = (got[1] & np.uint32(7)) << np.uint32(3)
    gate |= got[2] & np.uint32(7)
    return [g.view(np.float32) for g in got], gate.astype(np.int64)


def _knot(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x + np.float32(8)) * np.float32((KNOTS - 1) / 16)), 0, KNOTS - 1).astype(np.int64)


def _mix(st: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """weights: a row an order, and one of biases."""
    x = weights[ORDERS][gate]
    for k in range(ORDERS):
        x += weights[k][gate] * st[k]
    return np.clip(x, -12, 12, out=x)


def start_weights() -> np.ndarray:
    """Each gate begins with what its confidences suggest: the surer context counts more."""
    w = np.zeros((ORDERS + 1, GATES), np.float32)
    for g in range(GATES):
        c1, c2 = divmod(g, 8)
        raw = np.array([2.0, c1, 0.5 * c2])
        w[:ORDERS, g] = raw / raw.sum()
    return w


class Learner:
    """The state of one training task."""

    def __init__(self, code: Code, bits: int) -> None:
        self.code, self.bits = code, bits
        self.n = [np.zeros((code.nodes if k == 0 else 1 << bits, 2), np.int32) for k in range(ORDERS)]
        self.weights = start_weights()
        self.seen = np.zeros(GATES)
        self.map = np.zeros((GATES * KNOTS, 2))

    def learn(self, h: np.ndarray, row: np.ndarray) -> None:
        """Weights and map are corrected by every decision, about STEP of them at once; counts follow at the end."""
        told = [stretch(n) for n in self.n]
        met: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
        for _, _, _, slots, bit in decisions(self.code, h, row, self.code.symbols(h), self.bits):
            self._correct(told, slots, bit)
            for k, s in enumerate(slots):
                s *= 2
                s += bit
                met[k].append(s.astype(np.int32))
        for n, parts in zip(self.n, met, strict=True):
            if parts:
                flat = n.reshape(-1)
                np.add(flat, np.bincount(np.concatenate(parts), minlength=len(flat)), out=flat, casting="unsafe")

    def _correct(self, told: list[np.ndarray], slots: list[np.ndarray], bit: np.ndarray) -> None:
        st, gate = read(told, slots)
        x = _mix(st, gate, self.weights)
        cell = gate * KNOTS
        cell += _knot(x)
        cell *= 2
        cell += bit
        self.map += np.bincount(cell, minlength=2 * GATES * KNOTS).reshape(-1, 2)
        p = 1 / (1 + np.exp(-x))
        error, curve = bit - p, p * (1 - p)
        count = np.bincount(gate, minlength=GATES)
        for k, s in enumerate([*st, None]):
            g = np.bincount(gate, weights=error if s is None else error * s, minlength=GATES)
            c = np.bincount(gate, weights=curve if s is None else curve * s * s, minlength=GATES)
            self.weights[k] += (0.25 * g / (c + 20)).astype(np.float32)
        self.seen += count

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(table, block, values): counts of zeros and ones as 64-bit pairs after the first sum, 32-bit before, then the
        weights and the map."""
        for k, n in enumerate(self.n):
            for b in range(0, len(n), _BLOCK):
                part = n[b : b + _BLOCK]
                if part.any():
                    yield k, b, part.tobytes()
        yield ORDERS, 0, np.concatenate([(self.weights * self.seen).ravel(), self.seen, self.map.ravel()]).astype(np.float64).tobytes()


def _sum_rows(first: bool):
    """Sums of a block's tables, 64-bit counts from the first sum on."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind = np.float64 if key[0] == ORDERS else np.int32 if first else np.int64
        total = np.frombuffer(pdf["v"].iloc[0], kind).astype(np.float64 if key[0] == ORDERS else np.int64)
        for v in pdf["v"].iloc[1:]:
            total += np.frombuffer(v, kind)
        return pd.DataFrame({"k": [key[0]], "b": [key[1]], "p": [key[2]], "v": [total.tobytes()]})

    return run


@dataclass
class Model:
    code: Code
    told: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    bits: int

    @classmethod
    def build(cls, code: Code, bits: int, rows: Iterable[tuple[int, int, bytes]]) -> Model:
        n = [np.zeros((code.nodes if k == 0 else 1 << bits, 2), np.int64) for k in range(ORDERS)]
        weights, amap = start_weights(), np.zeros((GATES * KNOTS, 2))
        for k, b, v in rows:
            if k < ORDERS:
                part = np.frombuffer(v, np.int64).reshape(-1, 2)
                n[k][b : b + len(part)] += part
            else:
                x = np.frombuffer(v, np.float64)
                w, seen = x[: GATES * (ORDERS + 1)].reshape(-1, GATES), x[GATES * (ORDERS + 1) :][:GATES]
                amap = x[GATES * (ORDERS + 2) :].reshape(-1, 2)
                ok = seen > 0
                weights[:, ok] = (w[:, ok] / seen[ok]).astype(np.float32)
        centre = 1 / (1 + np.exp(-(np.arange(KNOTS) * 16 / (KNOTS - 1) - 8)))
        refined = (amap[:, 1] + 8 * np.tile(centre, GATES)) / (amap.sum(axis=1) + 8)
        return cls(code, [stretch(x) for x in n], weights, refined.astype(np.float32), bits)

    def token_scores(self, h: np.ndarray, row: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Per token the log10 probability of its path."""
        out = np.zeros(len(h))
        for i, j, token, slots, bit in decisions(self.code, h, row, sym, self.bits):
            st, gate = read(self.told, slots)
            x = _mix(st, gate, self.weights)
            gate *= KNOTS
            gate += _knot(x)
            p = np.float32(0.5) / (1 + np.exp(-x))
            p += np.float32(0.5) * self.refined[gate]
            p -= bit ^ 1
            np.abs(p, out=p)  # p of a one, 1 - p of a zero
            out[i:j] = np.bincount(token, weights=np.log(np.maximum(p, np.float32(1e-7), out=p)), minlength=j - i)
        return out / np.log(10)


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Documents whose crc32(doc_id as text) mod 5 isn't 1 train. Null texts are empty: one token, the end. Repeated
    rows count and are scored each; a null id counts as the text "null". No training rows: nothing is known and
    every token has probability one half of nothing learnt, log10(0.5 / 0.5) = 0. An empty table gives no rows;
    other columns are ignored. bits_per_byte is the code length of the lower-cased text, with unknown words
    written out in bytes; null for texts of no bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = rows.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(5)) != 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, inv = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, weights=c).astype(np.int64))], names=["h", "c"])

        for b in bounded(batches):
            h, _, _ = tokens(*bytes_of(b.column(0)))
            parts.append(np.unique(h, return_counts=True))
            size += len(parts[-1][0])
            if size > 2_000_000:
                yield merged()
                parts, size = [], 0
        if parts:
            yield merged()

    counts = cut(train.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = whole["n"], whole["v"]
    top = [(int(np.int64(r["h"]).view(np.uint64)), r["c"]) for r in counts.orderBy(F.desc("c"), "h").limit(vocabulary).collect()]  # at most VOCABULARY rows
    rest = (n_all - sum(c for _, c in top)) + 0.5 * (v_all - len(top) + 1)
    code = Code.build(top, rest)
    bits = slot_bits(n_all)
    code_sent = spark.sparkContext.broadcast(code)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Learner(code_sent.value, bits)
        for b in bounded(batches):
            h, _, row = tokens(*bytes_of(b.column(0)))
            state.learn(h, row)
        p = TaskContext.get().partitionId()
        for k, b, v in state.rows():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([p], pa.int32()), pa.array([v], pa.binary())], names=["k", "b", "p", "v"])

    # a block's tables are added up FAN at a time, so no task gathers more than FAN of them
    learnt, left, first_sum = train.select("text").mapInArrow(learn, "k int, b int, p int, v binary"), train.rdd.getNumPartitions(), True
    while left:
        learnt = learnt.withColumn("p", F.floor(F.col("p") / FAN).cast("int")).groupBy("k", "b", "p").applyInPandas(_sum_rows(first_sum), "k int, b int, p int, v binary")
        left, first_sum = 0 if left <= FAN else -(-left // FAN), False
    # the tables' size is bounded: VOCABULARY nodes and two times 2**MOST_BITS slots
    sent = spark.sparkContext.broadcast(Model.build(code, bits, ((r["k"], r["b"], bytes(r["v"])) for r in cut(learnt).toLocalIterator())))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        log_count = np.log10(m.code.count + 0.5) if len(m.code.count) else np.zeros(0)
        key = TaskContext.get().partitionId() << 33
        for b in bounded(batches):
            ids = b.column(0).to_pylist()
            n = len(ids)
            a, off = bytes_of(b.column(1))
            h, size, row = tokens(a, off)
            sym = m.code.symbols(h)
            tail = sym == len(m.code.count)
            path = np.bincount(row, weights=m.token_scores(h, row, sym), minlength=n)
            base = np.bincount(row[~tail], weights=log_count[sym[~tail]], minlength=n)
            bounds = np.searchsorted(row[tail], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(key, key + n)), b.column(0), pa.array([held_out(i) for i in ids]), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[~tail], minlength=n)), pa.array(np.diff(off)),
                pa.array(base), pa.array(path), pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[tail].view(np.int64))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(size[tail].astype(np.int32))),
            ], names=["key", "doc_id", "held_out", "n_tokens", "n_top", "n_bytes", "base", "path", "tail", "sizes"])
            key += n

    first = cut(rows.mapInArrow(score, "key long, doc_id long, held_out boolean, n_tokens long, n_top long, n_bytes long, base double, path double, tail array<long>, sizes array<int>"))
    spread = first.select("key", F.explode(F.arrays_zip("tail", "sizes")).alias("t")).select("key", F.col("t.tail").alias("h"), F.col("t.sizes").alias("size"))
    # what a text's tokens outside the vocabulary add, by parts of the table of counts
    found = spread.join(counts, "h", "left").groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.count("*").alias("n_tail"), F.count("c").alias("n_rare"), F.sum(F.when(F.col("c").isNull(), F.col("size") + 1).otherwise(0)).alias("spelt"))
    d = first.drop("tail", "sizes").join(found, "key", "left").na.fill(0, ["n_tail", "n_rare", "spelt"]).na.fill(0.0, ["logs"])
    share = float(np.log10(n_all + 0.5 * (v_all + 1)))
    d = d.withColumn("score", F.round(F.col("path") + F.col("logs") - F.col("n_tail") * F.lit(float(np.log10(rest))), 9))
    bits = -F.col("score") / F.lit(float(np.log10(2))) + 8 * F.col("spelt")
    return d.select("doc_id", "held_out", "n_tokens", (F.col("n_top") + F.col("n_rare")).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), F.round(F.col("base") + F.col("logs") - F.col("n_tokens") * share, 9).alias("base_score"), "score", F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_mixing": op4_mixing}
ORACLE: dict[str, str] = {}
