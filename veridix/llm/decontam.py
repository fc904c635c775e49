"""Operator 10: benchmark decontamination by BM25 with block-max WAND.

An inverted index of the test items (long ones in segments) is searched with every training passage as the query:
overlapping windows over the whole document. Everything that scores over its segment's threshold is retrieved and
then verified: the question's and the answer's own word trigrams must stand in the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import LOWER, TERM, bounded, bytes_of, hash_bytes, mix64, prefix_sums, read_table, runs, settle, span_hash

#: Passage and step in terms; segments are at most the overlap, so each leak of a segment lies in a passage whole.
PASSAGE, OVERLAP = 128, 64
#: Retrieved: passages with at least this part of the score that the segment has against itself.
THRESHOLD = 0.6
#: Verified: at least this part of the question's and of the answer's trigrams.
OVERLAPS = 0.7
K1, B = 1.2, 0.75
#: Segments of one posting block.
BLOCK = 8
#: Cells of the dense table of block maxima; a larger index goes without and leaves the same test to the lists.
DENSE = 1 << 22
#: Bytes of item text in one index; more items are searched in several indexes, one after another.
INDEX_BYTES = 32 << 20
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII bytes, A-Z in lower case."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence, the question what stands before it; one sentence is halved."""
    parts = [t for t in map(terms, re.split(r"(?<=[.?!])\s+|\n", text)) if t]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    return words[: len(words) // 2], words[len(words) // 2 :]


def grams(h: np.ndarray, k: int = 3) -> np.ndarray:
    """Hashes of the runs of k terms."""
    if len(h) < k or not k:
        return h[:0]
    out = h[: len(h) - k + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = mix64(out * np.uint64(31) + h[i : len(h) - k + 1 + i])
    return out


@dataclass
class Index:
    """Postings by term over segments in rising order of threshold, in blocks with their largest contributions."""

    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted term hashes
    essential: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    postings: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # segments, contributions
    block_max: list[dict[int, float]] = field(default_factory=list)
    dense: np.ndarray | None = None  # the same as a table of terms and blocks, and each block's lowest threshold
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    question: list[np.ndarray] = field(default_factory=list)  # the segment's term hashes
    answer: list[np.ndarray] = field(default_factory=list)


def build_index(items: list[tuple[int, str | None]], passage: int = PASSAGE, overlap: int = OVERLAP, threshold: float = THRESHOLD) -> Index:
    """Items without terms can't be found and are left out. Question and answer are judged per segment of an item:
    a segment that holds no part of one of them is verified by the other alone."""
    segments = []
    for item, text in items:
        q, a = question_and_answer(text or "")
        words = q + a
        n = len(words)
        for s in range(0, n, overlap):
            part = words[s : s + overlap]
            if n > overlap and len(part) < overlap:
                s = n - overlap
                part = words[s:]
            segments.append((item, part, max(0, min(len(part), len(q) - s))))
    if not segments:
        return Index()
    df: dict[bytes, int] = {}
    for _, part, _ in segments:
        for t in set(part):
            df[t] = df.get(t, 0) + 1
    n, mean = len(segments), sum(len(p) for _, p, _ in segments) / len(segments)
    weights = []
    for _, part, _ in segments:
        tf: dict[bytes, int] = {}
        for t in part:
            tf[t] = tf.get(t, 0) + 1
        norm = K1 * (1 - B + B * len(part) / mean)
        weights.append({t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()})
    order = sorted(range(n), key=lambda i: (threshold * sum(weights[i].values()), segments[i][0], i))
    words = sorted(df)
    h = hash_bytes(words)
    rank = np.argsort(h)
    number = {words[r]: i for i, r in enumerate(rank.tolist())}
    out = Index(vocabulary=h[rank], essential=np.zeros(len(words), bool))
    posts: list[list[tuple[int, float]]] = [[] for _ in words]
    out.item = np.array([segments[i][0] for i in order], np.int64)
    out.threshold = np.array([threshold * sum(weights[i].values()) * (1 - 1e-9) for i in order])
    out.size = np.array([len(segments[i][1]) for i in order], np.int64)
    for seg, i in enumerate(order):
        left = sum(weights[i].values())
        for t, w in sorted(weights[i].items(), key=lambda x: (-x[1], x[0])):
            # without its essential terms a segment can't reach its threshold
            if left >= out.threshold[seg]:
                out.essential[number[t]] = True
            left -= w
            posts[number[t]].append((seg, w))
        _, part, cut = segments[i]
        both = hash_bytes(part)
        out.question.append(both[:cut])
        out.answer.append(both[cut:])
    for p in posts:
        seg = np.array([x[0] for x in p], np.int64)
        val = np.array([x[1] for x in p])
        out.postings.append((seg, val))
        top: dict[int, float] = {}
        for s, v in p:
            top[s // BLOCK] = max(top.get(s // BLOCK, 0.0), v)
        out.block_max.append(top)
    out.least = out.threshold[::BLOCK]
    if len(words) * len(out.least) <= DENSE:
        out.dense = np.zeros((len(words), len(out.least)))
        for t, top in enumerate(out.block_max):
            for b, v in top.items():
                out.dense[t, b] = v
    return out


def hopeful(index: Index, queries: list[np.ndarray]) -> list[list[int]]:
    """Per query (distinct term numbers) the blocks whose sum of block maxima reaches their lowest threshold."""
    if index.dense is not None and queries:
        bounds = np.append(0, np.cumsum([len(q) for q in queries]))
        ok = np.add.reduceat(index.dense[np.concatenate(queries)], bounds[:-1], axis=0) >= index.least * (1 - 1e-12)
        return [np.flatnonzero(x).tolist() for x in ok]
    out = []
    for q in queries:
        sums: dict[int, float] = {}
        for t in q.tolist():
            for b, v in index.block_max[t].items():
                sums[b] = sums.get(b, 0.0) + v
        out.append(sorted(b for b, v in sums.items() if v >= index.least[b] * (1 - 1e-12)))
    return out


def wand(index: Index, query: np.ndarray, blocks: list[int] | None = None) -> list[tuple[int, float]]:
    """(segment, score) of all segments that the query (distinct term numbers) scores over their thresholds.

    Blocks whose maxima can't reach a threshold are skipped (see hopeful). Within a block, lists are met by rising
    segment number and a segment is scored when the maxima of the lists that stand at or before it reach its
    threshold.
    """
    found = []
    for b in hopeful(index, [query])[0] if blocks is None else blocks:
        first = b * BLOCK
        cursors = []
        for t in query.tolist():
            if b in index.block_max[t]:
                seg, val = index.postings[t]
                lo, hi = np.searchsorted(seg, (first, first + BLOCK))
                cursors.append([seg[lo:hi].tolist(), val[lo:hi].tolist(), 0, index.block_max[t][b]])
        while cursors:
            cursors.sort(key=lambda c: c[0][c[2]])
            upper, pivot = 0.0, None
            least = index.threshold[cursors[0][0][cursors[0][2]]]  # thresholds rise with the number
            for c in cursors:
                upper += c[3]
                if upper >= least:
                    pivot = c[0][c[2]]
                    break
            if pivot is None:
                break
            if cursors[0][0][cursors[0][2]] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0][c[2]] == pivot:
                        score += c[1][c[2]]
                        c[2] += 1
                if score >= index.threshold[pivot]:
                    found.append((pivot, score))
            else:
                for c in cursors:
                    while c[2] < len(c[0]) and c[0][c[2]] < pivot:
                        c[2] += 1
            cursors = [c for c in cursors if c[2] < len(c[0])]
    return found


def _share(part: np.ndarray, passage: np.ndarray) -> float | None:
    """The part of the trigrams (of fewer terms: of the whole) that the passage holds."""
    k = min(3, len(part))
    return float(np.isin(np.unique(grams(part, k)), grams(passage, k)).mean()) if k else None


def search(index: Index, h: np.ndarray, passage: int = PASSAGE, overlap: int = OVERLAP, overlaps: float = OVERLAPS) -> dict[int, tuple[float, float | None, float | None, int]]:
    """One document's term hashes -> item: (score, question share, answer share, first term of the passage)."""
    out: dict[int, tuple[float, float | None, float | None, int]] = {}
    if not len(index.vocabulary) or not len(h):
        return out
    at = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    known = index.vocabulary[at] == h
    spots = np.flatnonzero(known & index.essential[at])
    step = passage - overlap
    last = max(0, -(-(len(h) - passage) // step))
    starts = np.unique(np.concatenate([np.minimum(spots // step, last), np.minimum(np.maximum(spots // step - 1, 0), last)])) * step
    queries = [np.unique(at[s : s + passage][known[s : s + passage]]) for s in starts.tolist()]
    for s, own, blocks in zip(starts.tolist(), queries, hopeful(index, queries), strict=True):
        hits = wand(index, own, blocks)
        if not hits:
            continue
        # the passage's neighbours may hold the ends of what it cuts
        near = h[max(0, s - overlap) : s + passage + overlap]
        for seg, score in hits:
            q, a = _share(index.question[seg], near), _share(index.answer[seg], near)
            if min(x for x in (q, a) if x is not None) >= overlaps:
                item = int(index.item[seg])
                if item not in out or score > out[item][0]:
                    out[item] = (score, q, a, s)
    return out


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"


def find_leaks(docs: DataFrame, items: DataFrame, overlaps: float = OVERLAPS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> one row per document and item that it leaks (see SCHEMA): the
    best passage's BM25 score, the shares of the question's and answer's trigrams in it (null where a segment has
    none) and the passage's first term.

    Whole texts are searched. Null and empty texts and items have no rows; repeated rows give repeated rows; other
    columns are ignored. The items are read in runs of at most INDEX_BYTES; each run's index is broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // INDEX_BYTES) + 1
    out = None
    for k in range(count):
        part = [(r["item_id"], r["text"]) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").toLocalIterator()]
        sent = spark.sparkContext.broadcast(build_index(part))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in bounded(batches):
                a, off = bytes_of(b.column(1))
                low = LOWER[a]
                starts, ends, row = runs(TERM[low], off)
                h = span_hash(prefix_sums(low), starts, ends)
                bounds = np.searchsorted(row, np.arange(len(off)))
                rows = []
                for i, doc in enumerate(b.column(0).to_pylist()):
                    for item, (score, q, ans, s) in sorted(search(index, h[bounds[i] : bounds[i + 1]], overlaps=overlaps).items()):
                        rows.append((doc, item, score, q, ans, s))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            settle()

        found = texts.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE: dict[str, str] = {}
