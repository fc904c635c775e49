"""Exact top-k retrieval: by cosine over embeddings, by shared tokens over pages, or by a search that is called."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridix.functions.text import tokens
from veridix.session import written

#: Bytes of the queries that are broadcast at once, queries of a batch of results, and queries that meet items at once.
QUERY_BYTES, QUERY_BLOCK, MEETING = 64 << 20, 4096, 512
#: Cells of a block of items and words or queries, items of a range of the lexical index, and lists of it that are read at
#: once.
CELLS, RANGE_ITEMS, LISTS = 1 << 20, 8192, 1


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves up."""
    return np.floor(x * 1e6 + 0.5) / 1e6


class Nearest:
    """The k best items of each query, ties to the smaller item, carried from one block of items to the next. q holds the
    queries' unit vectors; it needs CELLS scores at a time, however many queries and items meet."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.items, self.scores = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)

    def meet(self, items: np.ndarray, x: np.ndarray) -> None:
        """items with their unit vectors, each item once in all."""
        for i in range(0, len(self.ids), MEETING):
            q = self.q[i : i + MEETING]
            step = max(1, CELLS // len(q))
            for j in range(0, len(items), step):
                self._take(i, items[j : j + step], np.round(q @ x[j : j + step].T, 6))

    def _take(self, at: int, items: np.ndarray, new: np.ndarray) -> None:
        k, held = self.k, slice(at, at + len(new))
        least = self.scores[held, -1]
        if new.shape[1] > k and np.isneginf(least).any():  # as many of these items alone reach their k-th score
            least = np.maximum(least, np.partition(new, -k, axis=1)[:, -k])
        row, col = np.nonzero(new >= least[:, None])
        if not len(row):
            return
        own, place = np.nonzero(~np.isneginf(self.scores[held]))
        rows = np.concatenate([own, row])
        items = np.concatenate([self.items[held][own, place], items[col]])
        scores = np.concatenate([self.scores[held][own, place], new[row, col]])
        o = np.lexsort((items, -scores, rows))
        rows = rows[o]
        rank = np.arange(len(o)) - np.searchsorted(rows, rows)
        o, rows, rank = o[rank < k], rows[rank < k], rank[rank < k]
        self.items[at + rows, rank], self.scores[at + rows, rank] = items[o], scores[o]

    def found(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), QUERY_BLOCK):
            row, place = np.nonzero(~np.isneginf(self.scores[i : i + QUERY_BLOCK]))
            row = row + i
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.items[row, place]), pa.array(self.scores[row, place])], names=["query_id", "item_id", "score"])


def vectors(column: pa.Array) -> np.ndarray:
    """A list column without null rows as a matrix; a null component is NaN."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and size.min() != size.max():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), int(size[0]) if len(size) else 0)


def query_blocks(queries: DataFrame, size: Column) -> Iterator[DataFrame]:
    """The queries in as many parts as their total size needs, QUERY_BYTES each on average."""
    total = queries.agg(F.sum(size)).first()[0] or 0
    parts = int(total // QUERY_BYTES) + 1
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)


def top_k(hits: DataFrame, k: int, query: str = "query_id", score: str = "score", item: str = "item_id") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """index (item_id, embedding), queries (query_id, embedding) -> query_id, item_id, score, rank.

    Queries go to every task, QUERY_BYTES of them at once, so a pass over the index serves all queries unless they are
    more. A task multiplies its part of the index with them, a block after another, and carries k a query; the tasks'
    winners meet in one window over at most tasks * k rows a query. Scores round to six digits, ties go to the smaller
    item_id. Null vectors and vectors of norm zero are left out.
    """
    spark = index.sparkSession
    own = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for part in query_blocks(own, F.size("embedding") * 8):
        rows = part.orderBy("query_id").toArrow().combine_chunks()
        q = vectors(rows["embedding"].combine_chunks()) if len(rows) else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            nearest = Nearest(*sent.value, k)
            for b in batches:
                x = vectors(b.column(1))
                if not len(x) or not len(nearest.ids):
                    continue
                norm = np.linalg.norm(x, axis=1)
                own = (norm > 0) & np.isfinite(norm)
                nearest.meet(np.asarray(b.column(0))[own], x[own] / norm[own, None])
            yield from nearest.found()

        got = index.where("item_id is not null and embedding is not null").select(F.col("item_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "query_id long, item_id long, score double")
        found = got if found is None else found.unionAll(got)
    return top_k(found, k)


RANGE = "items array<long>, sizes array<int>, words array<long>, first array<int>, posts array<int>, own array<int>"


def hashed_tokens(df: DataFrame, key: str) -> DataFrame:
    """key, t: the text's distinct tokens, hashed in the JVM; rows without a key are left out."""
    t = F.transform(F.array_distinct(tokens(F.col("text"))), lambda x: F.xxhash64(x))
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), t.alias("t"))


def lexical_index(items: DataFrame, most: int = RANGE_ITEMS) -> DataFrame:
    """items (item_id, text) -> an inverted index, one row per range of at most `most` items that a task has read (see
    RANGE): the items by rising size (number of distinct tokens), the words, each word's items from first[w] to
    first[w + 1], by rising size too, and each item's words. Items without tokens are left out; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                b = batch.slice(lo, most)
                size = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                o = np.argsort(size, kind="stable")
                o = o[size[o] > 0]
                if not len(o):
                    continue
                place = np.full(len(size), -1)
                place[o] = np.arange(len(o))
                words, number = np.unique(b.column(1).flatten().to_numpy(), return_inverse=True)
                key = np.sort(np.repeat(place, size) * len(words) + number)
                item, word = key // len(words), key % len(words)
                by_word = np.argsort(word, kind="stable")
                first = np.searchsorted(word[by_word], np.arange(len(words) + 1))
                columns = (np.asarray(b.column(0))[o], size[o].astype(np.int32), words, first.astype(np.int32), item[by_word].astype(np.int32), word.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns], names=[x.split()[0] for x in RANGE.split(", ")])

    return hashed_tokens(items, "item_id").mapInArrow(run, RANGE)


class Postings:
    """One range of the index, ready to be searched."""

    def __init__(self, b: pa.RecordBatch, i: int) -> None:
        self.items, self.sizes, self.words, self.first, self.posts, own = (np.asarray(b.column(c)[i].values).astype(np.int64) for c in range(6))
        self.key = np.repeat(np.arange(len(self.items)), self.sizes) * len(self.words) + own

    def search(self, words: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """best (items, scores, best first) of a query of distinct words with what this range has that is better.

        Lists are read by rising length, LISTS at once. An item that none of them has named shares at most the words that
        are left, so its size bounds its score: once a k-th score stands, only the sizes that can still reach it are
        read of a list, and nothing more when there is none. Where more entries are read than half of the items of those
        sizes that no list has named, these are taken themselves. An item that is met is scored in full by its own
        words. read[0] counts the entries read."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        mine = np.sort(at[self.words[at] == words])
        held = self.first[mine + 1] - self.first[mine]
        order = mine[np.argsort(held, kind="stable")]
        seen, here = np.zeros(len(self.items), bool), 0
        for j in range(0, len(order), LISTS):
            lo, hi = 0, len(self.items)
            if len(best[0]) == k:
                least = max(float(best[1][-1]) - 1e-6, 1e-9)  # scores are rounded to six digits
                lo = int(np.searchsorted(self.sizes, least * len(words) / (2 - least) - 1e-6))
                hi = int(np.searchsorted(self.sizes, 2 * (len(order) - j) / least - len(words) + 1e-6, side="right"))
                if lo >= hi:
                    break
            entries = []
            for w in order[j : j + LISTS].tolist():
                own = self.posts[self.first[w] : self.first[w + 1]]
                entries.append(own[np.searchsorted(own, lo) : np.searchsorted(own, hi)])
            new, unseen = np.concatenate(entries), lo + np.flatnonzero(~seen[lo:hi])
            here += len(new)
            last = here >= len(unseen) // 2
            if last:
                new = unseen
            if read is not None:
                read[0] += len(new)
            new = np.unique(new)
            new = new[~seen[new]]
            seen[new] = True
            step = max(1, CELLS // len(mine))
            for some in (new[i : i + step] for i in range(0, len(new), step)):
                key = some[:, None] * len(self.words) + mine
                shared = (self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] == key).sum(1)
                p, r = shared / self.sizes[some], shared / len(words)
                f1 = np.where(shared > 0, 2 * p * r / np.where(shared > 0, p + r, 1), 0)
                items, score = np.append(best[0], self.items[some]), np.append(best[1], rounded(f1))
                over = score > 0
                items, score = items[over], score[over]
                o = np.lexsort((items, -score))[:k]
                best = items[o], score[o]
            if last:
                break
        return best


def lexical_search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """index (lexical_index's, best as a table that is read again), queries (query_id, text) -> query_id, item_id, score
    (token-set F1), rank. QUERY_BYTES of queries at once go to every task, which searches its ranges one after another
    and hands each query's k best, so its k-th score, from range to range; the tasks' winners meet in one window over at
    most tasks * k rows a query. Items that share no token aren't found; equal scores by item_id."""
    spark = index.sparkSession
    own = hashed_tokens(queries, "query_id")
    found = None
    for part in query_blocks(own, F.size("t") * 8):
        rows = part.orderBy("query_id").toPandas()
        size = rows["t"].map(len).to_numpy(np.int64)
        flat = np.array([h for x in rows["t"] for h in x], np.int64)
        sent = spark.sparkContext.broadcast((rows["query_id"].to_numpy(np.int64), np.append(0, np.cumsum(size)).astype(np.int64), flat))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, first, flat = sent.value
            top = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
            for b in batches:
                for i in range(b.num_rows):
                    postings = Postings(b, i)
                    for q in range(len(ids)):
                        top[q] = postings.search(flat[first[q] : first[q + 1]], top[q], k)
            for lo in range(0, len(ids), QUERY_BLOCK):
                some = top[lo : lo + QUERY_BLOCK]
                query = np.repeat(ids[lo : lo + QUERY_BLOCK], [len(x[0]) for x in some])
                yield pa.RecordBatch.from_arrays([pa.array(query), *[pa.array(np.concatenate([x[c] for x in some])) for c in (0, 1)]], names=["query_id", "item_id", "score"])

        got = index.mapInArrow(run, "query_id long, item_id long, score double")
        found = got if found is None else found.unionAll(got)
    return top_k(found, k)


def lexical_top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """index (item_id, text), queries (query_id, text) -> as lexical_search, through an index that is written once."""
    return lexical_search(written(lexical_index(index)), queries, k)


# ---------------------------------------------------------------- searches that are called

Search = Callable[[object, int], list[dict]]
# Error texts that traces hold.
NOT_CONFIGURED = "search pipeline is not configured"
SEARCH_FAILED = "{source} search failed: {kind}: {error}"
GENERATION_FAILED = "generation failed: {kind}: {error}"


def with_retries(call: Callable[[], object], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> object:
    """What the call returns; after a failure it waits 1, 2, 4, ... seconds and tries again, `attempts` times in all."""
    if attempts <= 0:
        raise ValueError("attempts must be positive")
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(2**n)
    raise AssertionError


def unified_search(mode: str, image: Search | None = None, text: Search | None = None) -> Search:
    """One search over both sources: texts go to the web index, everything else to the image index. Mode `vision` has no
    source, `task1` the image index alone, `task2` both; asking a source that is off raises."""
    sources = {"vision": (None, None), "task1": (image, None), "task2": (image, text)}
    if mode not in sources:
        raise ValueError(f"unknown mode: {mode}")

    def search(value: object, k: int) -> list[dict]:
        at = sources[mode][isinstance(value, str)]
        if at is None:
            raise RuntimeError(NOT_CONFIGURED)
        return at(value, k)

    return search


def called_search(queries: DataFrame, search: Search, k: int, hit: str, source: str = "web") -> DataFrame:
    """queries (turn_id, value) -> turn_id, hits (array of `hit`, a struct type in DDL), error, search_status, search_ms: what
    the injected search returns; a search that fails gives no hits, the error and the status search_error."""
    kind = queries.schema["turn_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for turn, value in zip(pdf["turn_id"], pdf["value"], strict=True):
                began = time.perf_counter()
                try:
                    got = (list(search(value, k) or []), None, "ok")
                except Exception as e:  # noqa: BLE001  the record is the result
                    got = ([], SEARCH_FAILED.format(source=source, kind=type(e).__name__, error=e), "search_error")
                rows.append((turn, *got, (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(rows, columns=["turn_id", "hits", "error", "search_status", "search_ms"])

    return queries.select("turn_id", "value").mapInPandas(run, f"turn_id {kind}, hits array<{hit}>, error string, search_status string, search_ms double")


def fetched(urls: DataFrame, get: Callable[[str], bytes], attempts: int = 3) -> DataFrame:
    """urls (url) -> url, content, error: bytes by the injected get, each address once; a failure after the retries is
    an error row, as is content that is no picture (see is_image)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for url in pdf["url"]:
                try:
                    body = with_retries(lambda url=url: get(url), attempts)
                    rows.append((url, body, None) if is_image(body) else (url, None, "not an image"))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    return urls.where("url is not null").select("url").distinct().mapInPandas(run, "url string, content binary, error string")


# The first bytes of picture formats.
SIGNATURES = (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"BM", b"II*\x00", b"MM\x00*")


def is_image(body: bytes | None) -> bool:
    """Whether the bytes begin as a picture does."""
    return bool(body) and (body.startswith(SIGNATURES) or (body[:4] == b"RIFF" and body[8:12] == b"WEBP"))
