"""Operator 12: ranked lexical search by Fagin's threshold algorithm.

Documents are indexed in shards of bounded size: each shard holds its vocabulary and a forward index (the terms of a
document, in order). A search sorts the wanted terms' lists by impact and reads them in turn, a few entries of each at a
time; a document that is met for the first time has its whole score looked up in the forward index. It stops when the
threshold, the sum of the lists' last impacts, falls strictly below the k-th best score. The best so far are carried from
shard to shard of a task, so that later shards stop early, and the tasks' winners meet in one ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridix.llm.common import LOWER, TERM, bounded, bytes_of, cut, read_table, runs, settle

#: Bytes of text of one shard (a longer text is one alone), and of the items' terms that are searched at once.
SHARD_BYTES, ITEM_BYTES = 8 << 20, 32 << 20
#: Entries of each list that a round reads, and shards of a row group of the written index: what a reader decodes at once.
ROUND, GROUP_ROWS = 8, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SHARD = "shard long, n_docs long, n_terms long, vocabulary array<string>, df array<int>, doc_id array<long>, n array<int>, first array<int>, term array<int>, tf array<int>"


def _tokens(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts as one dictionary array, and the row of each."""
    a, off = bytes_of(column)
    low = LOWER[a]
    inside = TERM[low]
    starts, ends, row = runs(inside, off)
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    said = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(low[inside]))
    return said.dictionary_encode(), row


def index_documents(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (doc_id, text) -> the index, one row per shard (see SHARD): counts of documents and terms, the terms with the
    number of documents that hold each, and by document its id, its terms with repeats (n) and, from first[d] to
    first[d + 1], its different terms by number in the vocabulary with their counts.

    A task indexes what it reads, without a shuffle. Documents without terms (null texts too) are left out. Repeated
    rows are documents of their own; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in bounded(batches, shard_bytes):
            terms, row = _tokens(b.column(1))
            size = len(terms.dictionary)
            if not size:
                continue
            pairs, tf = np.unique(row * size + np.asarray(terms.indices), return_counts=True)
            owner, term = pairs // size, (pairs % size).astype(np.int32)
            n = np.bincount(row, minlength=b.num_rows)
            held = np.flatnonzero(n)
            first = np.append(np.searchsorted(owner, held), len(owner)).astype(np.int32)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
            columns = [pa.array([x], pa.int64()) for x in (number, len(held), int(n.sum()))]
            columns += [one(terms.dictionary.cast(pa.string())), one(np.bincount(term, minlength=size).astype(np.int32)), one(b.column(0).take(pa.array(held))), one(n[held].astype(np.int32)), one(first), one(term), one(tf.astype(np.int32))]
            number += 1
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SHARD.split(", ")])
        settle()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SHARD)


class Shard:
    """What a search of one shard needs of the wanted terms: their lists by falling impact and the forward index.

    The impact of a term in a document is its weight times c = (10^9 tf) div (1000 tf + 8 m)."""

    def __init__(self, b: pa.RecordBatch, i: int, terms: pa.Array, documents: int, length: int) -> None:
        col = {name: b.column(name)[i].values for name in ("vocabulary", "doc_id", "n", "first", "term", "tf")}
        term, tf, first = (np.asarray(col[x]).astype(np.int64) for x in ("term", "tf", "first"))
        local = pc.fill_null(pc.index_in(terms, value_set=col["vocabulary"]), -1).to_numpy(zero_copy_only=False)
        wanted = np.full(len(col["vocabulary"]), -1, np.int64)
        wanted[local[local >= 0]] = np.flatnonzero(local >= 0)
        named = np.asarray(col["doc_id"].is_valid())
        self.ids = pc.fill_null(col["doc_id"], 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        keep = (wanted[term] >= 0) & named[doc]
        doc, t, tf = doc[keep], wanted[term[keep]], tf[keep]
        m = 10 + (90 * np.asarray(col["n"]).astype(np.int64) * documents) // length
        c = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.size = len(terms)
        key = doc * self.size + t
        o = np.argsort(key, kind="stable")
        self.key, self.key_c = key[o], c[o]
        o = np.lexsort((doc, -c, t))
        self.list_doc, self.list_c = doc[o], c[o]
        self.bounds = np.searchsorted(t[o], np.arange(self.size + 1))

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores by random access to the forward index."""
        key = docs[:, None] * self.size + terms[None, :]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (np.where(self.key[at] == key, self.key_c[at], 0) * weights).sum(1)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """best (ids, scores, best first) with what this shard has that is better. read[0] counts the entries read."""
        lo, hi = self.bounds[terms], self.bounds[terms + 1]
        held = hi > lo
        lo, hi, terms, weights = lo[held], hi[held], terms[held], weights[held]
        seen, depth = np.zeros(len(self.ids), bool), 0
        while len(terms):
            more = lo + depth < hi
            last = self.list_c[np.minimum(lo + max(depth - 1, 0), hi - 1)]
            threshold = int((weights * np.where(more, last, 0)).sum())
            if not more.any() or (len(best[0]) == k and best[1][-1] > threshold):
                break
            a, n = lo + depth, np.clip(hi - lo - depth, 0, ROUND)
            entries = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
            new = np.unique(self.list_doc[entries])
            new = new[~seen[new]]
            seen[new] = True
            depth += ROUND
            if read is not None:
                read[0] += len(entries)
            if len(new):
                ids, score = np.append(best[0], self.ids[new]), np.append(best[1], self.scores(new, terms, weights))
                o = np.lexsort((ids, -score))[:k]
                best = ids[o], score[o]
        return best


def _weighed(index: DataFrame, items: DataFrame, documents: int) -> DataFrame:
    """item_id, terms: array of (term, weight over 0); items of one id are one item with the terms of all."""
    said = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, UPPER.lower()), F.lit(PATTERN), F.lit(0))
    asked = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(said).alias("term")).distinct()
    counts = index.select(F.explode(F.arrays_zip("vocabulary", "df")).alias("x")).select(F.col("x.vocabulary").alias("term"), F.col("x.df").alias("df"))
    counts = counts.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    w = asked.join(counts.select("term", weight.alias("weight")).where("weight > 0"), "term")
    return w.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))


def search_index(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """index (see SHARD), items (item_id, text) -> item_id, rank (from 1), doc_id, score: each item's k documents with the
    highest score over 0, all if they are fewer, equal scores by ascending doc_id.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))); counts are over all documents. Items are searched ITEM_BYTES of
    their terms at a time, each time in one pass of the index; a task keeps k an item. Null item ids, and items without
    a term that any document holds, have no rows. Documents with a null id count but aren't ranked. Two jobs run while
    the plan is built: one counts documents and terms, one reads the items' weights.
    """
    spark = index.sparkSession
    documents, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weighed = cut(_weighed(index, items, documents))
    size: Column = F.expr("aggregate(terms, 0L, (s, x) -> s + octet_length(x.term) + 16)")
    parts = int((weighed.agg(F.sum(size)).first()[0] or 0) // ITEM_BYTES) + 1
    found = None
    for part in range(parts):
        ids, first, words, weight = [], [0], [], []
        for r in weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").toLocalIterator():
            ids.append(r["item_id"])
            words += [x["term"] for x in r["terms"]]
            weight += [x["weight"] for x in r["terms"]]
            first.append(len(words))
        known, number = np.unique(np.array(words, object), return_inverse=True) if words else (np.zeros(0, object), np.zeros(0, np.int64))
        sent = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(first), number, np.array(weight, np.int64), list(known)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, first, number, weight, known = sent.value
            terms = pa.array(known, pa.string())
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
            for b in batches:
                for i in range(b.num_rows):
                    shard = Shard(b, i, terms, documents, length)
                    for j in range(len(ids)):
                        s = slice(first[j], first[j + 1])
                        best[j] = shard.search(number[s], weight[s], best[j], k)
            for lo in range(0, len(ids), 4096):
                some = best[lo : lo + 4096]
                item = np.repeat(ids[lo : lo + 4096], [len(x[0]) for x in some])
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([x[0] for x in some])), pa.array(np.concatenate([x[1] for x in some]))], names=["item_id", "doc_id", "score"])
            settle()

        got = index.drop("shard", "df", "n_docs", "n_terms").mapInArrow(run, "item_id long, doc_id long, score long")
        found = got if found is None else found.unionAll(got)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """index_documents, written to the shared folder, and search_index."""
    return search_index(cut(index_documents(docs), GROUP_ROWS), items, k)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical": op12_lexical}
_TERMS = rf"unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{PATTERN}'))"
ORACLE: dict[str, str] = {
    "op12_lexical": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
tok AS (SELECT r, doc_id, {_TERMS} AS term FROM d),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
tot AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM len),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term, nd),
s AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
      FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN len USING (r), tot GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10"""
}
