"""Exact nearest neighbours by cosine without a full scan: items lie in cells about centres, and cells that can't reach a
query's k-th score are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridix.operators.retrieval import Nearest, top_k
from veridix.session import written

#: Items of a block on average, cells at most, vectors on which centres are fitted, and queries that meet a block at once.
BLOCK_ITEMS, MOST_CELLS, SAMPLE, TOGETHER = 4096, 4096, 20_000, 1024
#: What rounding to six digits and double arithmetic may add to a cosine.
MARGIN = 1e-6
BLOCKS = "cell int, part int, ids array<long>, vectors binary"


class VectorIndex:
    """table: a row a block of items (see BLOCKS), unit vectors; by cell its centre, the angle to its farthest item, and its
    numbers of blocks and items."""

    def __init__(self, table: DataFrame, dim: int, centres: np.ndarray, radius: np.ndarray, blocks: np.ndarray, items: np.ndarray) -> None:
        self.table, self.dim, self.centres, self.radius, self.blocks, self.items = table, dim, centres, radius, blocks, items


def _own(df: DataFrame, key: str, dim: int | None = None) -> DataFrame:
    out = df.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("v")).where(f"{key} is not null and exists(v, x -> x <> 0) and forall(v, x -> x is not null and abs(x) < double('infinity'))")
    return out if dim is None else out.where(F.size("v") == dim)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    c = sample[:count].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1)
        c[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9, None]
    return c


def vector_index(items: DataFrame, block_items: int = BLOCK_ITEMS, sample: int = SAMPLE) -> VectorIndex | None:
    """items (item_id, embedding) -> the index, written to the shared folder; None where no item has a vector.

    Centres are fitted on the driver on at most `sample` items of smallest hash (32 MB at most), one for every
    block_items, up to MOST_CELLS; a cell of more items has several blocks, dealt by hash. Items without an id, and
    vectors that are null, of norm zero or hold null or non-finite components are left out; all others have one length,
    else it raises. Jobs that count, fit and write run at once."""
    own = written(_own(items, "item_id"))
    n, least, dim = own.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return None
    if least != dim:
        raise ValueError("vectors differ in length")
    count = max(1, min(MOST_CELLS, -(-n // block_items)))
    most = max(count, min(sample, (32 << 20) // (8 * dim)))
    h = F.shiftrightunsigned(F.xxhash64("item_id"), 1)
    some = own if n <= most else own.where(h < int((2**63 - 1) * min(1.0, 1.5 * most / n)))
    drawn = np.array([r["v"] for r in some.orderBy(h, "item_id").limit(most).select("v").collect()], np.float64)
    centres = _centres(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), count)
    sent = own.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _unit(b.column(1), dim) @ sent.value.T
            cell = s.argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.arccos(np.clip(s[np.arange(len(s)), cell], -1, 1))), *b.columns], names=["cell", "angle", "item_id", "v"])

    dealt = written(own.mapInArrow(assign, "cell int, angle double, item_id long, v array<double>"))
    radius, blocks, held = np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # MOST_CELLS at most
        radius[r["cell"]], held[r["cell"]], blocks[r["cell"]] = r["angle"], r["n"], -(-r["n"] // block_items)
    sizes = own.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "cell int, blocks int")
    dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int"))  # MOST_CELLS rows at most

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        v, ids = group.column("v").combine_chunks(), np.asarray(group.column("item_id").combine_chunks())
        o = np.argsort(ids, kind="stable")
        row = {"cell": key[0].as_py(), "part": key[1].as_py(), "ids": ids[o].tolist(), "vectors": _unit(v, dim)[o].tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())]))

    table = written(dealt.select("cell", "part", "item_id", "v").groupBy("cell", "part").applyInArrow(pack, BLOCKS))
    return VectorIndex(table, dim, centres, radius, blocks, held)


def _met(index: VectorIndex, routed: DataFrame, k: int) -> DataFrame:
    """routed (query_id, v, cell, part) -> query_id, item_id, score: each block's k best for the queries that come to it, which
    come TOGETHER at most on average."""
    sizes = routed.groupBy("cell", "part").agg(F.ceil(F.count("*") / TOGETHER).alias("n"))
    dealt = routed.join(sizes, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("n")))
    asked = dealt.groupBy("cell", "part", "block").agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(0)[i].values
                ids, x = np.asarray(b.column(1)[i].values), np.frombuffer(b.column(2)[i].as_py(), np.float64).reshape(-1, dim)
                q = _unit(own.field("v"), dim)
                nearest = Nearest(np.asarray(own.field("query_id")), q, k)
                nearest.meet(ids, x)
                yield from nearest.found()

    return index.table.join(asked, ["cell", "part"]).select("queries", "ids", "vectors").mapInArrow(run, "query_id long, item_id long, score double")


def routes(index: VectorIndex, queries: DataFrame, kth: DataFrame | None = None) -> DataFrame:
    """queries (query_id, v) -> query_id, v, cell, part: the blocks of the nearest cell; with kth (query_id, kth), those of
    every other cell that may hold an item of at least that cosine. An item lies no nearer to the query than the query's
    angle to the centre less the cell's largest."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.blocks))
    dim, second = index.dim, kth is not None
    asked = queries.join(kth, "query_id", "left").select("query_id", "v", "kth") if second else queries.select("query_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, blocks = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                angle = np.arccos(np.clip(_unit(b.column(1), dim) @ centres.T, -1, 1))
                angle[:, blocks == 0] = np.inf
                first = angle.argmin(1)
                go = np.zeros(angle.shape, bool)
                if second:
                    reach = np.asarray(b.column(2).fill_null(-2.0))
                    go = (np.cos(np.clip(angle - radius, 0, np.pi)) >= reach[:, None] - MARGIN) & (blocks > 0)
                go[np.arange(len(go)), first] = not second
                row, cell = np.nonzero(go)
                n = blocks[cell]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, cell = pa.array(np.repeat(row, n)), np.repeat(cell, n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(cell, pa.int32()), pa.array(part, pa.int32())], names=["query_id", "v", "cell", "part"])

    return asked.mapInArrow(run, "query_id long, v array<double>, cell int, part int")


def cosine_search(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """queries (query_id, embedding), query_id unique -> query_id, item_id, score, rank: as `retrieval.cosine_top_k` over all
    items. Queries first search the nearest cell's blocks, and with the k-th score found there (none where a cell has
    fewer than k) the others in reach; in both they meet the blocks in a join, many at once, however many there are."""
    asked = _own(queries, "query_id", index.dim)
    near = written(top_k(_met(index, routes(index, asked), k), k).drop("rank"))
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    return top_k(near.unionByName(_met(index, routes(index, asked, kth), k)), k)


def share_skipped(index: VectorIndex, queries: DataFrame, k: int) -> float:
    """The share of pairs of a query and an item that a search doesn't look at."""
    asked = _own(queries, "query_id", index.dim)
    kth = cosine_search(index, queries, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    looked = routes(index, asked).unionByName(routes(index, asked, kth)).where("part = 0")
    sizes = queries.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(index.items)], "cell int, items long")
    return 1 - (looked.join(F.broadcast(sizes), "cell").agg(F.sum("items")).first()[0] or 0) / max(1, asked.count() * int(index.items.sum()))
