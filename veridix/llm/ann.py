"""Operator 13: approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt to cells about centres (fitted on a bounded sample) and cells to shards of bounded size. Each shard's
graph is a row of flat arrays: nodes stand by falling level, so the nodes of a level are a prefix, and a level's
neighbours are one array of fixed width. A query searches the shards of its nearest cell, and then those of every cell
that the triangle inequality on angles doesn't rule out; the shards' results are merged. Only the search within a shard
is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridix.llm.common import bounded, cut, mix64, read_table, settle

#: Links of a node at the upper levels; twice as many at the lowest.
LINKS = 16
#: Candidates kept while a node is linked, and while a query is searched.
EF_BUILD, EF_SEARCH = 96, 128
#: Nodes of a shard on average; cells at most (a larger cell has more shards); vectors on which the centres are fitted.
SHARD_ROWS, CELLS, SAMPLE = 2048, 4096, 20_000
#: Nodes that are linked at once, queries of one search, and nodes of a beam that are expanded at once.
BLOCK, TOGETHER, EXPAND = 256, 512, 4
#: Entries that an upper level hands on, and nodes of an upper level that is looked through whole.
ENTRIES, WHOLE = 32, 1024
#: Rounding that a bound allows for, in radians.
SLACK = 1e-6

Graph = list[np.ndarray]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; first divided by their largest component, so no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows (last axis) in double precision."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (x * y).sum(-1) / (np.sqrt((x * x).sum(-1)) * np.sqrt((y * y).sum(-1)))
    odd = ~np.isfinite(out)
    if odd.any():  # squares out of range
        a, b = np.broadcast_to(x, out.shape + x.shape[-1:])[odd], np.broadcast_to(y, out.shape + y.shape[-1:])[odd]
        out[odd] = (unit(a) * unit(b)).sum(-1)
    return out


# ---------------------------------------------------------------- one graph


def beam(vec: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nodes nearest to each query that a best-first walk from the entries finds: numbers (-1: none) and
    similarities, nearest first. near: the neighbours of each node, -1 in empty places. A query is done when all of its
    ef best are expanded; all queries walk at once, EXPAND nodes a step."""
    n_q, ef = len(q), max(ef, entry.shape[1])
    seen = np.zeros((n_q, len(vec) + 1), bool)
    row = np.arange(n_q)[:, None]
    ids = entry.astype(np.int64)
    sim = np.where(ids >= 0, np.einsum("qed,qd->qe", vec[ids], q), -np.inf)
    seen[row, ids] = True
    pad = max(0, ef - ids.shape[1])
    ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
    sim = np.pad(sim, ((0, 0), (0, pad)), constant_values=-np.inf)
    done = ids < 0
    active = np.arange(n_q)
    while len(active):
        score = np.where(done[active], -np.inf, sim[active])
        pick = np.argpartition(-score, EXPAND - 1, axis=1)[:, :EXPAND] if score.shape[1] > EXPAND else np.tile(np.arange(score.shape[1]), (len(active), 1))
        live = np.take_along_axis(score, pick, 1) > -np.inf
        some = live.any(1)
        active, pick, live = active[some], pick[some], live[some]
        if not len(active):
            break
        at = active[:, None]
        node = np.where(live, ids[at, pick], -1)
        done[at, pick] = True
        new = np.where((node >= 0)[:, :, None], near[node], -1).reshape(len(active), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[at, new]] = -1
        seen[at, new] = True
        seen[:, -1] = False
        s = np.where(new >= 0, np.einsum("qed,qd->qe", vec[new], q[active]), -np.inf)
        all_sim, all_ids = np.concatenate([sim[active], s], 1), np.concatenate([ids[active], new], 1)
        all_done = np.concatenate([done[active], new < 0], 1)
        keep = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
        sim[active], ids[active], done[active] = (np.take_along_axis(x, keep, 1) for x in (all_sim, all_ids, all_done))
        done[active] |= sim[active] == -np.inf
    o = np.argsort(-sim, axis=1, kind="stable")
    return np.where(np.take_along_axis(sim, o, 1) > -np.inf, np.take_along_axis(ids, o, 1), -1), np.take_along_axis(sim, o, 1)


def diverse(vec: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) at most `most`, nearest first. Three quarters are those that are
    nearer to the row's own vector than to any chosen before, and then the nearest of the rest; the last quarter is
    spread evenly over what is left to the farthest, so that tight groups of vectors keep links to the outside."""
    rows, width = ids.shape
    if width <= most:
        return np.pad(ids, ((0, 0), (0, most - width)), constant_values=-1)
    v = vec[ids]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((rows, width), bool)
    closest = np.full((rows, width), -np.inf)  # to a chosen candidate
    count = np.zeros(rows, np.int64)
    spare = most // 4
    for j in range(width):
        ok = (ids[:, j] >= 0) & (sim[:, j] >= closest[:, j]) & (count < most - spare)
        chosen[:, j] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, j]), closest)
    order = np.argsort(np.where(ids >= 0, np.where(chosen, 0, 1), 2), axis=1, kind="stable")
    left = np.maximum((ids >= 0).sum(1) - (most - spare), 0)[:, None]
    spread = np.where(left > spare, (np.arange(1, spare + 1) * left) // spare - 1, np.arange(spare))
    order = np.concatenate([order[:, : most - spare], np.take_along_axis(order, np.minimum(most - spare + spread, width - 1), 1)], 1)
    order.sort(axis=1)
    return np.take_along_axis(ids, order, 1)


def link(vec: np.ndarray, near: np.ndarray, first: int, last: int, entry: np.ndarray) -> None:
    """Nodes first to last into one level: candidates from a walk over the nodes before them and from each other, links
    to a diverse choice of them, and links back, which are chosen anew where a node has too many."""
    most = near.shape[1]
    q = vec[first:last]
    sim = q @ q.T
    np.fill_diagonal(sim, -np.inf)
    mates = np.argsort(-sim, axis=1, kind="stable")[:, :EF_BUILD]
    ids, score = first + mates, np.take_along_axis(sim, mates, 1)
    if first:
        found, s = beam(vec[:first], near[:first], q, entry, min(EF_BUILD, first))
        ids, score = np.concatenate([ids, found], 1), np.concatenate([score, s], 1)
    o = np.argsort(-score, axis=1, kind="stable")[:, :EF_BUILD]
    ids, score = np.take_along_axis(ids, o, 1), np.take_along_axis(score, o, 1)
    ids[score == -np.inf] = -1
    near[first:last] = own = diverse(vec, ids, score, most)
    # back: every linked node with its own links and the new ones
    source = np.repeat(np.arange(first, last), most)
    target = own.ravel()
    source, target = source[target >= 0], target[target >= 0]
    o = np.argsort(target, kind="stable")
    source, target = source[o], target[o]
    nodes, start, n = np.unique(target, return_index=True, return_counts=True)
    width = int(n.max()) if len(n) else 0
    wide = np.full((len(nodes), most + width), -1)
    wide[:, :most] = near[nodes]
    wide[np.repeat(np.arange(len(nodes)), n), most + np.arange(len(target)) - np.repeat(start, n)] = source
    for lo in range(0, len(nodes), BLOCK):
        part, own = wide[lo : lo + BLOCK], nodes[lo : lo + BLOCK]
        part = np.sort(part, axis=1)
        part[:, 1:][part[:, 1:] == part[:, :-1]] = -1
        s = np.where(part >= 0, np.einsum("qed,qd->qe", vec[part], vec[own]), -np.inf)
        o = np.argsort(-s, axis=1, kind="stable")[:, : 2 * most]
        near[own] = diverse(vec, np.where(np.take_along_axis(s, o, 1) > -np.inf, np.take_along_axis(part, o, 1), -1), np.take_along_axis(s, o, 1), most)


def descend(vec: np.ndarray, graph: Graph, level: int, q: np.ndarray) -> np.ndarray:
    """Entries for a level: the nodes to which a walk through the levels above comes, and node 0. A level of at most WHOLE
    nodes is looked through instead, and those above it aren't needed."""
    zero = entry = np.zeros((len(q), 1), np.int64)
    upper = graph[level + 1 :]
    small = next((k for k, near in enumerate(upper) if len(near) <= WHOLE), len(upper))
    for near in reversed(upper[: small + 1]):
        k = min(ENTRIES, len(near))
        found = np.argpartition(-(q @ vec[: len(near)].T), k - 1, axis=1)[:, :k] if len(near) <= WHOLE else beam(vec[: len(near)], near, q, entry, k)[0][:, :k]
        entry = np.concatenate([zero, np.where(found > 0, found, -1)], 1)
    return entry


def build(vec: np.ndarray, links: int = LINKS) -> Graph:
    """The graph of vectors of length one, lowest level first: neighbours by node. A node's level falls geometrically
    with its number. Every node can be reached from node 0 in the lowest level."""
    n = len(vec)
    sizes = [n]
    while sizes[-1] > links:
        sizes.append(sizes[-1] // links)
    graph: Graph = [np.full((s, links * (1 if k else 2)), -1) for k, s in enumerate(sizes)]
    for level in range(len(sizes) - 1, -1, -1):
        near, size = graph[level], sizes[level]
        at = 0
        while at < size:
            to = min(size, at + min(BLOCK, max(at, 2 * links)))
            entry = descend(vec, graph, level, vec[at:to])
            link(vec, near, at, to, np.where(entry < at, entry, -1))
            at = to
    graph[0] = connected(vec, graph[0])
    return graph


def connected(vec: np.ndarray, near: np.ndarray) -> np.ndarray:
    """near with a further link to each group of nodes that node 0 doesn't reach, from the nearest node that it does."""
    while True:
        reached = np.zeros(len(near), bool)
        front = np.zeros(1, np.int64)
        while len(front):
            reached[front] = True
            front = np.unique(near[front])
            front = front[(front >= 0) & ~reached[front]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return near
        node = lost[0]
        to = np.flatnonzero(reached)
        to = to[np.argmax(vec[to] @ vec[node])]
        free = np.flatnonzero(near[to] < 0)
        if not len(free):
            near, free = np.pad(near, ((0, 0), (0, 1)), constant_values=-1), [near.shape[1]]
        near[to, free[0]] = node


# ---------------------------------------------------------------- the index

INDEX = "cell int, part int, n int, dim int, copies int, ids binary, vectors binary, widths array<int>, sizes array<int>, neighbours array<binary>"


def usable(df: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id, v (array of doubles): rows with an id and a vector of `dim` finite components that aren't all zero."""
    v = F.col("embedding").cast("array<double>")
    ok = "vec_id is not null and v is not null and exists(v, x -> x <> 0) and forall(v, x -> x is not null and x = x and abs(x) < double('infinity'))"
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(ok)
    return out if dim is None else out.where(F.size("v") == dim)


def dimension(df: DataFrame) -> int | None:
    """The most frequent length of the usable vectors (the larger of equally frequent ones)."""
    row = usable(df).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else None


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """h, v, ids: the different vectors, each with the smallest `copies` of its ids, in order."""
    named = rows.withColumn("h", F.xxhash64("v")).dropDuplicates(["vec_id", "h", "v"])
    n = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    return named.withColumn("n", n).where(F.col("n") <= copies).groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fit_centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; starts from the sample's first rows."""
    c = sample[:count].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i : i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1)
        c[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9, None]
    return c


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


class Index:
    """A built index: its table (see INDEX), the cells' centres, angles to their farthest vector, and numbers of shards."""

    def __init__(self, table: DataFrame, dim: int, copies: int, centres: np.ndarray, radius: np.ndarray, parts: np.ndarray) -> None:
        self.table, self.dim, self.copies, self.centres, self.radius, self.parts = table, dim, copies, centres, radius, parts


def build_index(vectors: DataFrame, copies: int = 6, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> Index | None:
    """vectors (vec_id, embedding) -> an index whose table lies in the shared folder; None if no row is usable.

    Equal vectors are one node that carries the smallest `copies` of its ids: a search for k neighbours by ties to
    smaller ids needs no more than k + 1. Centres are fitted on the driver on about `sample` vectors (32 MB at most) of
    smallest hash; there is one for every shard_rows vectors, up to CELLS. Cells are dealt to shards by hash, so that a
    shard has about shard_rows vectors however many lie in one cell. Vectors that are null, zero, hold null or
    non-finite components, or are not of the most frequent length take no part; nor do rows without an id. Repeated rows
    count once; an id may have several vectors. Other columns are ignored.
    """
    dim = dimension(vectors)
    if not dim:
        return None
    nodes = cut(distinct_vectors(usable(vectors, dim), copies))
    n = nodes.count()
    count = max(1, min(CELLS, -(-n // shard_rows)))
    sample = max(count, min(sample, (32 << 20) // (8 * dim)))
    share = nodes if n <= sample else nodes.where(F.shiftrightunsigned("h", 1) < int((2**63 - 1) * min(1.0, 1.5 * sample / n)))
    drawn = share.orderBy(F.shiftrightunsigned("h", 1), "v").limit(sample).select("v").collect()
    centres = fit_centres(unit(np.array([r["v"] for r in drawn], np.float64)), count)
    sent = nodes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = unit(_matrix(b.column(1), dim)) @ sent.value.T if b.num_rows else np.zeros((0, 1))
            cell = s.argmax(1) if len(s) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(s[np.arange(len(s)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), *b.columns], names=["cell", "angle", "h", "v", "ids"])

    dealt = cut(nodes.select("h", "v", "ids").mapInArrow(assign, "cell int, angle double, h long, v array<double>, ids array<long>"))
    radius, parts = np.zeros(count), np.zeros(count, np.int64)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # CELLS at most
        radius[r["cell"]], parts[r["cell"]] = r["angle"], -(-r["n"] // shard_rows)
    per_cell = F.array(*[F.lit(int(p)) for p in parts]) if count <= 64 else None
    if per_cell is None:
        table = nodes.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "cell int, parts int")
        dealt = dealt.join(F.broadcast(table), "cell")  # CELLS rows at most
    else:
        dealt = dealt.withColumn("parts", per_cell[F.col("cell")])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))

    def shard(key: tuple, group: pa.Table) -> pa.Table:
        h = np.asarray(group.column("h").combine_chunks()).astype(np.uint64)
        o = np.lexsort((h, mix64(h)))
        v = _matrix(group.column("v").combine_chunks(), dim)[o]
        ids = np.full((len(v), copies), -1, np.int64)
        lists = group.column("ids").combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        ids[np.repeat(np.arange(len(v)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
        graph = build(unit(v))
        row = {"cell": key[0].as_py(), "part": key[1].as_py(), "n": len(v), "dim": dim, "copies": copies, "ids": ids[o].tobytes(), "vectors": v.tobytes(), "widths": [g.shape[1] for g in graph], "sizes": [len(g) for g in graph], "neighbours": [g.astype(np.int32).tobytes() for g in graph]}
        settle()
        return pa.Table.from_pylist([row], schema=pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("copies", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("widths", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("neighbours", pa.list_(pa.binary()))]))

    built = dealt.select("cell", "part", "h", "v", "ids").groupBy("cell", "part").applyInArrow(shard, INDEX)
    return Index(cut(built), dim, copies, centres, radius, parts)


FOUND = "query_id long, vec_id long, score double"


def _search_shards(index: Index, routed: DataFrame, k: int, ef: int) -> DataFrame:
    """routed (query_id, v, cell, part) -> FOUND: k + 1 nodes of the shard a query. Queries meet a shard in blocks of about
    TOGETHER, so that neither a task's queries nor its copies of a shard grow with the input."""
    sizes = routed.groupBy("cell", "part").agg(F.ceil(F.count("*") / TOGETHER).alias("blocks"))
    dealt = routed.join(sizes, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")))
    held = dealt.groupBy("cell", "part", "block").agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
    dim, copies = index.dim, index.copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 32 << 20):
            for i in range(b.num_rows):
                r = {name: b.column(name)[i] for name in b.schema.names}
                asked = r["queries"].values
                own = np.asarray(asked.field("query_id"))
                q = _matrix(asked.field("v"), dim)
                v = np.frombuffer(r["vectors"].as_py(), np.float64).reshape(-1, dim)
                ids = np.frombuffer(r["ids"].as_py(), np.int64).reshape(-1, copies)
                graph = [np.frombuffer(x.as_py(), np.int32).reshape(-1, w).astype(np.int64) for x, w in zip(r["neighbours"], r["widths"].as_py(), strict=True)]
                vec, uq = unit(v), unit(q)
                near = beam(vec, graph[0], uq, descend(vec, graph, 0, uq), min(ef, len(v)))[0]
                for lo in range(0, len(q), 64):
                    some = near[lo : lo + 64]
                    score = np.where(some >= 0, cosines(v[some], q[lo : lo + 64, None]), -np.inf)
                    o = np.lexsort((np.where(some >= 0, ids[some, 0], np.iinfo(np.int64).max), -score), axis=1)[:, : k + 1]
                    some, score = np.take_along_axis(some, o, 1), np.take_along_axis(score, o, 1)
                    vec_id = ids[some]
                    ok = (some >= 0)[:, :, None] & (vec_id >= 0) & (vec_id != own[lo : lo + 64, None, None])
                    full = lambda x, to=vec_id.shape: np.broadcast_to(x, to)
                    yield pa.RecordBatch.from_arrays([pa.array(full(own[lo : lo + 64, None, None])[ok]), pa.array(vec_id[ok]), pa.array(full(score[:, :, None])[ok])], names=["query_id", "vec_id", "score"])
        settle()

    return index.table.join(held, ["cell", "part"]).select("queries", "ids", "vectors", "widths", "neighbours").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_index(index: Index, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH) -> DataFrame:
    """queries (vec_id, embedding) -> query_id, rank (from 1), vec_id, score: the k nearest other ids by cosine, ties to
    the smaller id; all if they are fewer. k may be copies - 1 at most.

    The first round searches each query's nearest cell; the second every other cell that can hold a vector nearer than
    the k-th found, by the angle to its centre less the angle to its farthest vector. Queries that are not usable (see
    build_index) have no rows; an id with several vectors is one query, nearest to any of them.
    """
    if k >= index.copies:
        raise ValueError("the index carries too few ids of a vector for so many neighbours")
    dim = index.dim
    sent = index.table.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.parts))
    asked = usable(queries, dim).dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, parts = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                angle = np.arccos(np.clip(unit(_matrix(s.column(1), dim)) @ centres.T, -1, 1))
                angle[:, parts == 0] = np.inf
                first = angle.argmin(1)
                go = np.zeros(angle.shape, bool)
                if s.num_columns > 2:  # the second round: all others that are in reach
                    reach = np.arccos(np.clip(np.asarray(s.column(2).fill_null(-1.0)), -1, 1))
                    go = (angle - radius <= reach[:, None] + SLACK) & (parts > 0)
                    go[np.arange(len(go)), first] = False
                else:
                    go[np.arange(len(go)), first] = True
                row, cell = np.nonzero(go)
                n = parts[cell]
                row, cell, part = np.repeat(row, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(row)), s.column(1).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(part, pa.int32())], names=["query_id", "v", "cell", "part"])

    routed = "query_id long, v array<double>, cell int, part int"
    near = cut(_best(_search_shards(index, asked.mapInArrow(route, routed), k, ef), k).drop("rank"))
    kth = near.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    wider = asked.join(kth, "query_id", "left").select("query_id", "v", "kth").mapInArrow(route, routed)
    return _best(near.unionByName(_search_shards(index, wider, k, ef)), k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """build_index and search_index; no usable vector gives no rows."""
    index = build_index(vectors, k + 1)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search_index(index, queries, k)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.where("vec_id % 50 = 0"))


QUERIES = {"op13_neighbours": op13_neighbours}
ORACLE: dict[str, str] = {}
