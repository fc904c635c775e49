"""Operator 3: SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets a row of a pivot table: its Hamming distances to PIVOTS reference fingerprints.
By the triangle inequality two fingerprints within d bits differ by at most d in every coordinate, so a pair is
discarded by its maximum coordinate difference before the fingerprints themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridix.llm.common import LOWER, WHITE, bounded, bytes_of, cut, flagged, maybe, mix64, prefix_sums, read_table, remove_written, runs, settle, span_hash, tables_written
from veridix.llm.graph import connected_components

#: Reference fingerprints of the pivot table: mixed counters, so about half the bits of each are set.
PIVOTS = [int(x) for x in mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)]
#: A search block with more fingerprints than this is linked by shared midpoints instead of pairs.
DENSE = 256


def bit_majority(h: np.ndarray) -> int:
    """The 64-bit fingerprint of the hashes h: a bit is 1 if set in over half of them; 0 of none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the whole text over word shingles, repeats included, hashed by XXH64. Null and no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return bit_majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp long); one row per input row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            known: dict[str | None, int] = {}
            out = []
            for t in b.column(1).to_pylist():
                if t not in known:
                    known[t] = fingerprint(t, shingle, seed)
                out.append(known[t])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def pivot_table(fp: Column, pivots: list[int] | None = None) -> Column:
    """Hamming distances of fp to the pivots, one byte each, packed into a long from the low byte up."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(PIVOTS if pivots is None else pivots):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
    return out


def within(a: Column, b: Column, most: int) -> Column:
    """Whether two packed pivot rows differ by at most `most` in every coordinate."""
    out = F.lit(True)
    for i in range(len(PIVOTS)):
        part = [F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(127)) for x in (a, b)]
        out = out & (F.abs(part[0] - part[1]) <= most)
    return out


def _blocks(fp: Column, most: int) -> Column:
    """Search keys: two fingerprints within `most` bits share two of most+2 bit blocks, so one key at least."""
    n = most + 2
    bounds = [64 * i // n for i in range(n + 1)]
    keys = []
    for number, (i, j) in enumerate(combinations(range(n), 2)):
        mask = sum(((1 << (bounds[x + 1] - bounds[x])) - 1) << bounds[x] for x in (i, j))
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def hamming_links(nodes: DataFrame, most: int = 2, dense: int = DENSE) -> DataFrame:
    """nodes (id long, fp long), fp distinct -> links (a, b) whose components are those of all pairs within `most` (0 to 2) bits.

    Blocks find candidates, the pivot table discards, the fingerprints verify; both tests stand in the join
    condition, so a discarded pair is never a row. A block of over `dense` fingerprints (a large group of close
    fingerprints) is not paired: its members are grouped by every value within one bit of them. Two fingerprints
    within two bits share such a midpoint, so linking each midpoint's members in a star keeps every component, in
    65 rows a fingerprint and at most 65 a group.
    """
    if most > 2:
        raise ValueError("midpoints within one bit join at most two bits")
    rows = cut(nodes.select("id", "fp", F.explode(_blocks(F.col("fp"), most)).alias("key")))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = rows.join(sizes, "key")
    pairs = held.where(F.col("n") <= dense).select("key", "id", "fp", pivot_table(F.col("fp")).alias("d"))
    a, b = pairs.alias("a"), pairs.alias("b")
    apart = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & within(F.col("a.d"), F.col("b.d"), most) & (apart <= most))
    near = near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    hot = held.where(F.col("n") > dense).select("id", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(64)])
    balls = hot.select("id", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
    centre = balls.groupBy("mid").agg(F.min("id").alias("a"), F.count("*").alias("n"), F.collect_list("id").alias("ids")).where("n > 1")
    star = centre.select("a", F.explode("ids").alias("b")).where("a <> b")
    return near.unionAll(star).distinct()


def simhash_components(docs: DataFrame, most: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints at `most` or fewer differing bits are linked. Null and empty texts have fingerprint zero and are
    linked like any other; repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = connected_components(hamming_links(nodes, most))
    names = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near-duplicate texts, for pipelines

#: Bits of the long fingerprint used for the search, and how they are cut into bands.
LANES, BAND_BITS, BANDS = 22, 22, 64
#: Most bits in which the first 64 may differ; the mean at the similarity sought is below 6.
FAR = 18
#: Bytes of paired texts that are compared at once, and of texts whose words are hashed at once.
PAIRED, SLICE = 4 << 20, 1 << 18


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, fp, bands): SimHash of the distinct lower-cased words in LANES * 64 bits, cut into bands."""
    for b in bounded(batches, SLICE):
        data, off = bytes_of(b.column(1))
        low = LOWER[data]
        starts, ends, row = runs(~WHITE[low], off)
        h = span_hash(prefix_sums(low), starts, ends)
        fp, bands = np.zeros(len(off) - 1, np.uint64), np.zeros((len(off) - 1, BANDS), np.int32)
        at = np.searchsorted(row, np.arange(len(off)))
        for i in range(len(off) - 1):
            u = np.unique(h[at[i] : at[i + 1]])
            wide = [bit_majority(u if k == 0 else mix64(u + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for k in range(LANES)]
            fp[i] = wide[0]
            whole = sum(w << (64 * k) for k, w in enumerate(wide))
            bands[i] = [(whole >> (BAND_BITS * j) & ((1 << BAND_BITS) - 1)) | j << BAND_BITS for j in range(BANDS)]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(off), dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), flat], names=["id", "fp", "bands"])
    settle()


def shingle_set(text: str | None, k: int = 5) -> frozenset[int]:
    """Hashes of the distinct k-word shingles of the lower-cased text; fewer words: the whole sequence; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(xxhash.xxh64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1))


def jaccard(a: frozenset[int], b: frozenset[int]) -> float:
    """Two empty sets are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


def shingle_rows(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct k-word shingles (see shingle_set), one text after another, and their n+1 bounds."""
    a, off = bytes_of(column)
    low = LOWER[a]
    starts, ends, row = runs(~WHITE[low], off)
    h = span_hash(prefix_sums(low), starts, ends)
    n = len(off) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    words = np.diff(first)
    at, size = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) if len(row) >= k else np.zeros(0, np.int64), k
    rows, hashes = [], []
    for size in range(k, 0, -1):
        at = at if size == k else first[:-1][words == size]  # a text of fewer words is one shingle
        with np.errstate(over="ignore"):
            g = h[at]
            for j in range(1, size):
                g = mix64(g * np.uint64(31) + h[at + j])
        rows.append(row[at])
        hashes.append(g)
    r, g = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return g[new], np.searchsorted(r[new], np.arange(n + 1))


def _pairs(b: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles of s and of t for each row of (a, b, s, t); each text is cut once a batch."""
    sides = []
    for ids, texts in ((b.column(0), b.column(2)), (b.column(1), b.column(3))):
        _, first, which = np.unique(np.asarray(ids), return_index=True, return_inverse=True)
        sides.append((*shingle_rows(texts.take(pa.array(first)), k), which))
    for i in range(b.num_rows):
        yield tuple(h[bounds[which[i]] : bounds[which[i] + 1]] for h, bounds, which in sides)


def _in(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which values of the sorted x the sorted other holds."""
    if not len(other):
        return np.zeros(len(x), bool)
    return other[np.minimum(np.searchsorted(other, x), len(other) - 1)] == x


def _alike(common: int, x: int, y: int, least: float) -> bool:
    return common / (x + y - common) >= least if x or y else True


def _verify(k: int, least: float):
    """(a, b, s, t) -> the (a, b) whose texts are at least that alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, PAIRED):
            keep = [_alike(int(_in(y, x).sum()), len(x), len(y), least) for x, y in _pairs(b, k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        settle()

    return run


#: Longs in the bit masks of a text's own shingles and of the centre's that it lacks, the part of a text's shingles that a
#: centre must hold to describe it, and texts of a centre that may share an own shingle and still be paired by it.
MASKS, LACKS, HELD, FEW = 4, 8, 0.25, 8
OWN_BITS, LACK_BITS = [f"m{i}" for i in range(MASKS)], [f"l{i}" for i in range(LACKS)]
STAR = "a long, b long, hit boolean, size int, common int, centre int, own array<long>, " + ", ".join(f"{x} long" for x in OWN_BITS + LACK_BITS)


def _bits(h: np.ndarray, longs: int) -> np.ndarray:
    """The hashes as a bit mask."""
    marks = np.zeros(longs * 64, np.uint8)
    marks[mix64(h) % np.uint64(longs * 64)] = 1
    return np.packbits(marks).view(np.int64)


def _stars(k: int, least: float):
    """(a, b, s, t) -> a STAR row for each text t that shares at least HELD of its shingles with the centre's text s.

    own: hashes of the shingles that the centre lacks, in order; m0, m1, ...: the bits of these hashes; l0, l1, ...: the
    bits of the centre's shingles that the text lacks; centre: the number of the centre's shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, PAIRED):
            at, hit, size, shared, centre, own, masks = [], [], [], [], [], [], []
            for i, (x, y) in enumerate(_pairs(batch, k)):
                held = _in(y, x)
                common = int(held.sum())
                alike = _alike(common, len(x), len(y), least)
                if not alike and common < HELD * len(y):
                    continue
                rest = y[~held]
                at.append(i)
                hit.append(alike)
                size.append(len(y))
                shared.append(common)
                centre.append(len(x))
                own.append(np.sort(rest.view(np.int64)))
                masks.append(np.concatenate([_bits(rest, MASKS), _bits(x[~_in(x, y)], LACKS)]))
            bounds = pa.array(np.append(0, np.cumsum([len(x) for x in own])).astype(np.int32))
            flat = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
            bits = np.array(masks, np.int64).reshape(len(at), MASKS + LACKS)
            columns = [*batch.select([0, 1]).take(pa.array(at, pa.int64())).columns, pa.array(hit, pa.bool_()), *(pa.array(x, pa.int32()) for x in (size, shared, centre)), flat, *(pa.array(bits[:, i]) for i in range(MASKS + LACKS))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in STAR.split(", ")])
        settle()

    return run


def star_candidates(stars: DataFrame, least: float) -> DataFrame:
    """STAR rows -> (a, b): every pair of one centre's texts, not both linked to it, that can be `least` alike.

    Alike texts x and y share at least need = least / (1 + least) * (|x| + |y|) shingles. Of the centre's shingles they
    share at most the smaller `common`, and no more than those that neither lacks (a set bit of either mask is one that is
    lacking at least). The rest must be own shingles that both have. An own shingle of over FEW of the centre's texts (one
    that the centre lost from the text all were made of, say) pairs nobody: they share at most the smaller number of them.
    So either x and y share a rarer own shingle, which pairs at most FEW texts, or they need none (found by size class).
    Exact: nothing alike is lost. A text's home is the one of its centres that links most texts; texts of one home are
    paired there alone. Rows that meet by an own shingle grow with the stars' rows; a size class is tested pair by pair.
    """
    linked = stars.groupBy("a").agg(F.sum(F.col("hit").cast("long")).alias("links"), F.min("hit").alias("all"))
    ranked = stars.select("a", "b").join(linked, "a").groupBy("b").agg(F.min_by("a", F.struct(-F.col("links"), "a")).alias("home"))
    spare = F.size("own") - sum((F.bit_count(m) for m in OWN_BITS), F.lit(0))
    kept = stars.where("size > 0").withColumn("spare", spare).join(linked.where("not all").select("a"), "a", "left_semi")
    holders = F.count("*").over(Window.partitionBy("a", "shingle"))
    known = cut(kept.select("a", "b", F.explode("own").alias("shingle")).withColumn("n", holders).where("n > 1"))
    often = known.where(F.col("n") > FEW).groupBy("a", "b").agg(F.count("*").alias("often"))
    facts = cut(kept.drop("own").join(ranked, "b").join(often, ["a", "b"], "left").select("a", "b", "home", "hit", "size", "common", "centre", "spare", F.coalesce("often", F.lit(0)).cast("int").alias("often"), *OWN_BITS, *LACK_BITS))

    def both(f, bits: list[str]) -> Column:
        return sum((F.bit_count(f(F.col(f"x.{m}"), F.col(f"y.{m}"))) for m in bits), F.lit(0))

    pair = [F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")]
    here = (F.col("x.a") == F.col("y.a")) & ~(F.col("x.hit") & F.col("y.hit")) & ((F.col("x.home") != F.col("y.home")) | (F.col("x.home") == F.col("x.a")))
    need = (F.col("x.size") + F.col("y.size")) * (least / (1 + least)) - 1e-9
    old = F.least("x.common", "y.common", F.col("x.centre") - both(lambda p, q: p.bitwiseOR(q), LACK_BITS))
    # no rare own shingle is needed
    level = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(least))).cast("long")
    full = facts.where(F.col("common") + F.col("often") >= F.col("size") * least - 1e-9).withColumn("level", level)
    around = full.withColumn("level", F.explode(F.array(*[F.col("level") + i for i in (-1, 0, 1)])))
    x, y = full.alias("x"), around.alias("y")
    plain = x.join(y, here & (F.col("x.level") == F.col("y.level")) & (F.col("x.b") < F.col("y.b")) & (need <= old + F.least("x.often", "y.often"))).select(*pair)
    # a shared rare own shingle; each common bit, and each shingle beyond x's set bits, can be a shared one
    x, y = (known.where(F.col("n") <= FEW).alias(c) for c in "xy")
    met = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.b") < F.col("y.b")))
    met = met.select("x.a", F.col("x.b").alias("b"), F.col("y.b").alias("c")).distinct()
    most = both(lambda p, q: p.bitwiseAND(q), OWN_BITS) + F.least("x.spare", "y.spare")
    one = met.join(facts, ["a", "b"]).alias("x")
    shared = one.join(facts.alias("y"), here & (F.col("x.c") == F.col("y.b")) & (need <= old + most)).select(*pair)
    return plain.unionAll(shared).distinct()


def _text_keys(docs: DataFrame) -> DataFrame:
    """docs with two hashes of the text, hi and lo, 124 bits together; null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("hi", F.xxhash64(text)).withColumn("lo", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))


def _nodes(keyed: DataFrame, names: DataFrame) -> DataFrame:
    """keyed (doc_id, text, hi, lo), names (hi, lo of its rows) -> (id, hi, lo, text): every distinct text once. Only texts
    that may have copies are shuffled."""
    many = names.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi")
    told = flagged(keyed.select("hi", "lo", "text"), "hi", many)
    copies = told.where("__maybe").groupBy("hi", "lo").agg(F.first("text").alias("text"))
    every = told.where("not __maybe").drop("__maybe").unionByName(copies)
    return cut(every.withColumn("id", F.monotonically_increasing_id()))


def _groups(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, hi, lo, root): one row per input row with an id, and the group of its text."""
    keyed = _text_keys(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    names = cut(keyed.select("doc_id", "hi", "lo"))
    texts = _nodes(keyed, names)
    at = tables_written()
    wide = cut(texts.select("id", "text").mapInArrow(_wide, "id long, fp long, bands array<int>"))
    rows = wide.select("id", "fp", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = cut(maybe(rows, "key", shared))
    remove_written(at, keep=1)

    def close(x: str, y: str) -> Column:
        """The pivot table follows from the fingerprints, so it isn't shuffled with them."""
        x, y = F.col(x), F.col(y)
        return (F.bit_count(x.bitwiseXOR(y)) <= FAR) & within(pivot_table(x), pivot_table(y), FAR)

    centres = rows.groupBy("key").agg(F.min(F.struct("id", "fp")).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.id").alias("a"), F.col("c.fp").alias("afp"), (F.col("n") > 2).alias("more"))
    held = rows.join(centres, "key").where(F.col("a") < F.col("id"))
    held = cut(held.withColumn("a", F.when(close("afp", "fp"), F.col("a"))).where("more or a is not null").select("key", "id", "fp", "a", "more"))

    def compared(pairs: DataFrame, by, schema: str) -> DataFrame:
        pairs = cut(pairs)
        one = maybe(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a", pairs)
        two = maybe(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b", pairs)
        return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(by(shingle, similarity), schema))

    stars = compared(held.where("a is not null").select("a", F.col("id").alias("b")).distinct(), _stars, STAR)
    first = stars.where("hit").select("a", "b")
    told = stars.select(F.col("a").alias("sa"), F.col("b").alias("sb"))
    # a bucket's centre has met all its texts, so only the others meet again, where there are two of them
    others = held.where("more")
    met = others.where("a is not null").join(told, (F.col("a") == F.col("sa")) & (F.col("id") == F.col("sb")), "left_anti")
    apart = others.where("a is null").unionAll(met).select("key", "id", "fp")
    x, y = apart.alias("x"), others.select("key", "id", "fp").alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & close("x.fp", "y.fp"))
    rest = rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    second = compared(rest.unionAll(star_candidates(stars, similarity)).distinct().join(first, ["a", "b"], "left_anti"), _verify, "a long, b long")
    roots = connected_components(first.unionAll(second))
    found = texts.select("id", "hi", "lo").join(roots, "id", "left").select("hi", "lo", F.coalesce("root", "id").alias("root"))
    return names.join(found, ["hi", "lo"])


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, component_id): groups of texts whose shingle sets are at least that similar, named
    by their smallest doc_id.

    Equal texts are one node (null as empty). A band of the long SimHash gives candidates: texts of a bucket, which the
    pivot table and the first 64 bits thin out. Every text is first held against its buckets' smallest nodes, the centres,
    so a bucket of n near copies costs n comparisons. Texts that a centre describes but doesn't link are held against
    its others only where `star_candidates` can't rule it out; those that the centre doesn't describe, against the whole
    bucket. Whole shingle sets verify. A bucket of unrelated texts grows with the square of the input by 2**-BAND_BITS.

    One row per row with an id: rows without one are left out, repeated rows stay repeated, and an id with several
    texts has a row for each. Empty table: no rows; other columns are ignored.
    """
    found = cut(_groups(docs, shingle, similarity))
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one_of_each_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns, one row for each group of near_duplicate_groups: that of the smallest
    doc_id. Rows with one id and unlike texts are different texts and both stay; rows without an id aren't grouped and stay."""
    keys = ["doc_id", "hi", "lo"]
    first = tables_written()
    found = cut(_groups(docs, shingle, similarity))
    remove_written(first, keep=1)
    kept = found.groupBy("root").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    # rows that surely are the only one of their text and the first of their group aren't shuffled
    again = found.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select("hi")
    lost = found.join(kept, keys, "left_anti").select("hi")
    told = flagged(_text_keys(docs.withColumnsRenamed({c: f"__{c}" for c in ("hi", "lo") if c in docs.columns}).where("doc_id is not null")), "hi", lost.unionAll(again))
    doubtful = told.where("__maybe").drop("__maybe").join(kept, keys, "left_semi").dropDuplicates(keys)
    held = told.where("not __maybe").drop("__maybe").unionByName(doubtful)
    own = [F.col(f"__{c}").alias(c) if c in ("hi", "lo") else F.col(c) for c in docs.columns]
    return held.select(*own).unionAll(docs.where("doc_id is null"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE: dict[str, str] = {}
