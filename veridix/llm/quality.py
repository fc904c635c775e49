"""Operator 9: document quality by a classifier and hierarchical empirical Bayes over sites.

1. words and word beginnings that stand out in toxic documents become a lexicon (bounded), and
2. a logistic regression on the lexicon's hits and on text statistics, both fitted on a bounded sample of labelled rows (SAMPLE);
3. over all labels, per host and per path the labelled rate of bad documents, each shrunk toward the level above by a beta prior
   whose strength comes from the spread between sites. The site's log-odds against the global rate shift the
   document's own log-odds by a weight that is estimated too: on the half of the sample whose labels the rates
   that it is fitted with haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veridix.llm.common import LOWER, TERM, WHITE, bounded, bytes_of, cut, prefix_sums, read_table, runs, settle, small_batches, span_hash

#: Entries of the lexicon at most, documents an entry needs at least, and how much more often it must be toxic.
LEXICON, SUPPORT, LIFT = 4096, 4, 8.0
#: Labelled rows, about, that the lexicon and the regression are fitted on at most.
SAMPLE = 40_000
#: Bytes of text that a task looks at together: its statistics take over a hundred bytes for each.
SLICE = 1 << 18
#: An entry's toxic documents must be over this many times its others.
PURITY = 3
#: Word beginnings of these many bytes are looked at besides whole words.
BEGINNINGS = (4, 5, 6)
STATISTICS = 12
#: Host and path: `source`, and `lang` below it.
LEVELS = ["source", "lang"]
FEATURES = STATISTICS + 4


def text_features(a: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each text, and its (row, hash) pairs of words and word beginnings, each once a row."""
    n = len(off) - 1
    low = LOWER[a]
    size = np.maximum(np.diff(off), 1)
    sums = prefix_sums(low)
    ws, we, wr = runs(~WHITE[a], off)
    ts, te, tr = runs(TERM[a], off)
    words = np.bincount(wr, minlength=n)
    w1 = np.maximum(words, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(mask))
        return (c[off[1:]] - c[off[:-1]]) / size

    wh = span_hash(sums, ws, we)
    pairs = np.unique(np.stack([wr.astype(np.uint64), wh]), axis=1) if len(wh) else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
    same = np.zeros(len(wh), bool)
    same[1:] = (wh[1:] == wh[:-1]) & (wr[1:] == wr[:-1])
    upper = (a >= 65) & (a <= 90)
    cu = np.append(0, np.cumsum(upper))
    shout = (cu[we] - cu[ws]) * 2 > (we - ws)
    letter = TERM[a]
    cl = np.append(0, np.cumsum(letter))
    bare = (cl[we] - cl[ws]) == 0
    ended = np.zeros(len(we), bool)
    ended[:] = np.isin(a[we - 1], np.frombuffer(b"#$%&*|!~^=_<>", np.uint8)) if len(we) else ended
    stats = np.stack([
        share(upper), share(~letter & ~WHITE[a]), share(WHITE[a]), share((a >= 48) & (a <= 57)),
        distinct / w1, np.bincount(wr, weights=same, minlength=n) / w1, np.bincount(wr, weights=shout, minlength=n) / w1,
        np.bincount(wr, weights=bare, minlength=n) / w1, np.bincount(wr, weights=ended, minlength=n) / w1,
        np.bincount(wr, weights=we - ws, minlength=n) / w1 / 10, np.log1p(words) / 10, (words == 0).astype(float),
    ], axis=1)
    rows, hashes = [tr], [span_hash(sums, ts, te)]
    for k in BEGINNINGS:
        ok = te - ts > k
        rows.append(tr[ok])
        hashes.append(span_hash(sums, ts[ok], ts[ok] + k) ^ np.uint64(k))
    r, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return stats, r[new], h[new]


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Model:
    lexicon: np.ndarray  # sorted hashes
    weight: np.ndarray  # their toxic log-odds
    bad: np.ndarray  # regression weights for bad documents, bias last
    toxic: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def log_odds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of bad and of toxic documents, by their features."""
        z = (x - self.mean) / self.scale
        return tuple(np.clip(z @ w[:-1] + w[-1], -30, 30) for w in (self.bad, self.toxic))


def features(lexicon: np.ndarray, weight: np.ndarray, a: np.ndarray, off: np.ndarray) -> np.ndarray:
    stats, r, h = text_features(a, off)
    n = len(off) - 1
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        hit = lexicon[at] == h
        r, w = r[hit], weight[at[hit]]
    else:
        r, w = r[:0], np.zeros(0)
    count = np.bincount(r, minlength=n)
    best = np.zeros(n)
    np.maximum.at(best, r, w)
    return np.column_stack([stats, count > 0, np.log1p(count), best, np.minimum(np.bincount(r, weights=w, minlength=n), 30.0) / 10])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights and bias by Newton steps; constant labels give the clipped log-odds."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    if not len(x):
        return w
    w[-1] = _logit(y.mean())
    if y.min() == y.max():
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0)
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """docs (doc_id, text, source, lang) with labels (toxic, quality) of about `most` labelled ids at most, the same ids
    each time. A bounded number of labels is broadcast to the texts; the texts aren't moved."""
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "quality")
    part = min(1.0, most / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("quality").cast("int").alias("quality")).limit(2 * most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *LEVELS).join(F.broadcast(own), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, pd.DataFrame]:
    """docs (doc_id, text, source, lang), labels (doc_id, quality, toxic) -> the model, and of the sample's rows that
    _fold(1) holds source, lang, both log-odds and both labels. A document with several labels counts by its worst."""
    with small_batches(docs.sparkSession):
        return _train(docs, labels)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (h, t, n): by hash of a word or beginning how many of a slice's rows hold it, and how many toxic ones."""
    for b in bounded(batches, SLICE):
        a, off = bytes_of(b.column(0))
        _, r, h = text_features(a, off)
        toxic = np.asarray(b.column(1)).astype(np.int64)[r] > 0
        u, inv = np.unique(h, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, weights=toxic, minlength=len(u)).astype(np.int64)), pa.array(np.bincount(inv, minlength=len(u)).astype(np.int64))], names=["h", "t", "n"])
    settle()


def _train(docs: DataFrame, labels: DataFrame) -> tuple[Model, pd.DataFrame]:
    known = _labelled(docs, labels, SAMPLE)
    totals = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.lit(0)).alias("t")).first()
    t_all, c_all = totals["t"], totals["n"] - totals["t"]
    spread = known.select("text", "toxic").mapInArrow(_counted, "h long, t long, n long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (t_all + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (c_all + 1.0))
    top = spread.where(F.col("t") >= SUPPORT).withColumn("w", odds).where(F.col("w") > float(np.log(LIFT)))
    top = top.where((F.col("n") - F.col("t")) * PURITY < F.col("t")).orderBy(F.desc("t"), "h").limit(LEXICON).collect()  # at most LEXICON rows
    pairs = sorted((np.int64(r["h"]).view(np.uint64).item(), r["w"]) for r in top)
    lexicon, weight = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, SLICE):
            x = features(lexicon, weight, *bytes_of(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x)), *b.columns[1:]], names=["x", *b.schema.names[1:]])
        settle()

    places = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*LEVELS).schema)
    got = known.select("text", "toxic", "quality", _fold("doc_id").alias("fold"), *LEVELS).mapInArrow(rows, f"x array<double>, toxic int, quality int, fold int, {places}").toPandas()  # about SAMPLE rows
    order = np.lexsort([got["toxic"].to_numpy(), *np.array(got["x"].tolist()).reshape(len(got), FEATURES).T])  # whatever order the tasks end in
    got = got.iloc[order]
    x = np.array(got["x"].tolist()).reshape(len(got), FEATURES)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    z = (x - mean) / scale
    toxic = (got["toxic"].to_numpy(float) > 0).astype(float)
    junk = (got["quality"].to_numpy(float) < 1).astype(float)
    model = Model(lexicon, weight, fit_logistic(z, junk), fit_logistic(z, toxic), mean, scale)
    bad_odds, toxic_odds = model.log_odds(x)
    unseen = got[LEVELS].assign(bad_odds=bad_odds, toxic_odds=toxic_odds, junk=junk, toxic=toxic)[got["fold"].to_numpy() == 1]
    return model, unseen


def _fold(column: str) -> Column:
    """Half of the ids each: 0 or 1."""
    return F.pmod(F.shiftright(F.xxhash64(column), 32), F.lit(2)).cast("int")


def site_weight(odds: np.ndarray, shift: np.ndarray, y: np.ndarray, rounds: int = 30) -> float:
    """The weight in [0, 1] by which the site's shift, added to the log-odds, makes the labels likeliest; a unit normal
    prior about zero, so without evidence the site doesn't count."""
    w = 0.0
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(odds + w * shift, -30, 30)))
        w += float(((y - p) * shift).sum() - w) / float((p * (1 - p) * shift * shift).sum() + 1)
        w = min(1.0, max(0.0, w))
    return w


def site_rates(sites: DataFrame, levels: list[str]) -> DataFrame:
    """sites (levels..., bad 0/1; null: no label) -> per combination of the levels its posterior rate of bad documents.

    The global rate has a uniform prior. Each level's mean is shrunk toward its parent's posterior with a strength
    of (1 - icc) / icc pseudo-documents, icc being the share of variance between that level's sites (method of
    moments over sites with labels), so a site with few labels stays near its parent.
    """
    base = sites.groupBy(*levels).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    whole = base.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("k")).first()
    rate = (whole["k"] + 1) / (whole["n"] + 2)
    out = base
    parent: Column = F.lit(rate)
    above = (whole["k"] ** 2 / whole["n"] if whole["n"] else 0.0, 1)
    for i in range(len(levels)):
        keys = levels[: i + 1]
        level = base.groupBy(*keys).agg(F.sum("n").alias("ln"), F.sum("k").alias("lk"))
        # spread of the sites about their parents beyond what binomial noise gives: sums of k * k / n by level
        m = level.where("ln > 0").agg(F.sum("ln").alias("n"), F.sum(F.col("lk") * F.col("lk") / F.col("ln")).alias("a"), F.count("*").alias("s")).first()
        icc = 0.0
        if m["s"]:
            within = rate * (1 - rate)
            icc = ((m["a"] - above[0]) - within * (m["s"] - above[1])) / m["n"] / within
            above = (m["a"], m["s"])
        strength = (1 - icc) / icc if icc > 1e-4 else 1e4
        out = out.join(level.select(*[F.col(c).alias(f"__{c}") for c in keys], "ln", "lk"), [out[c].eqNullSafe(F.col(f"__{c}")) for c in keys], "left").drop(*[f"__{c}" for c in keys])
        out = out.withColumn(f"rate_{i}", (F.coalesce("lk", F.lit(0.0)) + parent * F.lit(strength)) / (F.coalesce("ln", F.lit(0)) + F.lit(strength))).drop("ln", "lk")
        parent = F.col(f"rate_{i}")
    return out.select(*levels, parent.alias("site_rate"), F.lit(rate).alias("global_rate"))


def site_shift() -> Column:
    """The site's log-odds against those of all labels."""
    log_odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    return log_odds("site_rate") - log_odds("global_rate")


def _weights(unseen: pd.DataFrame, rates: DataFrame) -> list[float]:
    """Weights of the site for bad and for toxic documents, from rows that the rates haven't seen (about SAMPLE / 2)."""
    if unseen.empty:
        return [0.0, 0.0]
    spark = rates.sparkSession
    # as an Arrow table, which the JVM reads itself: a list of rows would start a second set of Python workers
    rows = spark.createDataFrame(pa.table({f"__{c}": pa.array([None if pd.isna(v) else v for v in unseen[c]], to_arrow_type(rates.schema[c].dataType)) for c in LEVELS} | {c: pa.array(unseen[c].to_numpy(float)) for c in ("bad_odds", "toxic_odds", "junk", "toxic")}))
    got = F.broadcast(rows).join(rates, [rates[c].eqNullSafe(rows[f"__{c}"]) for c in LEVELS]).select("bad_odds", "toxic_odds", "junk", "toxic", site_shift().alias("s")).orderBy("bad_odds", "toxic_odds", "junk", "toxic", "s").toPandas()
    return [site_weight(got[o].to_numpy(), got["s"].to_numpy(), got[y].to_numpy()) for o, y in (("bad_odds", "junk"), ("toxic_odds", "toxic"))]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, lang), labels (doc_id, quality, toxic) -> docs' columns with p_bad, p_toxic,
    site_rate and rejected.

    The host is `source`, the path below it `lang`; null is a site of its own. Null and empty texts are classified
    by their statistics. No labels: nothing is known, every probability is the prior's and nothing is rejected.
    Repeated rows are classified alike; an empty table gives no rows; input columns named like the added ones go.
    """
    spark = docs.sparkSession
    docs = docs.drop("p_bad", "p_toxic", "site_rate", "rejected")
    model, unseen = train(docs, labels)
    sent = spark.sparkContext.broadcast(model)
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(((F.col("toxic") > 0) | (F.col("quality") < 1)).cast("int")).alias("bad"))
    levels = LEVELS
    sites = docs.select("doc_id", *levels).join(own, "doc_id", "left")
    rates = cut(site_rates(sites.select(*levels, "bad"), levels))
    weights = _weights(unseen, site_rates(sites.select(*levels, F.when(_fold("doc_id") == 0, F.col("bad")).alias("bad")), levels))
    del unseen
    settle()  # what the driver has read of the sample
    known = bool(len(model.mean)) and not rates.where("site_rate is not null").isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in bounded(batches, SLICE):
            cols = map(pa.array, m.log_odds(features(m.lexicon, m.weight, *bytes_of(b.column(b.schema.get_field_index("text"))))))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "__bad", "__toxic"])
        settle()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scored = docs.mapInArrow(run, fields + ", __bad double, __toxic double")
    r = rates.select(*[F.col(c).alias(f"__{c}") for c in levels], "site_rate", "global_rate")
    scored = scored.join(r, [scored[c].eqNullSafe(r[f"__{c}"]) for c in levels], "left").drop(*[f"__{c}" for c in levels])
    for name, raw, w in (("p_bad", "__bad", weights[0]), ("p_toxic", "__toxic", weights[1])):
        scored = scored.withColumn(name, 1 / (1 + F.exp(-(F.col(raw) + F.lit(w) * site_shift()))))
    reject = (F.col("p_bad") > 0.5) | (F.col("p_toxic") > 0.5) if known else F.lit(False)
    return scored.withColumn("rejected", reject).drop("__bad", "__toxic", "global_rate")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_bad", "p_toxic", "site_rate", "rejected")


QUERIES = {"op9_quality": op9_quality}
ORACLE: dict[str, str] = {}
