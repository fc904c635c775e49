"""Aggregates with the definitions that the evaluation tables use."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridix.session import written

#: Of the sketch that brackets a percentile: its rank is off by at most one in this many rows.
ACCURACY = 10_000


def percentile_linear(c: Column, p: float) -> Column:
    """Linear interpolation between order statistics, for groups of bounded size (draws of a bootstrap, say): the
    aggregate holds a group's distinct values. `percentiles` takes groups of any size."""
    return F.percentile(c.cast("double"), F.lit(p))


def percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, tuple[str, float]]) -> DataFrame:
    """Per group exact percentiles of a column's values that aren't null: points names each and says ("linear", p),
    interpolated at p * (n - 1), or ("nearest", p), the order statistic at its half-even rounding.

    No task gathers a group. A sketch brackets each percentile between two values that hold about 8 / ACCURACY of the
    group's rows; rows below the bracket are only counted, and only the bracket's distinct values are sorted.
    A group of nulls has no row.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    v = rows.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null")
    ps = [p for _, p in points.values()]
    edge = lambda by: F.array(*[F.lit(min(1.0, max(0.0, p + by * 4 / ACCURACY))) for p in ps])
    sketch = lambda by: F.percentile_approx("v", edge(by), F.lit(ACCURACY))
    small = F.count("*") <= ACCURACY  # too few rows for a bracket
    all_of = lambda x: F.array(*[x for _ in ps])
    bounds = v.groupBy(*own).agg(F.count("*").alias("n"), F.when(small, all_of(F.min("v"))).otherwise(sketch(-1)).alias("lo"), F.when(small, all_of(F.max("v"))).otherwise(sketch(1)).alias("hi"))
    b = bounds.select(*[F.col(o).alias(f"b{o}") for o in own], "n", "lo", "hi")
    same = [v[o].eqNullSafe(b[f"b{o}"]) for o in own]
    held = (v.join(b, same) if own else v.crossJoin(F.broadcast(b))).drop(*[f"b{o}" for o in own])
    within = lambda i: (F.col("v") >= F.col("lo")[i]) & (F.col("v") <= F.col("hi")[i])
    spots = range(len(ps))
    # one pass: every value below a bracket falls to one row a group, the others to one row a value
    inside = F.when(F.greatest(*[within(i).cast("int") for i in spots], F.lit(0)) == 1, F.col("v"))
    cells = held.groupBy(*own, inside.alias("v")).agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), *[F.count_if(F.col("v") < F.col("lo")[i]).alias(f"under{i}") for i in spots])
    under = F.array(*[F.sum(f"under{i}").over(Window.partitionBy(*own)) for i in spots])
    cells = cells.withColumn("under", under).where("v is not null")
    near = cells.select("*", F.posexplode("under").alias("i", "before")).where((F.col("v") >= F.get("lo", F.col("i"))) & (F.col("v") <= F.get("hi", F.col("i"))))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*own, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto)
    out = []
    for i, (name, (kind, p)) in enumerate(points.items()):
        x = F.lit(p) * (F.col("n") - 1)
        first, last = (F.floor(x), F.ceil(x)) if kind == "linear" else (F.bround(x), F.bround(x))
        at = lambda r, i=i: F.min(F.when((F.col("i") == i) & (F.col("upto") > r), F.col("v")))
        part = F.max(x - F.floor(x)) if kind == "linear" else F.lit(0.0)
        out.append((at(first) + (at(last) - at(first)) * part).alias(name))
    got = near.groupBy(*own).agg(*out)
    return got.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], *points)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


#: What Stirling's formula lacks of ln x!, for x below 16; beyond, its series has all digits.
_SMALL = [0.0] + [math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) for x in range(1, 16)]


def _stirling_error(x: Column) -> Column:
    s = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - F.lit(1 / 1680) / s) / s) / s) / x
    return F.when(x < 16, F.get(F.array(*[F.lit(v) for v in _SMALL]), x.cast("int"))).otherwise(series)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts b and c; 1 if there are none, at most 1.

    The tail's largest term, that of k = min(b, c) of n, comes from Loader's form of the binomial, which loses no digits
    to large factorials; each term below follows from the one above. After 6 sqrt(n) terms all that are left are below
    e^-70 of the first and change no bit of the sum, so a group costs the root of its count and any count is safe.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    m, d = n - k, (n - 2 * k) / n
    apart = k * F.log1p(-d) + m * F.log1p(d)
    log = _stirling_error(n) - _stirling_error(k) - _stirling_error(m) - apart + 0.5 * F.log(n / (2 * math.pi * k * m))
    first = F.exp(F.when(k == 0, -n * math.log(2.0)).otherwise(log))
    terms = F.filter(F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(6 * F.sqrt(n))).cast("long")), lambda i: i > 0)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (m + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = first * F.aggregate(terms, start, step, lambda acc: acc["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def percentiles_by_rounds(rows: DataFrame, keys: list[str], value: str, points: dict[str, tuple[str, float]], held: int = 1_000_000, cells: int = 500) -> DataFrame:
    """`percentiles` for groups of any size, none of whose tasks sorts over `held` rows of a group: brackets are narrowed in
    rounds until they hold no more.

    A round cuts each order statistic's bracket into `cells` of about equal counts by a sketch, counts exactly what lies
    below, at and between the ends of three of them, and goes on in the part that the rank falls to. As the counts are exact
    a coarse sketch costs rounds, not results, and a value that many rows share is found as an end. Rows outside all
    brackets are left behind after the first round, which reads `rows` three times; what is left is written between rounds.
    Jobs run while the plan is built; `rows` must be the same each time it is read. Groups of up to `held` rows go by
    `percentiles`. Nulls are left out, a group of nulls has no row, an empty table gives none.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    v = rows.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null")
    big = written(v.groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") > held))
    many = big.count()
    named = [F.col(o).alias(k) for k, o in zip(keys, own, strict=True)]
    plain = v.select(*named, F.col("v").alias(value))
    if not many:
        return percentiles(plain, keys, value, points)
    small = v.join(_sent(big, many, own), _own_equal(own), "left_anti").select(*named, F.col("v").alias(value)) if own else None
    # two order statistics a point
    spots = range(2 * len(points))
    ranks = []
    for kind, p in points.values():
        x = F.lit(p) * (F.col("n") - 1)
        ranks += [F.floor(x), F.ceil(x)] if kind == "linear" else [F.bround(x), F.bround(x)]
    none = F.lit(None).cast("double")
    state = big.select(*own, "n", *[c.cast("long").alias(f"rank{i}") for i, c in enumerate(ranks)], *[none.alias(f"{c}{i}") for i in spots for c in ("lo", "hi", "at")])
    # a bracket is open: its ends, null where there is none, lie outside; `at` is the value once it is known
    inside = lambda i: F.col(f"at{i}").isNull() & (F.col(f"lo{i}").isNull() | (F.col("v") > F.col(f"lo{i}"))) & (F.col(f"hi{i}").isNull() | (F.col("v") < F.col(f"hi{i}")))
    grid = F.array(*[F.lit(j / cells) for j in range(cells + 1)])
    pool = v
    while True:
        every = pool.join(_sent(state, many, own), _own_equal(own)).drop(*[f"b{o}" for o in own])
        cut = every.groupBy(*own).agg(*[x for i in spots for x in (F.count_if(inside(i)).alias(f"size{i}"), F.percentile_approx(F.when(inside(i), F.col("v")), grid, F.lit(ACCURACY)).alias(f"grid{i}"))])
        cell = lambda i, by: F.get(f"grid{i}", F.least(F.lit(cells), F.greatest(F.lit(0), F.floor(F.try_divide(F.col(f"rank{i}") * cells, F.col(f"size{i}"))).cast("int") + by)))
        ends = written(_same(state, cut, own).select(*state.columns, *[x for i in spots for x in (cell(i, -1).alias(f"a{i}"), cell(i, 2).alias(f"b{i}"))]))
        every = pool.join(_sent(ends, many, own), _own_equal(own)).drop(*[f"b{o}" for o in own])
        part = lambda i, c: F.count_if(inside(i) & c)
        counts = every.groupBy(*own).agg(*[
            x for i in spots for x in (
                part(i, F.col("v") < F.col(f"a{i}")).alias(f"under{i}"), part(i, F.col("v") == F.col(f"a{i}")).alias(f"on{i}"),
                part(i, (F.col("v") > F.col(f"a{i}")) & (F.col("v") < F.col(f"b{i}"))).alias(f"mid{i}"),
                part(i, (F.col("v") == F.col(f"b{i}")) & (F.col(f"b{i}") > F.col(f"a{i}"))).alias(f"top{i}"), part(i, F.col("v") > F.col(f"b{i}")).alias(f"over{i}"),
            )
        ])
        told = _same(ends, counts, own)
        columns = []
        for i in spots:
            r, known = F.col(f"rank{i}"), F.col(f"at{i}").isNotNull()
            sums = [F.lit(0)]
            for c in ("under", "on", "mid", "top"):
                sums.append(sums[-1] + F.col(f"{c}{i}"))
            below, on, mid, top = (r < s for s in sums[1:])
            pick = lambda *x, known=known, below=below, on=on, mid=mid, top=top: F.when(known, x[0]).when(below, x[1]).when(on, x[2]).when(mid, x[3]).when(top, x[4]).otherwise(x[5])
            a, b, lo, hi = (F.col(f"{c}{i}") for c in ("a", "b", "lo", "hi"))
            columns += [
                pick(r, r, r, r - sums[2], r, r - sums[4]).cast("long").alias(f"rank{i}"), pick(lo, lo, lo, a, lo, b).alias(f"lo{i}"), pick(hi, a, hi, b, hi, hi).alias(f"hi{i}"),
                pick(F.col(f"at{i}"), none, a, none, b, none).alias(f"at{i}"), pick(F.lit(0), F.col(f"under{i}"), F.lit(0), F.col(f"mid{i}"), F.lit(0), F.col(f"over{i}")).alias(f"left{i}"),
            ]
        state = written(told.select(*own, "n", *columns))
        most = state.agg(F.max(F.greatest(*[F.col(f"left{i}") for i in spots]))).first()[0]
        state = state.drop(*[f"left{i}" for i in spots])
        any_of = inside(0)
        for i in spots[1:]:
            any_of = any_of | inside(i)
        pool = written(pool.join(_sent(state, many, own), _own_equal(own)).drop(*[f"b{o}" for o in own]).where(any_of).select(*own, "v"))
        if most <= held:
            break
    every = pool.join(_sent(state, many, own), _own_equal(own)).drop(*[f"b{o}" for o in own])
    spread = every.select(*own, "v", F.explode(F.array_compact(F.array(*[F.when(inside(i), F.struct(F.lit(i).alias("i"), F.col(f"rank{i}").alias("r"))) for i in spots]))).alias("x"))
    cellwise = spread.groupBy(*own, "x.i", "v").agg(F.count("*").alias("c"), F.max("x.r").alias("r"))
    upto = F.sum("c").over(Window.partitionBy(*own, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = cellwise.withColumn("upto", upto).where(F.col("upto") > F.col("r")).groupBy(*own).agg(*[F.min(F.when(F.col("i") == i, F.col("v"))).alias(f"got{i}") for i in spots])
    out = _same(state, found, own)
    stat = lambda i: F.coalesce(f"at{i}", f"got{i}")
    shown = []
    for j, (name, (kind, p)) in enumerate(points.items()):
        x = F.lit(p) * (F.col("n") - 1)
        shown.append((stat(2 * j) + (stat(2 * j + 1) - stat(2 * j)) * (x - F.floor(x) if kind == "linear" else F.lit(0.0))).alias(name))
    large = out.select(*named, *shown)
    return large if small is None else large.unionAll(percentiles(small, keys, value, points))


def _sent(groups: DataFrame, many: int, own: list[str]) -> DataFrame:
    """One row a group, keys renamed; broadcast where it is at most 10,000 rows."""
    out = groups.withColumnsRenamed({o: f"b{o}" for o in own})
    return F.broadcast(out) if many <= 10_000 else out


def _own_equal(own: list[str]) -> Column:
    """Null-safe equality of a group's keys with those of `_sent`."""
    c = F.lit(True)
    for o in own:
        c = c & F.col(o).eqNullSafe(F.col(f"b{o}"))
    return c


def _same(a: DataFrame, b: DataFrame, own: list[str]) -> DataFrame:
    """Two tables of one row a group each, side by side; groups that b lacks stay."""
    other = b.withColumnsRenamed({o: f"b{o}" for o in own})
    return a.join(other, _own_equal(own), "left").drop(*[f"b{o}" for o in own])
