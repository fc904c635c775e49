"""Global order without a task that holds all rows: positions, seeded shuffles, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridix.session import written


def positions(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """df with its rows' numbers from 0 in the given order (equal rows in any order among themselves).

    Rows are dealt out by ranges of the order and written, so the ranges hold for both passes: the sizes of the
    ranges, a row each, give every range's first number, and rows are numbered inside their range.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(cols)])
    own = [f"__o{i}" for i in range(len(cols))]
    dealt = written(keyed.repartitionByRange(*own).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__part").orderBy(*own)
    out = dealt.withColumn("__r", F.row_number().over(w)).join(F.broadcast(before), "__part")  # a row a partition
    return out.select(*df.columns, (F.col("__r") + F.col("__before") - 1).alias(name))


def group_positions(df: DataFrame, group: str, key: str, name: str = "position", buckets: int = 4096) -> DataFrame:
    """df with numbers from 0 inside each group, in the order of (a bucket of the key's MD5, key): a dense index whose
    order carries no meaning, made without gathering a group. Keys are distinct within their group."""
    digits = len(f"{buckets - 1:x}")
    b = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, digits), 16, 10).cast("int")
    keyed = df.withColumn("__b", b)
    sizes = keyed.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__b").orderBy(key)))
    out = ranked.join(before, ranked[group].eqNullSafe(before["__g"]) & (ranked["__b"] == before["__c"]))
    return out.select(*df.columns, (F.col("__r") + F.col("__before") - 1).alias(name))


def seeded_hash(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_shuffle(df: DataFrame, keys: list[str], seed: int, name: str = "position") -> DataFrame:
    """df in an order that seed and keys alone decide, as numbers from 0."""
    return positions(df, [seeded_hash(seed, *keys), *keys], name)


def pages(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """A paged scan: df with its page and place on it, pages of `size` rows in the given order."""
    if size <= 0:
        raise ValueError("a page has at least one row")
    out = positions(df, order, "__p")
    return out.select(*df.columns, F.floor(F.col("__p") / size).cast("long").alias("page"), (F.col("__p") % size).cast("long").alias("place"))


def first_of(df: DataFrame, position: str, n: int) -> DataFrame:
    """The rows of the first n positions; fewer than n raise."""
    kept = df.where(F.col(position) < n)
    have = kept.count()
    if have != n:
        raise ValueError(f"asked for {n} rows, there are {have}")
    return kept


def concatenated(parts: dict[str, DataFrame], name: str = "run") -> DataFrame:
    """Rows of all parts with the part's name; columns that a part lacks are null."""
    out = None
    for k, df in parts.items():
        own = df.withColumn(name, F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to put together")
    return out
