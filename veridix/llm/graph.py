"""Connected components by large-star and small-star rounds; every round ends in a written table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridix.llm.common import cut


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of each batch: a star around each batch-local smallest id."""
    for pdf in parts:
        up: dict[int, int] = {}

        def find(x: int, up: dict[int, int] = up) -> int:
            root = x
            while (p := up.get(root, root)) != root:
                root = p
            while up.get(x, x) != root:
                up[x], x = root, up[x]
            return root

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        members = list(up)
        yield pd.DataFrame({"a": [find(x) for x in members], "b": members}, dtype="int64")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (id, root): every id that an edge names, with the smallest id reachable.

    Self-loops, repeated edges and either direction are allowed; null ends are dropped; no edges give no rows.
    A hub's neighbours are reduced by partial aggregation and joins that AQE can split; nothing is gathered
    in one task or on the driver. Each round is written to the shared folder.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = cut(e.repartition("b").mapInPandas(_contract, "a long, b long"))
    for _ in range(max_rounds):
        seen = e.select(F.col("b").alias("x"), F.lit(1).alias("member"), F.lit(0).alias("root")).unionAll(e.select(F.col("a").alias("x"), F.lit(0).alias("member"), F.lit(1).alias("root")))
        unsettled = seen.groupBy("x").agg(F.sum("member").alias("m"), F.max("root").alias("r")).where("m > 1 or (m > 0 and r > 0)")
        if unsettled.isEmpty():
            return e.select(F.col("b").alias("id"), F.col("a").alias("root")).unionAll(e.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(low.select(F.col("m").alias("a"), "b"))
        e = cut(small.distinct().mapInPandas(_contract, "a long, b long"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
