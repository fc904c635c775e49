"""What the operators leave on disk and what they shuffle."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from veridix.llm import simhash, templates
from veridix.llm.common import _WRITTEN, cut, remove_written, tables_written

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> int:
    names = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return names.count("shuffle_")


def shuffled_bytes(spark) -> int:
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_cut_table_leaves_no_shuffle_behind(spark):
    had, before = spark.conf.get(CLEAN), shuffle_files(spark)
    spark.conf.set(CLEAN, "false")
    try:
        out = cut(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")))
        assert shuffle_files(spark) <= before and spark.conf.get(CLEAN) == "false"
        assert (out.count(), out.agg(F.sum("n")).first()[0]) == (97, 10_000)
    finally:
        spark.conf.set(CLEAN, had)


def test_texts_that_keep_their_lines_are_not_shuffled(spark, tmp_path):
    """300 texts of 40 KB whose one long line is their own, and three that share a line."""
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choices("ghijklmnopqrstuvwxyz", k=9)) for _ in range(4000))) for i in range(300)]
    rows += [(300 + i, f"{'abc'[i]} own words stand here alone\nplease share this page with all your friends") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs, before = spark.read.parquet(str(tmp_path / "docs")), shuffled_bytes(spark)
    got = {r["doc_id"]: (r["text"], r["dropped"]) for r in templates.drop_recurring_lines(docs).collect()}
    assert got == {i: (t, 0) if i <= 300 else (t.split("\n")[0], 1) for i, t in rows}
    assert shuffled_bytes(spark) - before < 1_000_000  # all texts: 12 MB


def test_only_what_is_still_read_stays_written(spark):
    """Line dedup keeps its marks, near_dedup its groups; another thread's tables and those before stay."""
    rows = [(i, f"{'abcd'[i]} own words stand here alone\nplease share this page with all your friends") for i in range(4)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    with ThreadPoolExecutor(1) as pool:
        at, other = tables_written(), pool.submit(cut, docs).result()
        lines = templates.drop_recurring_lines(docs)
        assert len([n for n in _WRITTEN if n >= at]) == 2
        kept = simhash.keep_one_of_each_group(docs)
        assert len([n for n in _WRITTEN if n >= at]) == 3
        assert (lines.agg(F.sum("dropped")).first()[0], kept.count(), other.count()) == (3, 1, 4)
        remove_written(at)
        assert other.count() == docs.count() == 4
