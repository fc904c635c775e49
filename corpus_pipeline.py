"""A corpus pipeline over `documents`: judge, clean, deduplicate, decontaminate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import cut, read_table, remove_written, tables_written
from veridix.llm.decontam import find_leaks
from veridix.llm.packing import pack_documents, tokenizer_file
from veridix.llm.quality import classify
from veridix.llm.simhash import keep_one_of_each_group
from veridix.llm.templates import drop_recurring_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null texts are judged as empty ones; repeated rows and ids are judged
    each, by the labels of their id; without labels nothing is rejected. Columns beyond those of documents go; an
    empty table gives no rows."""
    return cut(classify(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels")).where("not rejected").select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document that loses lines gets a new length. Every row stays, null texts and ids too.
    Columns beyond those of documents go; an empty table gives no rows."""
    out = drop_recurring_lines(docs.select(*COLUMNS))
    length = F.when(F.col("dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Null texts count as empty, equal rows are one
    group; rows with one id and unlike texts are different documents and stay, as do rows without an id. Columns
    beyond those of documents go; an empty table gives no rows."""
    return keep_one_of_each_group(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, each row judged by its own text, whatever its id. Null and empty texts
    leak nothing and stay. Columns beyond those of documents go; an empty table gives no rows."""
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("text_id"))
    leaks = cut(find_leaks(named.select(F.col("text_id").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("text_id")).distinct())
    return named.join(leaks, "text_id", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed: one row per piece. Null texts are packed as empty ones, repeated rows and
    ids as documents of their own; an empty table gives no rows."""
    return cut(pack_documents(docs, tokenizer_file(), cached_words=120_000, forget=True))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The classifier, the SimHash search and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each one's rows are written before the next one reads them. Stages that end
    in Python write by themselves, in small Arrow batches. What a stage wrote on its way goes when its rows are there."""
    docs = read_table(spark, sf_dir, "documents")
    first = tables_written()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        remove_written(first, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
