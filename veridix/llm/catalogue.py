"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridix.llm import ann, decontam, edits, htmltext, lexical, mixing, mpeg, packing, periodic, quality, simhash, suffix, templates

MODULES = [packing, simhash, suffix, quality, decontam, templates, mixing, mpeg, edits, htmltext, periodic, lexical, ann]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
