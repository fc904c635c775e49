"""Sinks whose rows are there once, however often a task or a batch is tried again."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from veridix.session import cluster_path, replace_file


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it. `file:/x` is `file:///x`."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """What a task has written."""

    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch_id: str) -> None:
        self.path, self.batch_id = path.rstrip("/"), batch_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        at, root = file_system(self.path)
        name, rows = f"{self.batch_id}-{uuid.uuid4().hex}.jsonl", 0
        at.create_dir(f"{root}/data", recursive=True)
        with at.open_output_stream(f"{root}/data/{name}") as out:
            for b in iterator:
                said = [json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False, default=str) for r in b.to_pylist()]
                out.write("".join(f"{x}\n" for x in said).encode())
                rows += b.num_rows
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        """Names the tasks' files in the batch's manifest, by a rename; a batch that has one already gives its files up."""
        at, root = file_system(self.path)
        parts = [m for m in messages if m is not None]
        final = f"{root}/commits/{self.batch_id}.json"
        if at.get_file_info(final).type != fs.FileType.NotFound:
            return self.abort(messages)
        at.create_dir(f"{root}/commits", recursive=True)
        staged = f"{root}/_{uuid.uuid4().hex}"
        with at.open_output_stream(staged) as out:
            out.write(json.dumps({"batch_id": self.batch_id, "files": [m.file for m in parts], "rows": sum(m.rows for m in parts)}).encode())
        at.move(staged, final)

    def abort(self, messages: list[Part | None]) -> None:
        at, root = file_system(self.path)
        for m in messages:
            if m is not None:
                at.delete_file(f"{root}/data/{m.file}")


class CommittedJson(DataSource):
    """JSON lines in batches: rows are those of the files that a batch's manifest names. Options: path, batch_id."""

    @classmethod
    def name(cls) -> str:
        return "committed_json"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("committed_json appends; it doesn't overwrite")
        batch = self.options.get("batch_id", "")
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError("a batch is named by letters, digits, dots, dashes and underscores")
        return _Writer(self.options["path"], batch)


def append_once(df: DataFrame, path: str, batch_id: str) -> None:
    """Appends a batch of rows as JSON lines. Each attempt of a task has a file of its own; the batch's manifest, which
    becomes visible by one rename, names the files of the attempts that count. Rows of a task that failed and was tried
    again, or of a batch that is written again under its name (a stream's foreachBatch after a restart, say), are there
    once. Any file system that pyarrow opens by address will do."""
    spark = df.sparkSession
    spark.dataSource.register(CommittedJson)
    df.write.format("committed_json").mode("append").option("path", path).option("batch_id", batch_id).save()


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches; no batch, no rows."""
    system, at = cluster_path(spark, f"{path}/commits")
    names = [s.getPath().toString() for s in system.listStatus(at)] if system.exists(at) else []
    files = sorted(f for r in spark.read.schema("files array<string>").json(names).collect() for f in r["files"]) if names else []
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/data/{f}" for f in files])


def commit_json(spark: SparkSession, path: str, payload: object) -> None:
    """A JSON document on the cluster's file system that is there whole or not at all, and replaces the one before."""
    system, at = cluster_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(at)
    try:
        out.write(bytearray(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    finally:
        out.close()
    replace_file(spark, at.toString(), path)
