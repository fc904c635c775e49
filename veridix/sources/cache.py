"""A stored cache of what addresses hold, addressed by their hash, and files told by the hash of their bytes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.functions.text import cache_key_sha256
from veridix.operators.retrieval import with_retries
from veridix.session import cluster_path

ENTRY = "key string, url string, content binary, sha256 string, error string"


class ContentCache:
    """Entries under `path`, a folder of the cluster's file system: one row a fetched address, its key (of the address), its
    bytes and their SHA-256, in batches that each became visible by one rename. Of equal keys the newest batch counts."""

    def __init__(self, spark: SparkSession, path: str, key: Callable[[Column], Column] = cache_key_sha256, check: Callable[[bytes], bool] | None = None) -> None:
        self.spark, self.path, self.key, self.check = spark, path.rstrip("/"), key, check

    def batches(self) -> list[str]:
        fs, at = cluster_path(self.spark, f"{self.path}/entries")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def entries(self) -> DataFrame:
        """key, url, content, sha256, batch of all that was fetched; errors are not entries."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], "key string, url string, content binary, sha256 string, batch string")
        read = self.spark.read.schema(ENTRY + ", batch string").option("basePath", f"{self.path}/entries").parquet(*[f"{self.path}/entries/{n}" for n in names])
        return read.where("error is null").drop("error")

    def held(self, urls: DataFrame) -> DataFrame:
        """url, key, content of the addresses that have an entry whose bytes are those that were stored."""
        wanted = self._wanted(urls).select("url", "key")
        own = self.entries().join(wanted.select("key"), "key", "left_semi").where(F.sha2("content", 256) == F.col("sha256"))
        newest = own.groupBy("key").agg(F.max_by("content", "batch").alias("content"))
        return wanted.join(newest, "key").select("url", "key", "content")

    def _wanted(self, urls: DataFrame) -> DataFrame:
        host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
        return urls.where("url is not null").select("url").distinct().select("url", self.key(F.col("url")).alias("key"), host.alias("host"))

    def fetch(self, urls: DataFrame, get: Callable[[str], bytes], tasks_a_host: int = 2, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """urls (url) -> url, key, content, error, cached: every address once; `get` is called for those alone that no valid
        entry holds, and one host is asked by at most tasks_a_host tasks, each one address after another.

        What `get` returns is written beside the entries and renamed among them when all of it is there: a run that breaks
        leaves no entry, and none is ever half. An address that fails after its attempts, or whose bytes fail the cache's
        check, has its error, no content, and is asked again next time. Null addresses are left out. The fetch runs at
        once; its result is read from the stored entries.
        """
        if tasks_a_host < 1:
            raise ValueError("a host needs at least one task")
        check = self.check
        wanted = self._wanted(urls)
        have = self.held(urls).select("key")
        missing = wanted.join(have, "key", "left_anti").withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(tasks_a_host)))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for key, url in zip(pdf["key"], pdf["url"], strict=True):
                    body, error = None, None
                    try:
                        body = bytes(with_retries(lambda url=url: get(url), attempts, sleep))
                        if check is not None and not check(body):
                            body, error = None, "the content fails the check"
                    except Exception as e:  # noqa: BLE001  the record is the result
                        error = f"{type(e).__name__}: {e}"
                    yield pd.DataFrame({"key": [key], "url": [url], "content": [body], "error": [error]})

        got = missing.repartition("host", "slot").select("key", "url").mapInPandas(run, "key string, url string, content binary, error string")
        before = self.batches()
        number = int(before[-1].split("=")[1].split("-")[0]) + 1 if before else 0
        name = f"{number:012d}-{uuid.uuid4().hex}"
        staged, final = f"{self.path}/_writing/{name}", f"{self.path}/entries/batch={name}"
        fs, at = cluster_path(self.spark, staged)
        try:
            got.select("key", "url", "content", F.sha2("content", 256).alias("sha256"), "error").write.parquet(staged)
        except Exception:
            fs.delete(at, True)
            raise
        _, to = cluster_path(self.spark, final)
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise OSError(f"{staged} could not be renamed")
        batch = self.spark.read.schema(ENTRY).parquet(final)
        new = batch.select("key", F.lit(True).alias("new"), "error")
        out = wanted.select("url", "key").join(self.held(urls).select("key", "content"), "key", "left").join(new, "key", "left")
        return out.select("url", "key", "content", "error", F.col("new").isNull().alias("cached"))


# ---------------------------------------------------------------- hashes of whole files

#: Bytes of a piece of a file; the hash of a file is the hash of its pieces' hashes.
PIECE = 1 << 20


def file_hashes(spark: SparkSession, path: str, pattern: str = "*", piece: int = PIECE) -> DataFrame:
    """name (relative to path), length, sha256, tree_sha256 of every file under a folder that fits the pattern.

    Files are read as Spark reads any (`binaryFile`, a row a file of 2 GB at most; files of no bytes have no row). sha256 is the plain hash of the bytes. tree_sha256 is
    SHA-256 over the hexadecimal hashes of the file's pieces of `piece` bytes, joined by line ends."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    root = cluster_path(spark, path)[1].toUri().getPath().rstrip("/")
    name = F.substring(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), len(root) + 2, 1 << 20)
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / piece).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring("content", i * piece + 1, F.lit(piece)), 256))
    return files.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), F.sha2(F.array_join(pieces, "\n"), 256).alias("tree_sha256"))


def pinned(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """found (name, sha256) as it is, if it is what the manifest (name, sha256) says: a file that differs, is missing or is
    not in the manifest raises when the rows are read."""
    said = manifest.select("name", F.col("sha256").alias("__said"))
    both = found.join(said, "name", "full")
    what = F.when(F.col("sha256").isNull(), "is missing").when(F.col("__said").isNull(), "is not in the manifest").when(F.col("sha256") != F.col("__said"), "has changed")
    ok = F.when(what.isNotNull(), F.raise_error(F.concat("name", F.lit(" "), what)).cast("string")).otherwise(F.col("sha256"))
    return both.withColumn("sha256", ok).select(*found.columns)
