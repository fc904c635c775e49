"""What the operators of this subpackage share: tables, cut lineage, vectorised words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: [\x20\x09-\x0D]
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
TERM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    TERM[_a:_b] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_WRITTEN: dict[int, tuple[SparkSession, str, int]] = {}
_NEXT, _LOCK = [0], threading.Lock()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about `most` bytes of strings, a longer row alone, so a function's memory doesn't depend on
    how many rows the session puts in a batch (batches themselves are bounded by spark.sql.execution.arrow.maxBytesPerBatch)."""
    for b in batches:
        size = np.ones(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def settle() -> None:
    """Give memory that a task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="veridix-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_veridix_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch in what cut() runs: less in flight between the JVM and Python than the session's setting.
BATCH_ROWS = 200
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What a query shuffled goes when the query ends, and not when the driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile have Arrow batches of BATCH_ROWS; the session's own setting is there again afterwards."""
    had = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(had), BATCH_ROWS) if int(had) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, had)


def cut(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: the lineage ends there. While it is written Arrow
    batches are small; the session's own setting is there again afterwards. Readers decode whole row groups where they
    have fewer than 4096 rows: wide rows need groups of at most group_rows. What was shuffled for df goes with that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridix-{uuid.uuid4().hex}"
    cleans = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        out = df.write
        if group_rows is not None:
            out = out.option("parquet.block.row.count.limit", str(group_rows))
        with small_batches(spark):
            out.parquet(path)
    finally:
        spark.conf.set(_CLEAN, cleans)
    with _LOCK:
        if not _NEXT[0]:
            atexit.register(remove_written, every=True)
        _WRITTEN[_NEXT[0]] = (spark, path, threading.get_ident())
        _NEXT[0] += 1
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables there have been, the number of the next one."""
    return _NEXT[0]


def remove_written(first: int = 0, keep: int = 0, every: bool = False) -> None:
    """Delete the tables that cut() wrote in this thread, from number `first` on but for the last `keep`; those of every
    thread when the driver ends."""
    own = sorted(n for n, (_, _, thread) in list(_WRITTEN.items()) if n >= first and (every or thread == threading.get_ident()))
    for spark, path, _ in [_WRITTEN.pop(n) for n in own[: max(0, len(own) - keep)]]:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone
            return


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and n+1 offsets, without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    a = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return a, off - off[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of True that don't cross a row's end."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n + 1:
        n = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("i", _INVERSE)):
                out = np.ones(1, np.uint64)
                step = np.uint64(base)
                while len(out) < n:
                    out = np.concatenate([out, out * step])
                    step = step * step
                _POWERS[key] = out
    return _POWERS["p"], _POWERS["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_sums(a: np.ndarray) -> np.ndarray:
    """n+1 running sums of (byte+1) * base**position modulo 2**64."""
    p, _ = _powers(len(a))
    out = np.zeros(len(a) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    _, inv = _powers(len(sums) - 1)
    with np.errstate(over="ignore"):
        return mix64((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def hash_bytes(words: list[bytes]) -> np.ndarray:
    """span_hash of separate byte strings, for lexicons built on the driver."""
    joined = np.frombuffer(b"".join(words), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return span_hash(prefix_sums(joined), off[:-1], off[1:])


def group_sum(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, weights=values, minlength=n)


#: Bits of the map of wanted keys: 2 MB, sent to all tasks whatever the input.
MAP_BITS = 24


def flagged(df: DataFrame, key: str, wanted: DataFrame, name: str = "__maybe") -> DataFrame:
    """df with a flag: false where its key is surely none of wanted's (a column of the same name). A bitmap over key
    hashes, built by aggregation and broadcast (its size is fixed). It only spares shuffles; an exact step follows."""
    spot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - MAP_BITS)
    bits = wanted.select((spot(key) + 1).alias("__s")).groupBy(F.bitmap_bucket_number("__s").alias("__k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__s")).alias("__m"))
    byte = F.conv(F.hex(F.substring(F.col("__m"), F.shiftright(F.col("__at"), 3).bitwiseAND(4095).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.expr("shiftrightunsigned(__b, cast(__at & 7 as int)) & 1") == 1
    joined = df.withColumn("__at", spot(key)).join(F.broadcast(bits), F.floor(F.col("__at") / 32768) + 1 == F.col("__k"), "left")
    return joined.withColumn("__b", byte).withColumn(name, F.coalesce(hit, F.lit(False))).drop("__at", "__k", "__m", "__b")


def maybe(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose key may be one of wanted's; see flagged."""
    return flagged(df, key, wanted).where("__maybe").drop("__maybe")
