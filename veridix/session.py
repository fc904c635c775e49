"""Session helpers and the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; a folder of our own in local mode, the warehouse elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = "file://" + tempfile.mkdtemp(prefix="veridix-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_veridix_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/veridix-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(remove_written)
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: the lineage ends there and its rows are settled."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written() -> None:
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone
            return


def cluster_path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's own file systems, for names and renames; rows go through Spark."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder over whatever has the name: readers see the old or the new, whole."""
    jvm = spark.sparkContext._jvm
    _, a = cluster_path(spark, source)
    _, b = cluster_path(spark, target)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(a, b, over)
