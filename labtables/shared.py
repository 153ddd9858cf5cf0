"""What a cluster's machines share: checkpoints in the common folder, and this package."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def common_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where that is unset and the master is
    local, a temporary folder is set; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_CLEARED: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the common folder. The application's checkpoints are removed when it ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(common_folder(spark))
    at = context.getCheckpointDir()  # Spark's own folder for this application in the common one
    if at not in _CLEARED:
        _CLEARED.add(at)
        atexit.register(_remove, spark, at)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the common folder, removed when the application ends."""
    path = f"{common_folder(spark)}/labtables-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written in the common folder and read back, for what is read several times."""
    path = scratch(df.sparkSession, what)
    with settings(df.sparkSession, SPARE):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: For writes of large tables: rows that are dealt by a part of the keys of a join stay where they are, a
#: write's shuffle files go at its end, and folders of values are written side by side, not after a sort.
SPARE = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Planner settings that hold for the writes inside, and are as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Bytes of input files for each partition of what is sorted, so that a task sorts as much of a large table as of a small one.
PART_BYTES = 4_000_000


def parts_of(*tables: DataFrame) -> int | None:
    """Into how many partitions rows that come from these tables are dealt: by the size of the files that
    they read, no fewer than there are cores; None where they read no files."""
    context, total = tables[0].sparkSession.sparkContext, 0
    for path in {f for df in tables for f in df.inputFiles()}:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        total += at.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return max(context.defaultParallelism, -(-total // PART_BYTES)) if total else None


def deal(df: DataFrame, parts: int | None, *keys) -> DataFrame:
    """`df` dealt by keys into `parts` partitions, or as many as the session has set."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that tasks can import it wherever
    the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "labtables.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
