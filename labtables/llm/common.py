"""Shared plumbing: table reads, tables written in the cluster's shared folder, Arrow batches in tasks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import settings

#: Characters of text that a task works on at once; bounds what a Python worker holds.
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, pruned to `columns` (all if none)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset
    and the master is local, a temporary folder is set; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: A write's shuffle files go at its end, not when the driver happens to collect its garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: its lineage is cut and its files
    outlive any executor; its shuffle files go at once. The files are removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/labtables-{what}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    atexit.register(_remove, spark, path)
    with settings(spark, CLEANED):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.written_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose `text` column has about `limit` bytes (a longer single
    text stays whole), so that working arrays keep one size whatever the batch. What a task's batches
    took is given back to the system after the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most `size` where the session leaves Spark's default: both sides of a task hold
    a batch or two, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, size)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their first, second ... bytes, after the length of the planes."""
    planes = np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeezed(texts: list[bytes]) -> list[bytes]:
    """Texts as zstd frames behind their length."""
    return [len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in texts]


def unsqueezed(frames: list[bytes]) -> list[bytes]:
    return [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in frames]


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; LABTABLES_TOKENIZERS names another folder."""
    folder = os.environ.get("LABTABLES_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
