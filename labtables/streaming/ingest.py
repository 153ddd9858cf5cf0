"""Records that arrive as files, imported once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CORRUPT = "_corrupt_record"
WELL_NAMED = "^[0-9a-f]{32}$"


def watch_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of JSON records with well-formed ids (32 hexadecimal digits). What is read, cannot be parsed or
    is badly named is counted in the progress of the stream's query, see import_counts."""
    read = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(folder)
    corrupt, named = F.col(CORRUPT).isNotNull(), F.coalesce(F.col("record_id").rlike(WELL_NAMED), F.lit(False))
    seen = read.observe("read", F.count(F.lit(1)).alias("seen"), F.count_if(corrupt).alias("unreadable"), F.count_if(~corrupt & ~named).alias("badly_named"))
    return seen.filter(~corrupt & named).drop(CORRUPT)


def import_stream(records: DataFrame, store: str, checkpoint: str, existing: DataFrame | None = None) -> StreamingQuery:
    """Appends each record whose id the stream has not had yet to `store`. Ids are held in the stream's
    state, by partition, so a batch costs what it brings, however much is stored; state and file sink
    go on from `checkpoint` after a failure, so that no record is stored twice and none is lost.
    `existing` (record_id) are ids of another origin, which are left out too."""
    fresh = records.dropDuplicates(["record_id"])
    if existing is not None:
        fresh = fresh.join(existing.select("record_id").distinct(), "record_id", "left_anti")
    counted = fresh.observe("import", F.count(F.lit(1)).alias("stored"))
    return counted.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_counts(query: StreamingQuery) -> dict[str, int]:
    """seen, unreadable, badly_named and stored records over the batches of a query that its progress holds."""
    out = dict.fromkeys(("seen", "unreadable", "badly_named", "stored"), 0)
    for progress in query.recentProgress:
        for metrics in progress["observedMetrics"].values():
            for name, value in metrics.asDict().items():
                out[name] += value
    return out
