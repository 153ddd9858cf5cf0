"""Measurement series: long points on a chosen axis, what a logarithmic axis drops, packed lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import axis_transform, log10_positive
from .explore import melt


def series_points(df: DataFrame, row: str, columns: dict[str, float], mode: str, tg: str | None = None) -> DataFrame:
    """Points (row, t, x, y, log_y) of the measured columns at their temperatures; points whose x is
    undefined or whose y is not positive are dropped."""
    ids = [row] + [tg] * bool(tg)
    at = F.create_map(*[F.lit(v) for name, t in columns.items() for v in (name, float(t))])
    points = melt(df, ids, list(columns), "measure", "y").withColumn("t", F.try_element_at(at, F.col("measure")))
    points = points.withColumn("x", axis_transform(mode, "t", tg)).withColumn("log_y", log10_positive("y"))
    return points.filter("x is not null and log_y is not null").select(row, "t", "x", "y", "log_y")


def series_report(df: DataFrame, row: str, columns: dict[str, float], mode: str, tg: str | None = None) -> DataFrame:
    """One row: rows considered, rows without Tg (where the axis needs it), non-positive points, points
    without x, rows drawn. Rows without points count as considered and not as drawn."""
    needs = mode in ("tg_ratio", "tg_shifted")
    at = F.create_map(*[F.lit(v) for name, t in columns.items() for v in (name, float(t))])
    lacking = F.col(tg).isNull() if needs else F.lit(False)
    every = df.withColumn("__lacking", lacking).unpivot([row, "__lacking", *[tg] * bool(tg)], list(columns), "measure", "y")
    every = every.withColumn("x", axis_transform(mode, F.try_element_at(at, F.col("measure")), tg))
    has, positive = F.col("y").isNotNull() & ~F.col("__lacking"), F.col("y") > 0
    per_row = every.groupBy(row).agg(
        F.max("__lacking").alias("lacking"), F.count_if(has & ~positive).alias("low"), F.count_if(has & positive & F.col("x").isNull()).alias("no_x"), F.count_if(has & positive & F.col("x").isNotNull()).alias("good")
    )
    return per_row.agg(
        F.count_if(~F.col("lacking")).alias("considered"), F.count_if("lacking").alias("without_tg"), F.coalesce(F.sum("low"), F.lit(0)).alias("non_positive"),
        F.coalesce(F.sum("no_x"), F.lit(0)).alias("undefined_x"), F.count_if(F.col("good") > 0).alias("drawn"),
    )


def log_axis_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the values considered and those a logarithmic axis drops; nothing is clamped."""
    long = df.unpivot([], list(columns), "column", "v")
    return long.groupBy("column").agg(F.count("v").alias("considered"), F.count_if(F.col("v") <= 0).alias("dropped"))


def pack_lines(points: DataFrame, slot: str, sample: str, order: str, x: str, y: str) -> DataFrame:
    """Per slot the samples' points as one pair of arrays, a null between samples and none at the ends.
    A slot is one of a few colours, so its arrays are what one trace holds."""
    rows = line_rows(points, slot, sample, order, x, y)
    entry = F.struct("sample", "gap", "o", "x", "y")
    packed = rows.groupBy(slot).agg(F.sort_array(F.collect_list(entry)).alias("l"), F.count_if("gap").alias("samples"))
    inner = F.slice("l", 1, F.size("l") - 1)  # but for the last sample's gap
    pick = lambda name: F.transform(inner, lambda p: p[name])
    return packed.select(slot, F.col("samples").cast("long").alias("samples"), pick("x").alias("xs"), pick("y").alias("ys"))


def line_rows(points: DataFrame, slot: str, sample: str, order: str, x: str, y: str) -> DataFrame:
    """Rows (slot, sample, gap, o, x, y) whose order by slot, sample, gap and o is that of a packed line:
    the points, and after each sample's a row with gap and nulls. For slots of any size."""
    rows = points.select(slot, F.col(sample).alias("sample"), F.lit(False).alias("gap"), F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("o", "x", "y")]
    return rows.union(rows.select(slot, "sample").distinct().select(slot, "sample", F.lit(True).alias("gap"), *none))
