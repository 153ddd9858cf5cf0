"""Exploring a table: filters, search, sorting, paging, projection, overlays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import NUMBER_FORM, natural_key, trim_all
from ..shared import cut
from . import categories


def with_position(df: DataFrame, order: list, out: str = "position") -> DataFrame:
    """Each row's place, from 1, in the order of all rows: a range sort, checkpointed so that its
    partitions stay, and the rows of the partitions before; no task sees all rows."""
    placed = cut(df.orderBy(*order)).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33).alias("__part")
    before, total = [], 0
    for r in sorted(placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((r["__part"], total))
        total += r.n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__part long, __start long"))
    joined = placed.withColumn("__part", part).join(starts, "__part")
    return joined.withColumn(out, F.col("__start") + F.col("__id") - F.shiftleft("__part", 33) + 1).drop("__part", "__start", "__id")


def multi_filter(df: DataFrame, choices: Mapping[str, Sequence]) -> DataFrame:
    """Rows that have one of the chosen values in every column chosen for; an empty choice is none, and
    null never matches."""
    tests = [F.col(c).isin(list(v)) for c, v in choices.items() if len(v)]
    return df.filter(reduce(and_, tests)) if tests else df


def text_search(df: DataFrame, query: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows with the query, whatever its case, somewhere in one of the columns; a blank query keeps all."""
    wanted = (query or "").strip().lower()
    return df.filter(reduce(or_, [F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False)) for c in columns])) if wanted else df


def glossary_search(df: DataFrame, query: str | None, columns: Sequence[str], number: str) -> DataFrame:
    """text_search, or a number that is exactly the query."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return df
    tests = [F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False)) for c in columns]
    return df.filter(reduce(or_, [*tests, F.col(number).cast("string") == wanted]))


def plottable(df: DataFrame, x: str, y: str, x_log: bool = False, y_log: bool = False) -> DataFrame:
    """Rows with both values, positive ones where a numeric axis is logarithmic."""
    tests = []
    for name, log in ((x, x_log), (y, y_log)):
        tests.append(F.col(name).isNotNull())
        if log and df.schema[name].dataType.simpleString() != "string":
            tests.append(F.col(name) > 0)
    return df.filter(reduce(and_, tests))


def in_range(df: DataFrame, column: str, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Rows within the range, and one row counting kept and dropped ones."""
    inside = F.coalesce(F.col(column).between(low, high), F.lit(False))
    return df.filter(inside), df.agg(F.count_if(inside).alias("kept"), F.count_if(~inside & F.col(column).isNotNull()).alias("dropped"))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The known ones of the columns, each once, in the order given."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def sort_order(df: DataFrame, column: str, descending: bool, row: str) -> list[Column]:
    """Nulls last either way; text by natural key, case and accents aside; ties in row order."""
    is_text = df.schema[column].dataType.simpleString() == "string"
    key = F.collate(natural_key(column), "UNICODE_CI_AI") if is_text else F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(row).asc()]


def natural_sort(df: DataFrame, column: str, descending: bool = False, row: str = "row_index") -> DataFrame:
    return df.orderBy(*sort_order(df, column, descending, row))


#: Rows before a page up to which a sort that keeps the first rows of each task finds it.
DEEP = 100_000


def page(df: DataFrame, number: int, size: int, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """One page of the sorted rows, and a row of items, pages, page, first and last item. The page is
    clamped into range, and a size under 1 is 1. Of a page near the begin only the rows up to it are
    kept while sorting; one beyond DEEP rows is cut out of the order of all rows, so that no task gets
    all that precedes it."""
    size = max(1, int(size))
    items = df.count()
    pages = max(1, -(-items // size))
    at = min(max(1, int(number)), pages)
    before = (at - 1) * size
    if before <= DEEP:
        rows = df.orderBy(*order).offset(before).limit(size)
    else:
        rows = with_position(df, list(order), "__position").filter(F.col("__position").between(before + 1, before + size)).orderBy("__position").drop("__position")
    first = 0 if items == 0 else before + 1
    info = df.sparkSession.createDataFrame([(items, pages, at, first, min(at * size, items))], "items long, pages long, page long, first long, last long")
    return rows, info


def table_view(
    df: DataFrame, choices: Mapping[str, Sequence], query: str | None, search_in: Sequence[str], columns: Sequence[str], sort_by: str | None, descending: bool = False, row: str = "row_index"
) -> DataFrame:
    """Filter, search, sort and project. A sort column that isn't shown is ignored."""
    out = text_search(multi_filter(df, choices), query, search_in)
    shown = [c for c in dict.fromkeys(columns) if c in df.columns]
    return (natural_sort(out, sort_by, descending, row) if sort_by in shown else out.orderBy(row)).select(*shown)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per row and column with a value."""
    return df.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


def flatten_points(samples: DataFrame, paper: str, sample: str, features: Sequence[str], points: str = "points", seq: str = "seq") -> DataFrame:
    """Samples with arrays of points (map<feature, value>) as one row per point and every feature as a
    column; samples of one name are one, their points in order. A feature called source becomes
    source_value, as source is the paper."""
    rows = samples.select(paper, sample, F.col(seq).alias("sample_pos"), F.posexplode(points).alias("pos", "point"))
    order = Window.partitionBy(paper, sample).orderBy("sample_pos", "pos")
    named = [F.try_element_at("point", F.lit(f)).alias("source_value" if f == "source" else f) for f in features]
    return rows.select(paper, sample, (F.row_number().over(order) - 1).alias("point_no"), *named)


def infer_columns(cells: DataFrame, feature: str, value: str, order: str) -> DataFrame:
    """The features in order of first appearance, and whether all their values are numbers of the strict
    form."""
    is_number = trim_all(value).rlike(NUMBER_FORM)
    found = cells.groupBy(feature).agg(F.min(order).alias("first"), F.count(value).alias("filled"), F.coalesce(F.bool_and(F.when(F.col(value).isNotNull(), is_number)), F.lit(False)).alias("numeric"))
    minor = F.col("first") if categories.is_number(found, "first") else F.lit(0)
    placed = categories.in_places(found, F.lit(0), minor, [F.col("first"), F.col(feature)], "position")
    return placed.select(feature, "first", "numeric", (F.col("position") + 1).alias("position"))


def coalesce_check(df: DataFrame, stored: str, inputs: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """One row: rows, and rows where a stored fallback column is not the first of its inputs."""
    expected = F.coalesce(*[F.col(c) for c in inputs])
    same = (F.col(stored).isNull() & expected.isNull()) | F.coalesce(F.abs(F.col(stored) - expected) <= tolerance, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("mismatches"))


def overlay(base: DataFrame, own: DataFrame, choices: Mapping[str, Sequence], tag: str = "origin") -> DataFrame:
    """The filtered table with the user's rows under it; filters don't apply to those, and columns
    they lack are null."""
    return multi_filter(base, choices).withColumn(tag, F.lit("dataset")).unionByName(own.withColumn(tag, F.lit("user")), allowMissingColumns=True)


def resolve_point(points: DataFrame, clicks: DataFrame, row: str = "row_id", x: str = "x", y: str = "y") -> DataFrame:
    """For each click the source row: by id, x and y, else by id and x (the lowest y)."""
    exact = points.select(row, x, y, F.lit(True).alias("exact")).distinct()
    loose = points.groupBy(row, x).agg(F.min(y).alias("y_near"))
    return clicks.join(exact, [row, x, y], "left").join(loose, [row, x], "left").withColumn("found_y", F.when(F.col("exact"), F.col(y)).otherwise(F.col("y_near"))).drop("exact", "y_near")
