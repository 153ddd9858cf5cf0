"""Pairwise-complete correlation: matrices, feature by target tables, rankings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import log10_positive, yes_no


def finite(c: Column) -> Column:
    """A number, null if it is not finite."""
    number = c.cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def _r(x: Column, y: Column) -> tuple[Column, Column]:
    """Pearson r over rows that have both, null under two rows or without variance; and their number.
    Values that aren't finite are missing ones."""
    x, y = finite(x), finite(y)
    n = F.regr_count(y, x)
    root = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    # sums of a constant may differ from zero by rounding
    for a, b in ((x, y), (y, x)):
        root = F.when(F.min(F.when(b.isNotNull(), a)) < F.max(F.when(b.isNotNull(), a)), root)
    return F.when((n >= 2) & (root > 0), F.greatest(F.least(F.try_divide(F.regr_sxy(y, x), root), F.lit(1.0)), F.lit(-1.0))), n


#: Pairs of columns whose sums are columns of one aggregate; more are summed as blocks of a matrix, so that
#: no plan grows with the square of the number of columns.
PAIRS_A_PLAN = 500
#: Below this share of its sum of squares a variance is rounding.
ROUNDING = 1e-13
#: Parts in which the blocks of all tasks are added before they meet.
MERGED_PARTS = 64


def corr_matrix(df: DataFrame, columns: Sequence[str], on_undefined: str = "null") -> DataFrame:
    """(label_a, label_b, r, n) for all ordered pairs, the diagonal exactly 1; undefined cells are null,
    or an error. One pass over the table, whatever the number of columns."""
    pairs = [*((c, c) for c in columns), *combinations(columns, 2)]
    if len(pairs) <= PAIRS_A_PLAN:
        out = _corr_cells(df, pairs)
    else:
        cells = corr_blocks(df, columns, columns)
        same = F.col("label_a") == F.col("label_b")
        out = cells.withColumn("r", F.when(same, 1.0).otherwise(F.col("r")))
    if on_undefined == "error":
        out = out.withColumn("r", F.coalesce("r", F.raise_error(F.concat_ws(" ", F.lit("no correlation of"), "label_a", "label_b")).cast("double")))
    return out


class Moments:
    """Pairwise-complete counts, means and central sums of all (row, column) pairs of two lists of columns."""

    def __init__(self, n: np.ndarray, parts: np.ndarray):
        self.n, self.parts = n, parts  # mean of x, mean of y, sums of xx, yy and xy about the means

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        """Of rows by columns, NaN where a value is missing. Values are moved by their column's first
        one, so that sums don't cancel and a constant column has none."""
        sides = []
        for v in (x, y):
            there = ~np.isnan(v)
            first = np.where(there.any(0), v[there.argmax(0), np.arange(v.shape[1])], 0.0)
            sides.append((there.astype(float), np.where(there, v - first, 0.0), first))
        (mx, vx, ox), (my, vy, oy) = sides
        n = mx.T @ my
        safe = np.maximum(n, 1)
        sx, sy = vx.T @ my, mx.T @ vy
        qx, qy = np.square(vx).T @ my, mx.T @ np.square(vy)
        cx, cy = qx - sx * sx / safe, qy - sy * sy / safe
        cx, cy = np.where(cx <= ROUNDING * qx, 0.0, cx), np.where(cy <= ROUNDING * qy, 0.0, cy)
        return cls(n, np.stack([ox[:, None] + sx / safe, oy[None, :] + sy / safe, cx, cy, vx.T @ vy - sx * sy / safe]))

    def add(self, other: Moments) -> Moments:
        """Both together, by the differences of their means."""
        n = self.n + other.n
        safe = np.maximum(n, 1)
        share = self.n * other.n / safe
        means = []
        for k in (0, 1):
            d = other.parts[k] - self.parts[k]
            means.append(np.where(np.abs(d) <= 4e-16 * np.maximum(np.abs(other.parts[k]), np.abs(self.parts[k])), 0.0, d))
        dx, dy = (np.where(share > 0, d, 0.0) for d in means)
        parts = self.parts + other.parts
        for k, d in ((0, means[0]), (1, means[1])):
            parts[k] = np.where(self.n == 0, other.parts[k], self.parts[k] + np.where(other.n == 0, 0.0, d) * other.n / safe)
        parts[2:] += np.stack([dx * dx, dy * dy, dx * dy]) * share
        return Moments(n, parts)

    def rows(self, names: list[str], part: int) -> pa.RecordBatch:
        """A row per row of the blocks: its index, the writing part, and its numbers as bytes."""
        blobs = [np.concatenate([self.n[None, i], self.parts[:, i]]).tobytes() for i in range(len(self.n))]
        return pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array([part] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names)

    @classmethod
    def read(cls, blob: bytes) -> Moments:
        a = np.frombuffer(blob).reshape(6, 1, -1)
        return cls(a[0], a[1:])


def corr_blocks(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(label_a, label_b, r, n) of each left column with each right one, over rows that have both. A task
    keeps one block of sums for all pairs; blocks are added by row of the matrix, first in MERGED_PARTS
    parts, then of all. Values that are null or not finite are missing ones."""
    every = list(dict.fromkeys([*left, *right]))
    at_left, at_right = [every.index(c) for c in left], [every.index(c) for c in right]
    names = ["at", "part", "sums"]
    schema = "at int, part int, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            values = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(every))])
            for start in range(0, len(values), 4096):
                block = values[start : start + 4096]
                one = Moments.of(block[:, at_left], block[:, at_right])
                total = one if total is None else total.add(one)
        if total is not None:
            yield total.rows(names, TaskContext.get().partitionId())

    def merged(table: pa.Table) -> Moments:
        blobs = table.column("sums").to_pylist()
        total = Moments.read(blobs[0])
        for blob in blobs[1:]:
            total = total.add(Moments.read(blob))
        return total

    def merge(table: pa.Table) -> pa.Table:
        total = merged(table)
        out = total.rows(names, 0)
        return pa.Table.from_batches([out]).set_column(0, "at", table.column("at").slice(0, 1))

    def cells(table: pa.Table) -> pa.Table:
        total = merged(table)
        n, (_, _, cx, cy, cxy) = total.n[0], total.parts[:, 0]
        root = np.sqrt(cx * cy)
        r = np.clip(np.divide(cxy, root, out=np.zeros_like(root), where=root > 0), -1.0, 1.0)
        label = left[table.column("at")[0].as_py()]
        return pa.table({"label_a": [label] * len(n), "label_b": list(right), "r": pa.array(r, pa.float64(), mask=~((n >= 2) & (root > 0))), "n": pa.array(n.astype(np.int64))})

    parts = df.select(*[finite(F.col(c)).alias(f"c{i}") for i, c in enumerate(every)]).mapInArrow(run, schema)
    once = parts.withColumn("part", F.col("part") % MERGED_PARTS).groupBy("at", "part").applyInArrow(merge, schema)
    return once.groupBy("at").applyInArrow(cells, "label_a string, label_b string, r double, n long")


def _corr_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    sums, cells = [], []
    cell = lambda a, b, r, n: F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), r.alias("r"), n.cast("long").alias("n"))
    for i, (a, b) in enumerate(pairs):
        n = F.col(f"n{i}")
        if a == b:
            sums.append(F.count(finite(F.col(a))).alias(f"n{i}"))
            cells.append(cell(a, a, F.lit(1.0), n))
        else:
            r, both = _r(F.col(a).cast("double"), F.col(b).cast("double"))
            sums += [r.alias(f"r{i}"), both.alias(f"n{i}")]
            cells += [cell(a, b, F.col(f"r{i}"), n), cell(b, a, F.col(f"r{i}"), n)]
    return df.agg(*sums).select(F.inline(F.array(*cells)))


def encode(spec: Mapping[str, str]) -> list[Column]:
    """Features as numbers: log10 of positive values, yes and no as 1 and 0, or as they are."""
    ways = {"log10": log10_positive, "yes_no": yes_no, "number": lambda c: F.col(c).cast("double")}
    return [ways[way](c).alias(c) for c, way in spec.items()]


def corr_targets(df: DataFrame, features: Sequence[str], targets: Sequence[str], log: bool = True) -> DataFrame:
    """(target, feature, r, n) of each feature against each target column, its log10 if `log`. Few pairs
    are sums of one aggregate, many are blocks of a matrix; either way one pass over the table."""
    y = (lambda c: log10_positive(c)) if log else (lambda c: F.col(c).cast("double"))
    wide = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], *[y(c).alias(f"t{j}") for j, c in enumerate(targets)])
    pairs = [(i, j) for j in range(len(targets)) for i in range(len(features))]
    if len(pairs) > PAIRS_A_PLAN:
        cells = corr_blocks(wide, [f"f{i}" for i in range(len(features))], [f"t{j}" for j in range(len(targets))])
        name = lambda names, c: F.get(F.array(*map(F.lit, names)), F.substring(c, 2, 9).cast("int"))
        return cells.select(name(targets, F.col("label_b")).alias("target"), name(features, F.col("label_a")).alias("feature"), "r", "n")
    sums, cells = [], []
    for k, (i, j) in enumerate(pairs):
        r, n = _r(F.col(f"f{i}"), F.col(f"t{j}"))
        sums += [r.alias(f"r{k}"), n.alias(f"n{k}")]
        cells.append(F.struct(F.lit(targets[j]).alias("target"), F.lit(features[i]).alias("feature"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").cast("long").alias("n")))
    return wide.agg(*sums).select(F.inline(F.array(*cells)))


def rank_correlations(table: DataFrame, label: str = "feature", by: Sequence[str] = ("target",)) -> DataFrame:
    """Rank per target by absolute r, ties by label; undefined ones are left out."""
    order = Window.partitionBy(*by).orderBy(F.abs("r").desc(), F.col(label))
    return table.filter("r is not null").withColumn("position", F.row_number().over(order).cast("long"))


def relative_coverage(table: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """How much of its target's largest n a row has, drawn between 0.3 and 1."""
    most = F.max("n").over(Window.partitionBy(*by))
    share = F.greatest(F.least(F.try_divide(F.col("n").cast("double"), most), F.lit(1.0)), F.lit(0.0))
    return table.withColumn("coverage", F.when(most <= 0, 1.0).otherwise(0.3 + 0.7 * share))


def matrix_regression(matrix: DataFrame, stored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: cells, largest difference of r * n / (n - 1) from the stored matrix, whether all agree."""
    both = matrix.alias("m").join(stored.alias("s"), ["label_a", "label_b"])
    scaled = F.col("m.r") * F.try_divide(F.col("m.n").cast("double"), F.col("m.n") - 1)
    difference = F.max(F.abs(scaled - F.col("s.r")))
    return both.agg(F.count(F.lit(1)).alias("cells"), difference.alias("largest"), (difference <= tolerance).alias("agrees"))
