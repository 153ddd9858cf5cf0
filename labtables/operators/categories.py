"""Categories: frozen ranks, folding, coverage, spelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

FOLD_AT = 7


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


#: Classes of places that are told apart before ties, and slots of one: rows that no window of places exceeds.
EXACT_COUNTS = 1_000
SLOTS = 4_096


def in_places(df: DataFrame, major: Column, minor: Column, order: Sequence[Column], out: str) -> DataFrame:
    """`df` with each row's place from 0 in `order`, as a lazy plan without a window over all rows. `major`
    (a small whole number, ascending) and, within it, `minor` (a number, ascending, null last) must agree
    with `order`: rows are dealt into slots of equal width between a major's least and largest minor, the
    slots' rows are counted, and only rows of one slot meet in a window."""
    rows = df.withColumns({"__major": major.cast("int"), "__minor": minor.cast("double")})
    ends = rows.groupBy("__major").agg(F.min("__minor").alias("__low"), F.max("__minor").alias("__high"))
    share = F.try_divide(F.col("__minor") - F.col("__low"), F.col("__high") - F.col("__low"))
    slot = F.when(F.col("__minor").isNull(), SLOTS).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * SLOTS), F.lit(SLOTS - 1))).cast("int")
    # one row per major: as many as `major` has values
    dealt = rows.join(F.broadcast(ends), "__major").withColumn("__slot", slot).drop("__minor", "__low", "__high")
    sizes = dealt.groupBy("__major", "__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = lambda w: F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    slots = sizes.withColumn("__inside", before(Window.partitionBy("__major").orderBy("__slot"))).drop("__n")
    majors = sizes.groupBy("__major").agg(F.sum("__n").alias("__n")).withColumn("__base", before(Window.orderBy("__major"))).drop("__n")
    placed = dealt.join(slots, ["__major", "__slot"]).join(F.broadcast(majors), "__major")
    nth = F.row_number().over(Window.partitionBy("__major", "__slot").orderBy(*order)) - 1
    return placed.withColumn(out, (F.col("__base") + F.col("__inside") + nth).cast("long")).drop("__major", "__slot", "__inside", "__base")


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def rank_categories(df: DataFrame, column: str, order: str) -> DataFrame:
    """The frozen dimension of a column: value, n, rank from 0 by frequency, ties by first appearance.
    Values of one frequency are dealt by where they appear first, if `order` is a number (else they meet
    in one window, of their distinct values alone); frequencies of EXACT_COUNTS or more, which few values
    have, by powers of two."""
    found = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    many = F.col("n") >= EXACT_COUNTS
    major = -F.when(many, EXACT_COUNTS + F.floor(F.log2("n"))).otherwise(F.col("n"))
    minor = F.when(many, -F.col("n")).otherwise(F.col("first") if is_number(found, "first") else F.lit(0))
    by = [F.col("n").desc(), F.col("first"), F.col("value")]
    return in_places(found, major, minor, by, "rank").select("value", "n", "rank")


def with_rank(df: DataFrame, dimension: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Each row's frozen rank, -1 for unknown and null values."""
    ranks = dimension.select(F.col("value").alias("__value"), F.col("rank").alias("__rank"))
    return df.join(ranks, df[column] == ranks["__value"], "left").withColumn(out, F.coalesce("__rank", F.lit(-1)).cast("long")).drop("__value", "__rank")


def fold_top(df: DataFrame, rank: str = "rank", k: int = FOLD_AT, out: str = "bucket") -> DataFrame:
    """Ranks below k keep theirs; unknown ones and those of k and above share bucket k."""
    return df.withColumn(out, F.when((F.col(rank) < 0) | (F.col(rank) >= k), k).otherwise(F.col(rank)).cast("long"))


def topk_coverage(df: DataFrame, column: str, order: str, k: int = FOLD_AT) -> DataFrame:
    """One row: the share of non-null rows that the k most frequent values cover, in per cent."""
    top = rank_categories(df, column, order)
    kept, all_ = F.sum(F.when(F.col("rank") < k, F.col("n"))), F.sum("n")
    return top.agg(F.coalesce(all_, F.lit(0)).alias("n"), F.round(F.coalesce(F.try_divide(100 * kept.cast("double"), all_), F.lit(0.0)), 1).alias("covered"))


def snap_category(df: DataFrame, dimension: DataFrame, column: str) -> DataFrame:
    """A value that equals a known one but for case takes its spelling (the most frequent's)."""
    known = dimension.groupBy(F.lower("value").alias("__low")).agg(F.min_by("value", "rank").alias("__known"))
    return df.join(known, F.lower(F.col(column)) == F.col("__low"), "left").withColumn(column, F.coalesce("__known", column)).drop("__low", "__known")


def group_order(df: DataFrame, dimension: DataFrame, column: str, order: str) -> DataFrame:
    """Legend order of imported values: known ones by frozen rank, unknown ones by first appearance,
    null last."""
    seen = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    both = seen.join(dimension.select("value", "rank"), "value", "left")
    major = F.when(F.col("value").isNull(), 2).when(F.col("rank").isNull(), 1).otherwise(0)
    minor = F.coalesce("rank", F.col("first") if is_number(both, "first") else F.lit(0))
    by = [F.col("value").isNull(), F.col("rank").asc_nulls_last(), F.col("first"), F.col("value")]
    return in_places(both, major, minor, by, "position").select("value", "n", "position")


def table_stats(df: DataFrame, dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row: rows, distinct values per dimension, measures with any value."""
    any_ = sum((F.max(F.col(m).isNotNull().cast("long")) for m in measures), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.countDistinct(d).alias(f"distinct_{d}") for d in dimensions], any_.cast("long").alias("measured"))
