"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order and may be taken in up to two passes. A copy's
virtual finish time is its source's cumulative words, itself included, divided by the source's
target. All copies are ranged over virtual time, and the mix is the prefix that fits the budget.

Cumulative sums are two-level: hash ranges of a source are summed first, so a window never holds more
than one hash range, however many rows a source has; virtual time is ranged the same way, and only
the range in which the budget ends is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a hash range or a range of virtual time, about.
RANGE_ROWS = 1_000
#: Sources up to this many rows are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 200_000
#: Times that a document can be taken.
PASSES = 2


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source_col: str, share: float, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: `source_col`, sid (its rank by code point, null last), source_size, target.
    Targets share `share` of all sizes by weight, none above PASSES times its source's size: sources
    ordered by what fills them first are full as long as the level reached there is above theirs."""
    rank = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights)) + 1)
    totals = sized.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    by_fill = Window.orderBy("fill", "sid")
    everything = Window.partitionBy(F.lit(0))
    below = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        totals.withColumn("sid", rank).withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * float(PASSES)).withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(below), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("full", F.col("level") >= F.col("fill"))
        .withColumn("at", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("at"))
    return out.select(source_col, "sid", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), seed: int = 42,
) -> DataFrame:
    """One row per input row: `id_col`, size (words), source_size, target (its source's), taken (words
    the mix takes, repeats counted). Null and empty texts have size 0 and nothing is taken of them; null
    sources are one source; repeated rows are documents of their own; an empty table gives no rows;
    whole texts are counted, however long; columns of any other name are not read. The same table gives
    the same mix: the shuffled order is that of md5(seed|id), then of id and size. Rows that are equal in
    these and in their source are told apart by nothing, so they are counted before they are queued, and
    null or repeated ids make no window large."""
    queued, last = _queue(docs, id_col, text_col, source_col, share, weights, seed)
    return queued.select(F.col("id").alias(id_col), "size", "source_size", "target", _taken(last).alias("taken"))


def _taken(last: tuple | None) -> Column:
    return sum((_in_mix(k, last).cast("long") for k in range(PASSES)), F.lit(0).cast("long")) * F.col("size")


def _queue(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float, weights: tuple[int, ...], seed: int) -> tuple[DataFrame, tuple | None]:
    """The queued rows with their virtual finish times, and the first copy beyond the budget."""
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size")), "sizes")
    rows = sized.count()
    ranges = 1 << min(16, max(4, math.ceil(math.log2(max(rows, 1) / RANGE_ROWS + 1))))
    targets = written(source_targets(sized, "src", share, weights), "targets")
    small = targets.count() <= BROADCAST_SOURCES
    keyed = sized.join(F.broadcast(targets) if small else targets, sized.src.eqNullSafe(targets.src)).drop(targets.src)
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    range_of = F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("int")
    keyed = keyed.withColumn("h", shuffled).withColumn("part", range_of)
    sums = keyed.groupBy("sid", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("base"))
    before_ = Window.partitionBy("sid", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = keyed.groupBy("sid", "part", "h", "id", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("src").alias("src"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    queued = same.withColumn("inside", F.coalesce(F.sum(F.col("rows") * F.col("size")).over(before_), F.lit(0))).join(sums, ["sid", "part"])
    queued = queued.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    done = F.col("base") + F.col("inside") + F.col("nth") * F.col("size")
    finish = [F.when(F.col("target") > 0, (done + F.col("source_size") * k) / F.col("target")) for k in range(PASSES)]
    queued = queued.select("id", "src", "size", "sid", "source_size", "target", "h", *[f.alias(f"finish{k}") for k, f in enumerate(finish)])
    queued = written(queued, "queue")
    return queued, _first_beyond(queued, float(share), ranges)


def _first_beyond(queued: DataFrame, share: float, ranges: int) -> tuple | None:
    """The first copy in the order of virtual time (then source, shuffled order) that doesn't fit the
    budget: (finish, sid, h, id, size), or None if all fit."""
    budget = float(queued.agg(F.sum("size")).first()[0] or 0) * share
    copies = queued.select("sid", "h", "id", "size", F.explode(F.array(*[F.col(f"finish{k}") for k in range(PASSES)])).alias("finish")).filter("finish is not null")
    copies = copies.withColumn("time", F.least(F.floor(F.col("finish") * ranges), F.lit(8 * ranges)).cast("int"))
    # one row per range of virtual time, 8 * ranges + 1 at most
    ending = Window.orderBy("time")
    spans = copies.groupBy("time").agg(F.sum("size").alias("n")).select("time", F.sum("n").over(ending).alias("end"), "n")
    crossing = spans.filter(F.col("end") > budget).orderBy("time").first()
    if crossing is None:
        return None
    order = ["finish", "sid", "h", "id", "size"]
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = copies.filter(F.col("time") == crossing.time).select(*order, (F.sum("size").over(running) + (crossing.end - crossing.n)).alias("sum"))
    return tuple(held.filter(F.col("sum") > budget).orderBy(*order).select(*order).first())


def _in_mix(k: int, last: tuple | None) -> Column:
    """Whether a row's copy of pass `k` stands before `last`."""
    finish = F.col(f"finish{k}")
    if last is None:
        return finish.isNotNull()
    out, same = F.lit(False), F.lit(True)
    for column, value in zip((finish, F.col("sid"), F.col("h"), F.col("id"), F.col("size")), last):
        least = F.lit(value)
        out = out | (same & F.coalesce(column < least, F.lit(value is not None) & column.isNull()))
        same = same & column.eqNullSafe(least)
    return F.coalesce(out, F.lit(False))


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), seed: int = 42
) -> DataFrame:
    """The mix itself: each row of `docs` as often as the plan takes it, with the columns of `docs`, of any
    names and types. Rows that are equal in id, source and size share their copies evenly, those that
    come first as JSON one more. Cases are as in mix_plan. Texts are shuffled once."""
    queued, last = _queue(docs, id_col, text_col, source_col, share, weights, seed)
    copies = F.when(F.col("size") > 0, F.floor(_taken(last) / F.col("size"))).otherwise(0).cast("long")
    plan = queued.groupBy("id", "src", "size").agg(F.sum(copies).alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.col(source_col).alias("s"), word_count(F.col(text_col)).alias("n"))
    joined = rows.join(plan, F.col("i").eqNullSafe(F.col("id")) & F.col("s").eqNullSafe(F.col("src")) & (F.col("n") == F.col("size"))).select("row", "i", "s", "n", "copies", "rows")
    alone = joined.filter("rows = 1").select("row", F.col("copies").alias("own"))
    nth = F.row_number().over(Window.partitionBy("i", "s", "n").orderBy(F.to_json("row")))
    share_of = F.floor(F.col("copies") / F.col("rows")) + (nth <= F.col("copies") % F.col("rows")).cast("long")
    several = joined.filter("rows > 1").withColumn("own", share_of).select("row", "own")
    return alone.unionByName(several).filter("own > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM t),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM r),
f AS (SELECT *, most / weight AS fill, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY fill, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
g AS (SELECT source, sid, source_size, budget, CASE WHEN level >= fill THEN most ELSE weight * max(CASE WHEN level < fill THEN level END) OVER () END AS target FROM l),
q AS (SELECT d.doc_id, d.size, g.sid, g.source_size, g.target, g.budget, md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS h,
  CAST(sum(d.size) OVER (PARTITION BY g.sid ORDER BY md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT doc_id, size, sid, source_size, target, budget, h, CASE WHEN target > 0 THEN (done + source_size * k) / target END AS finish
  FROM q, (VALUES (0), (1)) AS p(k)),
m AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, sid, h, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AND finish IS NOT NULL AS taken_one FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN taken_one THEN size ELSE 0 END) AS BIGINT) AS taken
FROM m GROUP BY doc_id, size, source_size, target
"""
