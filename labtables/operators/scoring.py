"""Scores of compared cells, expectations, retrieval and self tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("correct", "near", "wrong", "missing", "extra")


def _totals() -> list[Column]:
    matched = F.col("unmatched") == F.lit(False)
    counts = [F.count_if(matched & (F.col("outcome") == o)).alias(o) for o in OUTCOMES]
    return [*counts, F.count_if(~matched & (F.col("outcome") == "missing")).alias("missing_unmatched_rows")]


def group_totals(cells: DataFrame, keys: Sequence[str], groups: DataFrame, digits: int = 4) -> DataFrame:
    """Counts and scores of cells (column, outcome, unmatched) per key and field group. groups
    (column, group), which are declared by hand, may put a column into several groups, so roll-ups are
    groups too, and groups without cells appear. accuracy is over matched rows, loose adds near, recall
    counts unmatched golden cells as missing. Cells are read once: they are counted by key and
    column, and a key's columns, no more than there are fields, are added up by group within its row."""
    members: dict[str, set[str]] = {}
    for r in groups.select("group", "column").distinct().collect():
        members.setdefault(r["group"], set()).add(r["column"])
    names = [c for c in (*OUTCOMES, "missing_unmatched_rows")]
    fields = F.col("column").isin(sorted(set().union(*members.values())))
    counted = cells.withColumn("column", F.when(fields, F.col("column"))).groupBy(*keys, "column").agg(*_totals())
    rows = counted.groupBy(*keys).agg(F.collect_list(F.struct("column", *names)).alias("__columns"))
    every = F.array(*[F.struct(F.lit(g).alias("group"), F.array(*map(F.lit, sorted(c))).alias("members")) for g, c in sorted(members.items())])
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    own = lambda g: F.filter("__columns", lambda c: F.array_contains(g["members"], c["column"]))
    total = lambda g: F.aggregate(own(g), zero, lambda s, c: F.struct(*[(s[n] + c[n]).alias(n) for n in names]))
    sums = F.transform(every, lambda g: F.struct(g["group"].alias("group"), total(g).alias("sums")))
    out = rows.select(*keys, F.inline(sums)).select(*keys, "group", "sums.*") if members else counted.limit(0).select(*keys, F.lit("").alias("group"), *names)
    scored = F.col("correct") + F.col("near") + F.col("wrong") + F.col("missing")
    ratio = lambda a, b: F.bround(F.try_divide(a.cast("double"), b), digits)
    return out.withColumns({
        "accuracy": ratio(F.col("correct"), scored), "accuracy_loose": ratio(F.col("correct") + F.col("near"), scored), "recall": ratio(F.col("correct"), scored + F.col("missing_unmatched_rows")),
    })


def run_totals(papers: DataFrame, run: str = "run", paper: str = "paper") -> DataFrame:
    """Per paper and for each run as a whole (paper null): papers, extracted ones, golden, predicted and
    matched rows by quality, recall and precision. One pass by grouping sets."""
    sums = ["gold", "pred", "direct", "rank", "block_only"]
    out = papers.groupingSets([[run, paper], [run]], run, paper).agg(
        F.count(F.lit(1)).alias("papers"), F.count_if("extracted").alias("with_extraction"), *[F.sum(c).alias(c) for c in sums], F.grouping(paper).alias("overall")
    )
    matched = F.col("direct") + F.col("rank") + F.col("block_only")
    return out.withColumn("matched", matched).withColumn("recall", F.bround(F.try_divide(matched.cast("double"), F.col("gold")), 4)).withColumn("precision", F.bround(F.try_divide(matched.cast("double"), F.col("pred")), 4))


def expect(df: DataFrame, checks: Mapping[str, tuple[Column, object]], offenders: Mapping[str, Column] | None = None, sample: int = 10, fail: bool = False) -> DataFrame:
    """One row per named check: actual (an aggregate), expected, passed, and how many rows offend. All
    aggregates run in one pass; with `fail`, a failed check is an error."""
    cells, names = [], list(checks)
    for i, name in enumerate(names):
        cells.append(checks[name][0].cast("string").alias(f"a{i}"))
        cells.append((F.count_if((offenders or {})[name]) if name in (offenders or {}) else F.lit(0)).cast("long").alias(f"o{i}"))
    row = df.agg(*cells)
    lines = [F.struct(F.lit(n).alias("name"), F.col(f"a{i}").alias("actual"), F.lit(str(checks[n][1])).alias("expected"), F.col(f"o{i}").alias("offenders")) for i, n in enumerate(names)]
    out = row.select(F.inline(F.array(*lines))).withColumn("passed", F.col("actual").eqNullSafe(F.col("expected")))
    if fail:
        out = out.withColumn("passed", F.when(F.col("passed"), True).otherwise(F.raise_error(F.concat(F.lit("failed: "), F.col("name"))).cast("boolean")))
    return out


def offending_rows(df: DataFrame, offends: Column, columns: Sequence[str], order: Sequence[str], sample: int = 10) -> DataFrame:
    """The first rows that a check counts, for its report."""
    return df.filter(offends).select(*columns).orderBy(*order).limit(sample)


def recall_at_k(ranked: DataFrame, wanted: DataFrame, item: str, order: Sequence[Column], ks: Sequence[int] = (50, 100, 200)) -> DataFrame:
    """One row: listed and wanted items, wanted ones found, and found within the first k. Items are cut
    to the largest k before they are numbered."""
    top = ranked.orderBy(*order).limit(max(ks)).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    hits = top.join(wanted.select(item).distinct(), item, "left_semi")
    found = ranked.select(item).distinct().join(wanted.select(item).distinct(), item, "left_semi")
    counts = hits.agg(*[F.count_if(F.col("position") <= k).alias(f"hits_{k}") for k in ks])
    names = ["listed", "wanted", "found", *[f"hits_{k}" for k in ks]]
    row = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(0)).cast("long").alias(c) for c in names])
    sides = [ranked.agg(F.count(F.lit(1)).alias("listed")), wanted.agg(F.countDistinct(item).alias("wanted")), found.agg(F.count(F.lit(1)).alias("found")), counts]
    every = row(sides[0])
    for side in sides[1:]:
        every = every.unionAll(row(side))
    return every.agg(*[F.sum(c).alias(c) for c in names])
