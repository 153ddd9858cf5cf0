"""Roll-ups of runs, parses and repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def valid_calls(calls: DataFrame) -> DataFrame:
    """Calls (stop_reason, prompt_tokens, chars) with a verdict: truncated at the output limit,
    prompt_cut when fewer prompt tokens were read than chars / 6, else ok."""
    verdict = F.when(F.col("stop_reason") == "length", "truncated").when(F.col("prompt_tokens") < F.col("chars") / 6, "prompt_cut").otherwise("ok")
    return calls.withColumn("verdict", verdict)


def medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys and median_COLUMN of each column, exact, by selection: equal values are counted first, the
    counts are sorted by ranges and added up by range, and of each group only the values at its
    middle places are looked at. So no task holds a group, whatever its size. Null values don't
    count, a column without values has a null median, and null keys are a group."""
    values = df.select(*[F.col(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "__column", "__value")
    by = [*keys, "__column"]
    counted = values.filter("__value is not null").groupBy(*by, "__value").agg(F.count(F.lit(1)).alias("__n"))
    ranged = cut(counted.orderBy(*by, "__value")).withColumn("__range", F.shiftright(F.monotonically_increasing_id(), 33))
    inner = Window.partitionBy("__range", *by).orderBy("__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*[f"__of_{k}" for k in by])
    ranges = ranged.groupBy("__range", *by).agg(F.sum("__n").alias("__sum")).select(F.col("__range").alias("__of"), *[F.col(k).alias(f"__of_{k}") for k in by], "__sum")
    ranges = ranges.withColumn("__before", F.sum("__sum").over(group.orderBy("__of").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__sum")).withColumn("__all", F.sum("__sum").over(group))
    middle = lambda up: F.floor((F.col("__all") - 1 + up) / 2)
    # a range that holds neither middle place of its group goes
    ranges = ranges.filter((F.col("__before") <= middle(1)) & (middle(0) < F.col("__before") + F.col("__sum")))
    same = [ranged["__range"] == ranges["__of"], *[ranged[k].eqNullSafe(ranges[f"__of_{k}"]) for k in by]]
    placed = ranged.join(ranges, same).withColumn("__end", F.col("__before") + F.sum("__n").over(inner))
    has = lambda up: (F.col("__end") - F.col("__n") <= middle(up)) & (middle(up) < F.col("__end"))
    found = placed.groupBy(*by).agg(((F.max(F.when(has(0), F.col("__value"))) + F.max(F.when(has(1), F.col("__value")))) / 2).alias("__median"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__column") == c, F.col("__median"))).alias(f"median_{c}") for c in columns])


def with_medians(totals: DataFrame, df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A roll-up by `keys` with the medians of its rows."""
    middle = medians(df, keys, columns).select(*[F.col(k).alias(f"__{k}") for k in keys], *[f"median_{c}" for c in columns])
    return totals.join(middle, [totals[k].eqNullSafe(middle[f"__{k}"]) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def arm_summary(runs: DataFrame, arm: str = "arm") -> DataFrame:
    """Per arm of runs (ok, seconds, prompt_tokens, output_tokens, rows, nulls, fields, zeros, negatives):
    counts, medians, totals and shares. Runs with the columns prefill_seconds, decode_seconds or filled
    (cells with a value) get their medians and the share of cells that are filled."""
    has = set(runs.columns)
    phases = [c for c in ("prefill_seconds", "decode_seconds") if c in has]
    share = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    totals = runs.groupBy(arm).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("ok"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"),
        share("output_tokens", "rows").alias("tokens_per_row"), share("nulls", "fields").alias("null_share"), F.sum("zeros").alias("zeros"), F.sum("negatives").alias("negatives"),
        *[share("filled", "fields").alias("filled_share")] * ("filled" in has),
    )
    return with_medians(totals, runs, [arm], ["seconds", *phases])


def mode_totals(metrics: DataFrame, stratum: str, mode: str, columns: Sequence[str]) -> DataFrame:
    """Sums of each metric by mode, overall (stratum null) and per stratum, long."""
    sums = metrics.groupingSets([[stratum, mode], [mode]], stratum, mode).agg(*[F.sum(c).cast("long").alias(c) for c in columns], F.grouping(stratum).cast("int").alias("overall"))
    return sums.unpivot([stratum, mode, "overall"], list(columns), "metric", "total")


def digitised_share(metrics: DataFrame, stratum: str, mode: str, modes: Sequence[str], part: str = "chart_rows", whole: str = "table_rows") -> DataFrame:
    """The share of table rows that were read off charts, a column per mode: overall (stratum null) and
    per stratum. Null where a mode has no rows."""
    sums = metrics.groupingSets([[stratum, mode], [mode]], stratum, mode).agg(F.try_divide(F.sum(part).cast("double"), F.sum(whole)).alias("share"), F.grouping(stratum).cast("int").alias("overall"))
    return sums.groupBy(stratum, "overall").pivot(mode, list(modes)).agg(F.first("share"))


def pair_summary(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Per pair of modes the median similarity, sums of numbers only in one, and the number of papers."""
    totals = pairs.groupBy(a, b).agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"), F.count(F.lit(1)).alias("n"))
    return with_medians(totals, pairs, [a, b], ["similarity"])


def parse_stats(manifests: DataFrame) -> DataFrame:
    """Per document of (doc, page_range "a-b", figures array<struct<caption, tier>>): pages, figures,
    captioned ones, their share in 2 decimals (null without figures), figures of the first tier."""
    ends = F.split("page_range", "-")
    n, named = F.size("figures"), F.size(F.filter("figures", lambda f: f["caption"].isNotNull()))
    return manifests.select(
        "doc", (F.get(ends, F.lit(1)).cast("long") - F.get(ends, F.lit(0)).cast("long") + 1).alias("pages"), n.cast("long").alias("figures"), named.cast("long").alias("captioned"),
        F.round(F.try_divide(named.cast("double"), n), 2).alias("caption_hit_rate"), F.size(F.filter("figures", lambda f: f["tier"] == "a")).cast("long").alias("from_a"),
    )


def replicate_mean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def issues(runs: DataFrame, run: str, counters: Sequence[str], example: str, order: str) -> DataFrame:
    """Per problem counter the runs that have any, their sum, and the first run's example."""
    long = runs.unpivot([run, example, order], list(counters), "problem", "n").filter("n > 0")
    return long.groupBy("problem").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").cast("long").alias("total"), F.min_by(example, order).alias("example"))


def compare_runs(runs: DataFrame, scores: DataFrame, arm: str, arms: Sequence[str], paper: str, value: str) -> DataFrame:
    """Each paper's value side by side per arm; papers of either table appear."""
    both = runs.join(scores, [arm, paper], "full")
    return both.groupBy(paper).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(f"{value}_{a}") for a in arms])


def compare_repeats(runs: DataFrame, group: str, run: str, order: str, element: str, first, second) -> DataFrame:
    """Per group two repeats: elements of each, elements only in one (as multisets), and whether they
    are the same multiset and in the same order."""
    def side(r, n):
        rows = runs.filter(F.col(run) == r)
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).withColumn(n, F.lit(1))

    a, b = side(first, "a"), side(second, "b")
    counts = a.select(group, element, "a", F.lit(0).alias("b")).unionAll(b.select(group, element, F.lit(0).alias("a"), "b")).groupBy(group, element).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sets = counts.groupBy(group).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("only_b"))
    pairs = a.select(group, "place", F.col(element).alias("x")).join(b.select(group, "place", F.col(element).alias("y")), [group, "place"], "full")
    order_ = pairs.groupBy(group).agg(F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("same_order"))
    return sets.join(order_, group).withColumn("same_set", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def stratified_sample(df: DataFrame, stratum: str, n: int, id_col: str, seed: int = 42, strict: bool = False) -> DataFrame:
    """Exactly n rows of each stratum, those of lowest md5(seed|id): a feature's limit, and the same draw
    each time. With `strict`, a smaller stratum is an error."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(h, id_col)))
    if strict:
        # counted after the cut, so that a stratum's window holds n rows at most
        ranked = ranked.filter(F.col("__n") <= n)
        size = F.count(F.lit(1)).over(Window.partitionBy(stratum))
        ranked = ranked.withColumn("__n", F.when(size >= n, F.col("__n")).otherwise(F.raise_error(F.concat(F.lit("too few rows in "), F.col(stratum).cast("string"))).cast("int")))
    return ranked.filter(F.col("__n") <= n).drop("__n")
