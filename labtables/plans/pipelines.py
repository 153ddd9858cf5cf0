"""The composite pipelines: dataset build, series, scatter, scoring, parser comparison, assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.cells import parse_number, parse_text
from ..operators import assemble, categories, corpus, explore, linkage, reports, scoring, series, stats
from ..shared import scratch
from ..sources import tables


def build_dataset(
    raw: DataFrame, numeric: Sequence[str], text: Sequence[str], row: str, strict: bool = True, checks: Mapping[str, tuple[Column, object]] | None = None, labels: Mapping[str, str] | None = None,
    glossary: DataFrame | None = None, own: DataFrame | None = None, targets: Sequence[str] = (), fail: bool = True,
) -> dict[str, DataFrame]:
    """A raw text table as typed data, its frozen category dimensions and its correlation matrix. With
    `checks` (name -> aggregate of the typed columns, expected value) the data are written in the common
    folder, and the checks are metrics of that one write: report has them, and with `fail` one that fails is
    an error that names it. With `labels` (column -> header) registry says each column's unit, kind and
    description, a glossary's (id, description) before one's `own`. With `targets` correlations of the other
    numeric columns with each of them come too, ranked."""
    data = raw.select(row, *[parse_number(c, strict).alias(c) for c in numeric], *[parse_text(c).alias(c) for c in text])
    spark, out = raw.sparkSession, {}
    if checks:
        seen, at = Observation(), scratch(spark, "dataset")
        names = list(checks)
        data.observe(seen, F.count(F.lit(1)).alias("n"), *[checks[n][0].cast("string").alias(f"c{i}") for i, n in enumerate(names)]).write.parquet(at)
        got = seen.get
        lines = [(n, got[f"c{i}"], str(checks[n][1]), got[f"c{i}"] == str(checks[n][1])) for i, n in enumerate(names)]
        if fail and (wrong := [f"{n}: {actual}, not {expected}" for n, actual, expected, ok in lines if not ok]):
            raise ValueError("failed checks: " + "; ".join(wrong))
        out["report"] = spark.createDataFrame(lines, "name string, actual string, expected string, passed boolean")
        data = spark.read.schema(data.schema).parquet(at)
    dims = [categories.rank_categories(data, c, row).select(F.lit(c).alias("column"), "value", "rank", "n") for c in text]
    frozen = dims[0] if dims else None
    for d in dims[1:]:
        frozen = frozen.unionByName(d)
    out |= {"dataset": data, "categories": frozen, "correlations": stats.corr_matrix(data, numeric)}
    if labels:
        kinds = spark.createDataFrame([(c, "text" if c in text else "numeric") for c in labels], "id string, kind string")
        none = spark.createDataFrame([], "id string, description string")
        headers = spark.createDataFrame(list(labels.items()), "id string, label string")
        out["registry"] = tables.build_registry(headers, kinds, none if glossary is None else glossary, none if own is None else own)
    if targets:
        table = stats.corr_targets(data, [c for c in numeric if c not in targets], list(targets))
        out["targets"] = stats.relative_coverage(stats.rank_correlations(table))
    return out


def measurement_series(data: DataFrame, choices: Mapping[str, Sequence], row: str, columns: dict[str, float], mode: str, tg: str | None, dimension: DataFrame, colour: str) -> DataFrame:
    """Filtered series with their colour slot. Rows without points are in series_report, not here."""
    rows = explore.multi_filter(data, choices)
    points = series.series_points(rows, row, columns, mode, tg)
    slots = categories.fold_top(categories.with_rank(rows.select(row, colour), dimension, colour)).select(row, "bucket")
    return points.join(slots, row)


def scatter_points(data: DataFrame, choices: Mapping[str, Sequence], x: str, y: str, x_log: bool, y_log: bool, dimension: DataFrame, colour: str, row: str) -> DataFrame:
    rows = explore.plottable(explore.multi_filter(data, choices), x, y, x_log, y_log)
    return categories.fold_top(categories.with_rank(rows.select(row, x, y, colour), dimension, colour))


def score_run(pred: DataFrame, gold: DataFrame, group: Sequence[str], block: str, pairs: Sequence[tuple[str, str]], pred_id: str, gold_id: str, columns: Sequence[str], classes: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """Links, cells and totals of predicted against golden rows."""
    p = linkage.rank_position(pred, [*group, block], [a for a, _ in pairs], pred_id)
    g = linkage.rank_position(gold, [*group, block], [b for _, b in pairs], gold_id)
    links = linkage.assign_greedy(linkage.link_candidates(p, g, group, block, pairs, None, pred_id, gold_id), group)
    every = linkage.score_cells(pred, gold, links, group, pred_id, gold_id, columns, classes)
    return {"links": links, "cells": every, "papers": scoring.group_totals(every, group, groups), "totals": scoring.group_totals(every, [], groups)}


def compare_parsers(docs: DataFrame, column: str, id_col: str, mode: str, paper: str, modes: tuple[str, str]) -> dict[str, DataFrame]:
    """Metrics per document and, for two modes of each paper, similarity and numbers only in one."""
    metrics = corpus.content_metrics(docs, column, id_col).join(docs.select(id_col, paper, mode), id_col)
    a, b = (docs.filter(F.col(mode) == m).select(paper, F.col(id_col).alias(f"id_{k}"), F.col(column).alias(f"text_{k}")) for k, m in zip("ab", modes))
    pairs = a.join(b, paper)
    only = corpus.exclusive_numbers(pairs.select("id_a", "id_b"), corpus.numbers(docs, column, id_col), "id_a", "id_b", id_col).groupBy("id_a", "id_b").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))
    alike = corpus.text_similarity(pairs, "text_a", "text_b").select(paper, "id_a", "id_b", "similarity").join(only, ["id_a", "id_b"], "left").na.fill(0, ["only_a", "only_b"])
    return {"metrics": metrics, "pairs": alike, "summary": reports.pair_summary(alike.withColumn("mode_a", F.lit(modes[0])).withColumn("mode_b", F.lit(modes[1])), "mode_a", "mode_b")}


def assemble_extraction(listed: DataFrame, values: DataFrame, docs: DataFrame, paper: str, column: str, fields: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Listed entities (paper, position, quote, key...) without repeats and without evidence dropped,
    numbered, and their values on them."""
    firsts = assemble.dedupe_first(listed, [paper, "key"], ["position"])
    kept = corpus.verify_quotes(firsts, docs, column, paper).filter("found <> 'none'")
    return assemble.assemble_wide(assemble.number_entities(kept, paper, ["position"]), values, paper, fields)
