"""Queries that are to work on whole tables: what they return is held to brute force over all rows."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labtables import queries as registry
from labtables.operators import corpus, explore, graph, linkage

SF = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_links_of_all_orders(spark):
    lines = read("lineitem")
    papers = set(lines.l_orderkey)
    assert any(k % 4 != 1 for k in papers)
    assert {r.paper for r in rows(spark, "paper_totals_all")} == papers
    kept = [(k, i) for k, n in lines.groupby("l_orderkey").size().items() for i in range(1, n + 1) if (k * 7 + i) % 11]
    assert sorted((r.paper, r.id) for r in rows(spark, "rank_position_all")) == sorted(kept)
    cells = sum(r.n for r in rows(spark, "self_test_all"))
    assert cells == 5 * len(lines)


def test_assignment_of_all_orders(spark):
    """A sequential pass over the candidates of every order."""
    want = []
    by_paper = {}
    for r in registry.queries()["link_candidates_all"](spark, SF).collect():
        by_paper.setdefault(r.paper, []).append((r.distance, r.pred_id, r.gold_id))
    for paper, links in by_paper.items():
        p, g = set(), set()
        for _, a, b in sorted(links):
            if a not in p and b not in g:
                p.add(a)
                g.add(b)
                want.append((paper, a, b))
    got = sorted((r.paper, r.pred_id, r.gold_id) for r in rows(spark, "assign_greedy"))
    assert got == sorted(want) and {k for k, *_ in got} == set(by_paper)


def test_texts_of_all_orders(spark):
    lines, orders = read("lineitem"), read("orders")
    metrics = {r.doc: r.table_rows for r in rows(spark, "content_metrics_all")}
    assert metrics == lines.groupby("l_orderkey").size().to_dict()
    assert {r.doc for r in rows(spark, "numbers_all")} == set(metrics) == {r.doc for r in rows(spark, "tables_to_rows_all")}
    counts = {k: x.astype("int64").value_counts().to_dict() for k, x in lines.groupby("l_orderkey").l_quantity}
    want = []
    for a in orders.o_orderkey:
        x, y = counts.get(a, {}), counts.get(a + 1, {})
        want += [(a, f"{n}.5", max(d, 0), max(-d, 0)) for n in {*x, *y} if (d := x.get(n, 0) - y.get(n, 0))]
    assert sorted((r.a, r.number, r.only_a, r.only_b) for r in rows(spark, "exclusive_numbers_all")) == sorted(want)


def test_whole_texts_are_compared(spark):
    texts = read("conversations").dropna(subset="text")
    assert (texts.text.str.len() > 200).any()
    plain = lambda x: " ".join(re.sub("<[^>]+>", " ", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", x)).split()).lower()
    want = {(r.conv_id, r.turn): similarity(plain(r.text), plain(r.text[::-1])) for r in texts.itertuples()}
    got = {(r.conv_id, r.turn): r.similarity for r in rows(spark, "text_similarity")}
    assert got == pytest.approx(want, abs=0.051)


def similarity(a, b):
    """Twice the longest common subsequence over both lengths, by rows of the whole table."""
    last = np.zeros(len(b) + 1, int)
    codes = np.array([ord(c) for c in b])
    for c in a:
        step = np.maximum(last[1:], np.where(codes == ord(c), last[:-1] + 1, 0))
        last[1:] = np.maximum.accumulate(step)
    return 100 * 2 * last[-1] / (len(a) + len(b)) if a or b else 100.0


def test_points_take_key_rows_once(spark):
    """Several points and key rows a group: each key row goes to one point, and no class comes twice."""
    draw = random.Random(4)
    value = lambda: (draw.choice([0.0, 10.0, 10.03, 20.0, 30.0]), draw.choice([-5.0, 0.0, 5.0, 5.02, 7.0, 9.0]))
    points = [(g, i, *value()) for g in "abcd" for i in range(12)]
    key = [(g, i, *value()) for g in "abc" for i in range(8)]
    p, k = spark.createDataFrame(points, "grp string, id long, t double, x double"), spark.createDataFrame(key, "grp string, key_id long, t double, x double")
    links, want = {}, {}
    for g, i, t, x in points:
        for h, j, kt, kx in key:
            if g == h and abs(t - kt) < 0.051 and (abs(x - kx) <= 0.006 * abs(kx) or abs(x - kx) < 5e-5) and (g, j) not in links.values():
                links[g, i] = (g, j)
                break
    for g, i, t, x in points:
        own = [(kt, kx) for h, _, kt, kx in key if h == g]
        same_x, same_t = any(abs(x - kx) <= 0.006 * abs(kx) for _, kx in own), any(abs(t - kt) < 0.051 for kt, _ in own)
        want[g, i] = "exact" if (g, i) in links else "unknown" if not own else "wrong_time" if same_x else "wrong_x" if same_t else "not_in_table"
    found = linkage.match_points(p, k, ["grp"])
    assert {(r.grp, r.pred_id): (r.grp, r.gold_id) for r in found.collect()} == links
    assert sorted((r.grp, r.id, r.kind) for r in linkage.classify_points(p, k, ["grp"], found).collect()) == sorted((g, i, c) for (g, i), c in want.items())


def test_tolerance_match_is_one_to_one(spark):
    pairs = [(r.pred_id, r.gold_id) for r in rows(spark, "tolerance_match_one")]
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert set(pairs) <= {(r.pred_id, r.gold_id) for r in rows(spark, "tolerance_match")}


def test_aliases_in_long_values(spark):
    """An alias is found however long the value is, at its end too, and a prefix takes nothing else away."""
    aliases = spark.createDataFrame([("polystyrene", "PS"), ("styrene", "S"), ("b" * 12_000, "B"), ("ab", "short")], "alias string, canonical string")
    values = [("x" * 5000 + "PolyStyrene", "PS"), ("y" * 150 + "styrene" + "y" * 150, "S"), ("lithium" + "b" * 12_000, "B"), ("zab", "zab"), ("q" * 300, "q" * 300), (None, None)]
    df = spark.createDataFrame(values, "v string, want string")
    assert all(r.canonical == r.want for r in linkage.canonical_alias(df, "v", aliases).collect())


def test_sources_by_recorded_figures_and_quotes(spark):
    text = "start\n<!-- page 1 of 3 -->\nFig. 4 on a line\n<!-- page 2 of 3 -->\nThe samples were  dried in vacuum for two days\n<!-- page 3 of 3 -->\nend"
    docs = spark.createDataFrame([("d", text), ("e", text)], "id string, text string")
    figures = spark.createDataFrame([("d", 0, 9, "Fig. 40 x"), ("d", 1, 3, " Figure 4a. Plots"), ("d", 2, 2, "Fig. 4 again"), ("d", 3, None, "Fig. 5"), ("d", 4, 2, "FIG 5b")], "id string, at int, page int, caption string")
    asked = [("d", 1, "Fig. 4", None, None, 3), ("d", 2, "figure 5", None, None, 2), ("e", 3, "Fig. 4", None, None, 1), ("d", 4, "Fig. 6", "samples were dried in", 1, 2), ("d", 5, None, "The samples were dried in vacuum $x$ for", 1, 2), ("d", 6, "Table 4", "no such words here", 3, 3), ("d", 7, "Fig. 40", None, None, 9)]
    points = spark.createDataFrame([(i, n, "figure", label, page, quote) for i, n, label, quote, page, _ in asked], "id string, point int, kind string, label string, page int, quote string")
    got = {r.point: r.found_page for r in corpus.resolve_sources(points, docs, "text", "id", figures).collect()}
    assert got == {n: want for _, n, _, _, _, want in asked}
    pages = {r.doc_id: r.found_page for r in rows(spark, "resolve_sources_all")}
    size = read("documents").set_index("doc_id").text.str.split().str.len()
    want = {0: 3, 1: 2, 2: 1, 3: 1, 4: 1, 5: 2}
    assert all(pages[i] == want[i % 6] for i, n in size.items() if n >= 20)


def test_discovery_within_a_budget(spark):
    """Node 3 is too dear after 2; the cheaper 4 is followed, in all rounds together."""
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 5), (3, 6), (4, 7), (7, 8)], "src long, dst long")
    scores = spark.createDataFrame([(2, 3), (3, 2), (4, 2), (5, 1), (6, 1), (7, 3), (8, 3)], "node long, score int")
    costs = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, 1), (7, 2)], "node long, cost int")
    run = lambda **more: {r.node for r in graph.discover(spark.createDataFrame([(1,)], "node long"), edges, scores, 5, **more).collect()}
    assert run() == {2, 3, 4, 5, 6, 7, 8} == run(costs=costs, budget=15)
    assert run(costs=costs, budget=5) == {2, 3, 4, 5, 7} and run(costs=costs, budget=6) == {2, 3, 4, 5, 7, 8} and run(costs=costs, budget=0) == set()


def test_orders_and_neighbours_of_all_rows(spark):
    assert sorted(r.position for r in rows(spark, "rank_results_all")) == list(range(1, len(read("events")) + 1))
    assert sorted(r.position for r in rows(spark, "natural_sort_all")) == list(range(1, len(read("part")) + 1))
    links = read("lineitem")[["l_suppkey", "l_partkey"]].drop_duplicates()
    assert len(rows(spark, "neighbours_all")) == len(links) + links.groupby("l_partkey").size().clip(upper=400).sum()


def test_positions_over_partitions(spark):
    draw = random.Random(9)
    values = [(i, draw.choice([None, *range(50)])) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(values, "i int, v int").repartition(7)
        got = {r.i: r.position for r in explore.with_position(df, [F.col("v").desc_nulls_last(), F.col("i")]).collect()}
        assert explore.with_position(df.limit(0), [F.col("i")]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: n for n, (i, _) in enumerate(want, 1)}
