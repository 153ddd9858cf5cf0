import random

import pytest
from pyspark.sql import functions as F

from labtables.operators import assemble, categories, corpus, explore, graph, linkage, reports, scoring, series, stats


def test_sort_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(0, 3), (1, None), (2, 1), (3, None), (4, 2)], "row_index int, v int")
    order = lambda d: [r.row_index for r in explore.natural_sort(df, "v", d).collect()]
    assert order(False) == [2, 4, 0, 1, 3] and order(True) == [0, 4, 2, 1, 3]
    text = spark.createDataFrame([(0, "Comonomer10"), (1, "comonomer2"), (2, "Äb"), (3, "aa"), (4, None)], "row_index int, v string")
    assert [r.row_index for r in explore.natural_sort(text, "v").collect()] == [3, 2, 1, 0, 4]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "x%"), (2, "b", "y"), (3, None, None)], "row_index int, p string, q string")
    ids = lambda d: sorted(r.row_index for r in d.collect())
    assert ids(explore.multi_filter(df, {"p": ["a", "b"], "q": ["y"]})) == [2] and ids(explore.multi_filter(df, {"p": []})) == [1, 2, 3]
    assert ids(explore.text_search(df, "%", ["p", "q"])) == [1] and ids(explore.text_search(df, " ", ["p"])) == [1, 2, 3]
    rows, info = explore.page(df.limit(0), 5, 0, [F.col("row_index")])
    assert rows.count() == 0 and tuple(info.first()) == (0, 1, 1, 0, 0)
    with_own = explore.overlay(df, spark.createDataFrame([("z",)], "p string"), {"p": ["a"]})
    assert sorted(r.origin for r in with_own.collect()) == ["dataset", "user"]


def test_ranks(spark):
    df = spark.createDataFrame(list(enumerate(["b", "a", "a", "b", "c", None])), "i int, v string")
    dim = categories.rank_categories(df, "v", "i")
    assert [(r.value, r["rank"]) for r in dim.orderBy("rank").collect()] == [("b", 0), ("a", 1), ("c", 2)]
    own = spark.createDataFrame([("zz",), ("a",), (None,)], "v string")
    folded = categories.fold_top(categories.with_rank(own, dim, "v"))
    assert sorted(r.bucket for r in folded.collect()) == [1, 7, 7]
    assert categories.topk_coverage(df.limit(0), "v", "i").first().covered == 0


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, None), (None, 1.0, 5.0, None)], "a double, b double, c double, d double")
    got = {(r.label_a, r.label_b): (r.r, r.n) for r in stats.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"] == (pytest.approx(1), 3) and got["a", "c"] == (None, 3) and got["a", "d"] == (None, 1) and got["d", "d"][0] == 1
    with pytest.raises(Exception, match="no correlation of"):
        stats.corr_matrix(df, ["a", "c"], "error").collect()


def test_single_row_rank(spark):
    df = spark.createDataFrame([("g", 0, None, 4.0), ("h", 0, 2.0, None), ("h", 1, 2.0, None), ("h", 2, None, None)], "g string, i int, x double, y double")
    got = [r.rank_pos for r in linkage.rank_position(df, ["g"], ["x", "y"], "i").orderBy("g", "i").collect()]
    assert got == [0.5, 0.0, 1.0, None]


def test_greedy_by_rounds_as_one_pass(spark):
    draw = random.Random(3)
    rows = [(g, p, q, round(draw.random(), 2), "direct") for g in range(6) for p in range(7) for q in range(6) if draw.random() < 0.6]
    df = spark.createDataFrame(rows, "grp int, pred_id int, gold_id int, distance double, quality string")
    pick = lambda d: sorted(map(tuple, d.select("grp", "pred_id", "gold_id").collect()))
    assert pick(linkage.assign_greedy(df, ["grp"])) == pick(linkage.assign_greedy_grouped(df, ["grp"]))


def test_indel():
    for a, b, want in [("abc", "abc", 1), ("", "", 1), ("a", "", 0), ("abcd", "acbd", 0.75), ("kitten", "sitting", 8 / 13)]:
        assert linkage.indel_ratio(a, b) == pytest.approx(want)


def test_compare_cells(spark):
    classes = spark.createDataFrame([("s", "log"), ("t", "temperature"), ("w", "text")], "column string, class string")
    rows = [("s", "1e-5", "1.2e-5", "correct"), ("s", "1e-5", "2e-5", "near"), ("s", "1e-5", "1e-3", "wrong"), ("s", "0", "0", "correct"), ("t", "55 °C", "57", "correct"), ("w", "A  b.", "a b", "correct"), ("x", "none", "55", "wrong"),
            ("x", "104", "100", "correct"), ("x", None, "1", "missing"), ("x", "1", " ", "extra"), ("x", None, "", "blank")]
    df = spark.createDataFrame(rows, "column string, pred string, gold string, want string")
    assert all(r.outcome == r.want for r in linkage.compare_cells(df, classes).collect())


def test_totals_keep_empty_groups(spark):
    cells = spark.createDataFrame([("a", "correct", False), ("a", "near", False), ("a", "missing", True), ("b", "extra", False)], "column string, outcome string, unmatched boolean")
    groups = spark.createDataFrame([("a", "g"), ("b", "h"), ("z", "none")], "column string, group string")
    got = {r["group"]: r for r in scoring.group_totals(cells, [], groups).collect()}
    assert (got["g"].accuracy, got["g"].accuracy_loose, got["g"].recall) == (0.5, 1.0, 0.3333) and got["h"].accuracy is None and got["none"].correct == 0


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("s", 1, 4), ("s", 2, 9), ("s", 3, 5), ("t", 1, 11), ("t", 2, 10)], "s string, i int, cost int")
    assert sorted((r.s, r.i) for r in graph.take_within_budget(df, "s", "cost", ["i"], 10).collect()) == [("s", 1), ("s", 3), ("t", 2)]


def test_discovery(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 2), (3, 5), (9, 3)], "src long, dst long")
    scores = spark.createDataFrame([(n, 3 if n in (2, 3) else 1) for n in range(1, 10)], "node long, score int")
    got = {r.node: (r.links, r["round"]) for r in graph.discover(spark.createDataFrame([(1,)], "node long"), edges, scores, 5).collect()}
    assert got == {2: (3, 1), 3: (1, 2), 4: (1, 2), 5: (1, 3), 9: (1, 3)}  # 2: both ways from 1, and from 3


def test_series(spark):
    df = spark.createDataFrame([(1, 0.1, None, -3.0), (2, None, None, 5.0), (3, -1.0, 2.0, None)], "i int, a double, b double, tg double")
    report = series.series_report(df, "i", {"a": 30, "b": 60}, "tg_ratio", "tg").first()
    assert tuple(report) == (2, 1, 0, 0, 1)
    assert series.series_points(df, "i", {"a": 30, "b": 60}, "T").count() == 2
    packed = series.pack_lines(spark.createDataFrame([(0, 1, 0, 1.0, 2.0), (0, 1, 1, 3.0, 4.0), (0, 2, 0, 5.0, 6.0)], "k int, s int, o int, x double, y double"), "k", "s", "o", "x", "y").first()
    assert packed.xs == [1, 3, None, 5] and packed.ys == [2, 4, None, 6]


def test_degrees():
    assert corpus.plain_degrees(r"7 0 ^{\circ} \mathrm{C}") == "70 °C"
    assert corpus.plain_degrees(r"\mathrm{Tg} = - 4 2 ^\circ C,") == "Tg = -42 °C,"
    assert corpus.plain_degrees(r"\sim 20 - 30 ^{\circ} C") == "~20-30 °C"
    assert corpus.plain_degrees(r"4 5^{0} \mathrm{C}") == "45 °C" and corpus.plain_degrees(r"4 5^{0} \mathrm{C}", False) is None
    assert corpus.plain_degrees(r"x^2 + 1") is None and corpus.plain_degrees(r"\frac{1}{2} ^\circ C") is None


def test_quotes(spark):
    docs = spark.createDataFrame([("d", "We used LiClO<sub>4</sub> at 20 wt% in the polymer host matrix.<td>LiTFSI</td><td>40 42 1748</td>")], "id string, text string")
    quotes = spark.createDataFrame([("d", 1, "LiClO4 at 20 wt%"), ("d", 2, "never stands there at all"), ("d", 3, "short"), ("d", 4, "at 20 wt% in the polimer host matrix"), ("d", 5, "polymer 40 42 1748 58")], "id string, n int, quote string")
    assert {r.n: r.found for r in corpus.verify_quotes(quotes, docs, "text", "id").collect()} == {1: "exact", 2: "none", 3: "none", 4: "near", 5: "none"}


def test_sample(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "i int, s string")
    first = sorted(r.i for r in reports.stratified_sample(df, "s", 3, "i").collect())
    assert len(first) == 6 and first == sorted(r.i for r in reports.stratified_sample(df.repartition(3), "s", 3, "i").collect())
    with pytest.raises(Exception, match="too few rows"):
        reports.stratified_sample(df, "s", 11, "i", strict=True).collect()


def test_round_trip_of_records(spark):
    rows = [("r1", "f", [("s1", [{"a": "1", "b": None}]), ("s2", [])]), ("r2", "g", [])]
    df = spark.createDataFrame(rows, "record_id string, file string, samples array<struct<sample:string,points:array<map<string,string>>>>")
    tables = assemble.shred(df)
    assert tables["point_values"].count() == 1
    features = spark.createDataFrame([("r1", "a"), ("r1", "b")], "record_id string, feature string")
    back = {r.record_id: [(s.sample, s.points) for s in r.samples] for r in assemble.unshred(tables, features).collect()}
    assert back == {"r1": [("s1", [{"a": "1", "b": None}]), ("s2", [])], "r2": []}
