"""Operators on skewed input: one search, one group, one chain, many columns."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from labtables.operators import categories, explore, graph, linkage, reports, stats


def taken(items, budget):
    left, out = budget, []
    for key, cost in items:
        if cost is not None and cost <= left:
            left -= cost
            out.append(key)
    return sorted(out)


def test_budget_of_one_large_search(spark):
    """A million items of one search: as a loop takes them, and few of them reach the pass in order."""
    rows = spark.range(1_000_000).select(F.lit("s").alias("search"), "id", (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("cost"), F.xxhash64("id", F.lit(1)).alias("rank")).repartition(8)
    items = [(r.id, r.cost) for r in rows.orderBy("rank", "id").collect()]
    for budget in (0, 7, 1_000):
        got = sorted(r.id for r in graph.take_within_budget(rows, "search", "cost", ["rank", "id"], budget).collect())
        assert got == taken(items, budget)


def test_budget_of_odd_costs(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), i, draw.choice([0, 0, 1, 2, 3, 9, 200, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, cost long").repartition(5)
    for budget in (0, 1, 10, 500):
        got = graph.take_within_budget(df, "g", "cost", ["i"], budget)
        assert got.columns == df.columns
        kept = {g: sorted(r.i for r in got.collect() if r.g == g) for g in ("a", "b", None)}
        assert kept == {g: taken([(i, c) for h, i, c in rows if h == g], budget) for g in ("a", "b", None)}
    assert graph.take_within_budget(df.limit(0), "g", "cost", ["i"], 5).count() == 0
    with pytest.raises(Exception, match="negative"):
        graph.take_within_budget(spark.createDataFrame([("a", 1, -1)], df.schema), "g", "cost", ["i"], 5).collect()


def test_matrix_of_many_columns(spark):
    """400 columns in one pass: some sparse, constant, constant where another is present, far from zero,
    not finite or empty."""
    draw = random.Random(2)
    n, names = 300, [f"c{i}" for i in range(400)]
    columns = []
    for i in range(400):
        scale, base, share = draw.choice([1, 1e-6, 1e6]), draw.choice([0, 0, 1e6]), draw.choice([0, 0.3, 0.97])
        columns.append([None if draw.random() < share else base + scale * draw.gauss(0, 1) for _ in range(n)])
    columns[3], columns[4] = [7.1] * n, [None] * n
    columns[5] = [0.1 if k < 200 else float(k) for k in range(n)]
    columns[6] = [float(k) if k < 200 else None for k in range(n)]
    columns[7] = [float("nan") if k % 3 == 0 else float("inf") if k % 3 == 1 else columns[8][k] for k in range(n)]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"{c} double" for c in names)).repartition(6)
    got = {(r.label_a, r.label_b): (r.r, r.n) for r in stats.corr_matrix(df, names).collect()}
    assert len(got) == 160_000
    some = [names[i] for i in (0, 1, 3, 4, 5, 6, 7, 8, 50, 99, 200, 301, 399)]
    for r in stats.corr_matrix(df, some).collect():
        own, count = got[r.label_a, r.label_b]
        assert count == r.n and (own is None) == (r.r is None), (r, own)
        assert own is None or abs(own - r.r) < 1e-9, (r, own)
    assert got["c5", "c6"][0] is None and got["c3", "c3"] == (1.0, n)
    with pytest.raises(Exception, match="no correlation of"):
        stats.corr_matrix(df, names, "error").collect()


def test_many_features_against_many_targets(spark, monkeypatch):
    draw = random.Random(8)
    names = [f"v{i}" for i in range(9)]
    df = spark.createDataFrame([tuple(None if draw.random() < 0.2 else draw.uniform(-1, 9) for _ in names) for _ in range(200)], ", ".join(f"{c} double" for c in names))
    table = lambda: sorted((r.target, r.feature, r.n, round(r.r, 9)) for r in stats.corr_targets(df, names[:5], names[4:]).collect())
    few = table()
    monkeypatch.setattr(stats, "PAIRS_A_PLAN", 3)
    assert table() == few and len(few) == 25
    assert stats.corr_targets(df.limit(0), names[:5], names[4:]).count() == 0


def greedy(rows):
    used, out = (set(), set()), []
    for g, p, q, d in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if (g, p) not in used[0] and (g, q) not in used[1]:
            used[0].add((g, p))
            used[1].add((g, q))
            out.append((g, p, q))
    return sorted(out)


SCHEMA = "grp string, pred_id int, gold_id int, distance double, quality string"


@pytest.mark.parametrize("bound", [40, 9])
def test_assignment_by_groups_components_and_rounds(spark, bound):
    draw = random.Random(3)
    rows = {(g, draw.randrange(40), draw.randrange(40)): draw.choice([0.1, 0.2, draw.random()]) for g in ["hot"] * 5 + ["a", "b"] for _ in range(9)}
    rows |= {("c", i, i + j): 0.5 + i * 0.001 + j * 0.0005 for i in range(30) for j in (0, 1)}
    rows = [(*k, d) for k, d in rows.items()]
    df = spark.createDataFrame([(*r, "q") for r in rows], SCHEMA).repartition(4)
    got = linkage.assign_greedy(df, ["grp"], pass_candidates=bound)
    assert got.columns == df.columns
    assert sorted((r.grp, r.pred_id, r.gold_id) for r in got.collect()) == greedy(rows)


def test_chain_of_ten_thousand_pairs(spark):
    """Each pair is better than the next, so rounds would be ten thousand: a component takes one pass."""
    rows = [("g", i // 2, (i + 1) // 2, i / 1e6) for i in range(10_000)] + [("g", 20_000 + i, 20_000 + i, 0.5) for i in range(9_000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], SCHEMA).repartition(4)
    got = linkage.assign_greedy(df, ["grp"], pass_candidates=15_000)
    assert sorted((r.grp, r.pred_id, r.gold_id) for r in got.collect()) == greedy(rows)


def test_medians_of_a_group_with_nearly_all_rows(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["hot"] * 20 + ["a", "b", None]), draw.choice([None, draw.gauss(0, 9), draw.randrange(4)]), draw.randrange(3)) for _ in range(6_000)]
    rows += [("none", None, 1), ("one", 5.0, None), ("two", 1.0, 7), ("two", 4.0, None)]
    df = spark.createDataFrame([(g, None if x is None else float(x), y) for g, x, y in rows], "arm string, x double, y int").repartition(7)
    got = {r.arm: (r.median_x, r.median_y) for r in reports.medians(df, ["arm"], ["x", "y"]).collect()}
    for arm in {r[0] for r in rows}:
        want = [statistics.median(v) if (v := [r[k] for r in rows if r[0] == arm and r[k] is not None]) else None for k in (1, 2)]
        assert got[arm] == pytest.approx(tuple(want)) if None not in want else got[arm] == tuple(want), arm
    assert reports.medians(df.limit(0), ["arm"], ["x"]).count() == 0


@pytest.mark.parametrize("share,least", [(0.006, 5e-5), (0.2, 0.0), (0.0, 0.5), (1.5, 1e-3), (0.0, 0.0)])
def test_tolerance_pairs_against_all(spark, share, least):
    draw = random.Random(7)
    values = [0.0, 1e-5, -1e-5, 4.9e-5, 1.0, 1.006, 1.00601, -1.0, -1.005, 100.0, 100.5, 0.3, 0.8, None]
    make = lambda n: [(draw.choice("gh"), i, draw.choice([1.0, 1.05, 1.051, 2.0, None, -0.02, 0.03]), draw.choice(values)) for i in range(n)]
    points, key = make(150), make(120)
    p, k = spark.createDataFrame(points, "grp string, id int, t double, x double"), spark.createDataFrame(key, "grp string, key_id int, t double, x double")
    got = sorted((r.grp, r.pred_id, r.gold_id) for r in linkage.match_key(p, k, ["grp"], 0.051, share, least).collect())
    near = lambda t, x, kt, kx: abs(t - kt) < 0.051 and (abs(x - kx) <= share * abs(kx) or abs(x - kx) < least)
    want = sorted((g, i, j) for g, i, t, x in points for h, j, kt, kx in key if g == h and None not in (t, x, kt, kx) and near(t, x, kt, kx))
    assert got == want


def test_tolerance_join_of_one_time(spark):
    """A hundred thousand points of one time in one group meet only key rows of about their x."""
    p = spark.range(100_000).selectExpr("'g' AS grp", "id", "5.0 AS t", "10.0 * pow(1.02, id % 500) AS x")
    k = spark.range(500).selectExpr("'g' AS grp", "id AS key_id", "5.0 AS t", "10.0 * pow(1.02, id) AS x")
    out = linkage.match_key(p, k, ["grp"])
    assert out.count() == 100_000 and out.filter("pred_id % 500 <> gold_id").isEmpty()


def test_places_of_many_distinct_values(spark):
    """Ranks as sorted plainly: frequent values, many of one frequency, ties, far ends, and no window over all."""
    draw = random.Random(9)
    rows = [(i, f"v{draw.randrange(900)}") for i in range(2_000)] + [(10**9 + i, "hot") for i in range(2_500)] + [(2_000 + i, "warm") for i in range(1_100)] + [(5, "tie"), (5, "tie2"), (7, None)]
    df = spark.createDataFrame(rows, "i long, v string").repartition(6)
    first, n = {}, {}
    for i, v in rows:
        if v is not None:
            first[v], n[v] = min(i, first.get(v, i)), n.get(v, 0) + 1
    want = sorted(n, key=lambda v: (-n[v], first[v], v))
    ranked = categories.rank_categories(df, "v", "i")
    assert [r.value for r in ranked.orderBy("rank").collect()] == want and [r[0] for r in ranked.select("rank").orderBy("rank").collect()] == list(range(len(want)))
    by_text = categories.rank_categories(df.withColumn("s", F.format_string("%012d", "i")), "v", "s")
    assert [r.value for r in by_text.orderBy("rank").collect()] == want
    seen = categories.group_order(df, ranked.filter("rank < 50"), "v", "i")
    assert [r.value for r in seen.orderBy("position").collect()] == want[:50] + sorted(want[50:], key=lambda v: (first[v], v)) + [None]
    features = explore.infer_columns(df.withColumn("x", F.lit("1")), "v", "x", "i").orderBy("position").collect()
    assert [r.v for r in features if r.v] == sorted(n, key=lambda v: (first[v], v)) and features[0].position == 1
    assert categories.rank_categories(df.limit(0), "v", "i").count() == 0
    wide = spark.range(1_000_000).select("id", F.concat(F.lit("v"), "id").alias("v"))
    out = categories.rank_categories(wide, "v", "id")
    assert out.filter("rank <> substring(value, 2)").isEmpty() and out.count() == 1_000_000
