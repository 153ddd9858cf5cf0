"""What the smallest tables don't show: joins that go through the driver, odd keys, and slow or wide steps."""

import random
import re

from labtables.functions import cells as c
from labtables import shared
from labtables.operators import corpus, linkage, quotes
from labtables.queries import linking, queries

SF = "/root/testdata/sf0.001"


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_points_are_classified_without_broadcast(spark, capsys):
    text = plan(queries()["classify_points"](spark, SF), capsys)
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_year_of_a_file_is_not_its_id(spark):
    names = ["c2010-Author1910a.pdf", "c1950-x", "linden1988", "a-b-1999", None]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "v string").select(c.year_of_file("v")).collect()] == [1910, None, 1988, 1999, None]


def test_scoring_is_compiled(spark, capsys):
    """A generated method of over 8000 bytes is never compiled by the JVM, and runs a cell in 60 times as long."""
    cells = spark.range(5).selectExpr("'q' as column", "string(id) as pred", "string(id + 1) as gold")
    classes = spark.createDataFrame([("d", "percent")], "column string, class string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        linkage.compare_cells(cells, classes).explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_odd_cells_are_read_as_before(spark):
    texts = [" 5 ", "5\n", "5 ", " 5 °C", "1.", ".5e3", "1e999", "5d", "NaN", "", " ", "+-1", "1 2", "٣", None]
    rows = spark.createDataFrame([(x,) for x in texts], "v string").select(c.number_with_unit("v"), c.is_blank("v")).collect()
    assert [r[0] for r in rows] == [5, 5, 5, 5, 1, 500, float("inf"), 5, None, None, None, None, None, None, None]
    assert [r[1] for r in rows] == [False] * 9 + [True, True] + [False] * 3 + [True]


def test_cells_of_linked_and_missed_rows(spark):
    """One pass gives what pairs and missed rows give: links without a predicted row have no cells."""
    gold = spark.createDataFrame([("a", 1, "5", None), ("a", 2, "6", "x"), ("b", 1, None, "y"), (None, 1, "7", "z")], "paper string, id long, q string, w string")
    pred = spark.createDataFrame([("a", 7, "5.1", "w"), ("a", 8, "9", None)], "paper string, id long, q string, w string")
    links = spark.createDataFrame([("a", 7, 1), ("a", 8, 1), ("a", 9, 2)], "paper string, pred_id long, gold_id long")
    classes = spark.createDataFrame([("w", "text")], "column string, class string")
    both = linkage.compare_cells(linkage.pair_cells(pred, gold, links, ["paper"], "id", "id", ["q", "w"]), classes).selectExpr("paper", "gold_id", "column", "outcome", "false as unmatched")
    missed = linkage.missed_rows(gold, links, ["paper"], "id", ["q", "w"]).selectExpr("paper", "id as gold_id", "column", "outcome", "true as unmatched")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(linkage.score_cells(pred, gold, links, ["paper"], "id", "id", ["q", "w"], classes)) == key(both.union(missed))


def test_few_stretches_are_compared(monkeypatch):
    """A long quote that a long text of the same words lacks is compared with few of its stretches."""
    draw, tried, at = random.Random(3), [], quotes.Like.at
    monkeypatch.setattr(quotes.Like, "at", lambda self, text, start: tried.append(start) or at(self, text, start))
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(60)]
    text, quote = "".join(draw.choices(words, k=3000)), "".join(draw.choices(words, k=60))
    near = text[5000:5180] + "zz" + text[5180:5300]
    assert quotes.stands_nearly([quote, near], text, 0.92) == {1}
    assert len(tried) < 2000


def test_links_and_numbers_are_dealt_by_input_size(spark, capsys, monkeypatch):
    monkeypatch.setattr(shared, "PART_BYTES", 5000)
    for name, table in (("link_candidates", "lineitem"), ("exclusive_numbers", "lineitem")):
        parts = shared.parts_of(spark.read.parquet(f"{SF}/{table}.parquet"))
        assert parts > 20
        dealt = [int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan(queries()[name](spark, SF), capsys))]
        assert len(dealt) >= 4 and min(dealt) >= parts
    assert shared.parts_of(spark.range(3)) is None


def test_lines_are_matched_once(spark, capsys):
    text = "x\n| curve | 1.5 |\n|---|---|\n| 2 | 3.25 |\n<table><tr><td>1234567</td></tr><tr><td>7</td></tr></table>\n$$x$$"
    df = corpus.content_metrics(spark.createDataFrame([(1, text), (2, None)], "id long, text string").repartition(2), "text", "id")
    assert plan(df, capsys).count(corpus.TABLE_ROW) == 1
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, len(text), 2, 2, 5, 1, 1, 5, 1), (2, 0, 0, 0, 0, 0, 0, 0, 0)]


def test_scored_cells_stay_where_they_are(spark, capsys):
    """Cells were dealt by the name of their field, and wide rows three times by paper and id."""
    assert "hashpartitioning(column" not in plan(linking._cells(spark, SF), capsys)
    key, before = "spark.sql.requireAllClusterKeysForCoPartition", spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with shared.settings(spark, shared.SPARE):
        dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan(linking._cells(spark, SF), capsys))
    assert set(dealt) == {"l_orderkey"} and spark.conf.get(key) == before
