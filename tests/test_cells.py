import pytest
from pyspark.sql import functions as F

from labtables.functions import cells as c


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_numbers(spark):
    rows = ["1", " 2.5 ", "-3e-4", ".5", "+7.", "", None, "None", "N/A", "na", "NaN", "1d", "inf", "1_0", "abc", " 4\t"]
    assert values(spark, c.parse_number("v"), rows) == [1, 2.5, -3e-4, 0.5, 7, *[None] * 10, 4]
    assert values(spark, c.is_junk_number("v"), rows) == [False] * 10 + [True] * 5 + [False]
    with pytest.raises(Exception, match="not a number"):
        values(spark, c.parse_number("v", strict=True), ["1", "junk"])


def test_text(spark):
    assert values(spark, c.parse_text("v"), ["a b", "﻿x​", "  ", None, "na", "a \n b"]) == ["a b", "x", None, None, "na", "a b"]


def test_axes(spark):
    df = spark.createDataFrame([(30.0, -3.0), (30.0, None), (20.0, 70.0)], "t double, tg double")
    rows = df.select(*[F.round(c.axis_transform(m, "t", "tg"), 5).alias(m) for m in ("arrhenius", "T", "tg_ratio", "tg_shifted")]).collect()
    assert tuple(rows[0]) == (3.29870, 30.0, 1.12215, 12.04819) and rows[1].tg_ratio is None and rows[1].tg_shifted is None and rows[2].tg_shifted is None


def test_phrases(spark):
    rows = ["20 wt%", "O/Li = 20", "Li:O = 24:1", "EO:Li = 20:1", "= 5", "none", None, "0/5", "1/4"]
    got = [tuple(x) for x in values(spark, c.parse_concentration("v"), rows)]
    assert [g[1] for g in got] == [20, 0.05, 0.041667, 0.05, None, None, None, None, 0.25]
    assert [bool(g[2]) for g in got] == [False, False, True, *[False] * 6]


def test_placeholders(spark):
    df = spark.createDataFrame([("a", "N/A."), ("Tm", "na"), ("crystalline?", "na"), ("a", "none"), ("a", None), ("a", "?")], "f string, v string")
    assert [r[0] for r in df.select(c.is_placeholder("v", "f", {"crystalline?": ("na",)})).collect()] == [True, True, False, False, False, True]


def test_names(spark):
    assert values(spark, c.snake_id("v"), ["Mn (kg/mol)", "2nd run", "_x_"]) == ["mn_kg_mol", "f_2nd_run", "x"]
    assert values(spark, c.camel_id("v"), ["crystalline?", "drying temp", "Tg (C)", "SMILES descriptor 1"]) == ["crystalline", "dryingTemp", "tgC", "smilesDescriptor1"]
    assert values(spark, c.natural_key("v"), ["a10", "a2", "A02"])[1] == values(spark, c.natural_key("v"), ["A02"])[0]
    assert values(spark, c.number_with_unit("v"), ["55 °C", "24 h", "none", "1e-3", "5-6", "7"]) == [55, 24, None, 1e-3, None, 7]
    assert values(spark, c.file_id("v"), ["ab12-x.pdf"]) == ["ab12"] and values(spark, c.year_in("v"), ["linden1988", "x"]) == [1988, None]
    assert values(spark, c.condition_of("v"), ["S 70 °C", "thermal run", "0.5 wt% x", "y"]) == [70, 0, 0.5, None]
    families = ["Polyethers and carbonates", "carbonate; , poly ether.", "ether-ester", "a+b", "poly(ethers)", " "]
    assert values(spark, c.canonical_family("v"), families) == [["carbonate", "ether"], ["carbonate", "ether"], ["ether-ester"], ["a+b"], ["(ethers)"], None]
    assert values(spark, c.canonical_text("v"), [".5 M", "5 M..", " A\u00a0 b ", ""]) == [".5 m", "5 m", "a b", None]
