"""Nulls, repeats, long values and odd names in the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from labtables.functions import cells as c
from labtables.operators import assemble, corpus, explore, graph, linkage, reports, scoring, series, stats
from labtables.operators import quotes as quotes_
from labtables.plans import pipelines
from labtables.sources import tables as src


def test_assignment_with_null_keys(spark):
    """Null groups are one group, null rows are rows; every pass ends."""
    rows = [(None, 1, 1, 0.1, "direct"), (None, 1, 2, 0.2, "direct"), (None, 2, 1, 0.3, "rank"), (None, None, 3, 0.4, "rank"), ("a", 1, None, 0.1, "rank"), ("a", 2, None, 0.2, "rank"), ("a", 3, 5, None, "rank"), ("a", 3, 5, None, "rank")]
    df = spark.createDataFrame(rows, "grp string, pred_id int, gold_id int, distance double, quality string")
    got = sorted((r.grp or "", r.pred_id or 0, r.gold_id or 0) for r in linkage.assign_greedy(df, ["grp"]).collect())
    assert got == [("", 0, 3), ("", 1, 1), ("a", 1, 0), ("a", 3, 5)]
    assert linkage.assign_greedy(df.limit(0), ["grp"]).count() == 0
    assert linkage.assign_greedy(df, ["grp"], rounds=1).count() <= 4


def test_metrics_of_odd_rows(spark):
    """Null and repeated ids have rows of their own, null texts are empty, tables are parted by lines."""
    table = "| curve | y |\n|---|---|\n| 1 | 2.5 |\n| 3 | 4.5 |\nwords\n| x | y |\n|---|---|\n| 1 | ~2 |\n| 2 | 3 |\n| 2 | ~3 |\n\n| x |\n|---|\n| 7 |"
    df = spark.createDataFrame([(None, table), (None, table), (1, table), (1, None), (2, "")], "id int, t string")
    got = sorted(((r.id or 0), r.tables, r.chart_rows, r.table_rows) for r in corpus.content_metrics(df, "t", "id").collect())
    assert got == [(0, 3, 5, 7), (0, 3, 5, 7), (1, 0, 0, 0), (1, 3, 5, 7), (2, 0, 0, 0)]
    assert corpus.content_metrics(df.limit(0), "t", "id").count() == 0


def test_figures_and_marks(spark):
    text = "![a](doc/page:1/block:2)" + "x" * 9000 + "\nFig. 1 too far\n![b](q)\nFig. 2 Near\n![c](img9)"
    df = spark.createDataFrame([(1, text), (2, None), (3, "none"), (1, text)], "id int, t string")
    got = sorted((r.id, r.at, r.path, r.page, r.caption) for r in corpus.figures(df, "t", "id").distinct().collect())
    assert got == [(1, 0, "doc/page:1/block:2", 1, None), (1, 1, "q", None, "Fig. 2 Near"), (1, 2, "img9", None, None)]
    known = spark.createDataFrame([(1, "q", "img1", "b"), (1, "q", "img1", "a"), (1, "z", "img9", "n9"), (1, "img9", None, "k9"), (1, None, None, "x")], "id int, loc string, img string, to string")
    one = df.filter("id = 1").limit(1)
    plain = corpus.rewrite_figures(one, known.filter("loc <> 'img9'"), "t", "id", "loc", "to").first().t
    assert plain.endswith("![b](a)\nFig. 2 Near\n![c](img9)")
    assert corpus.rewrite_figures(one, known.filter("loc <> 'img9'"), "t", "id", "loc", "to", "img").first().t.endswith("![c](n9)")
    assert corpus.rewrite_figures(one, known, "t", "id", "loc", "to", "img").first().t.endswith("![c](k9)")


def test_natural_keys_of_any_length(spark):
    values = ["a2", "a10", "a" + "9" * 30, "a1" + "0" * 30, "a01", "b", "7", "10", "", None, "x" + "1" * 120]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int")
    got = [r.v for r in explore.natural_sort(df, "v", row="i").collect()]
    assert got == ["", "7", "10", "a01", "a2", "a10", "a" + "9" * 30, "a1" + "0" * 30, "b", "x" + "1" * 120, None]


def test_names_as_patterns(spark):
    """Words with characters of patterns stand for themselves; long words keep their ends."""
    df = spark.createDataFrame([("it is C++ here", "p.v.a", "poly vinyl"), ("a.c", "pxvxa", "p.v.a")], "s string, a string, b string")
    assert [r[0] for r in df.select(c.vocab_snap("s", ("a.c", "abc"))).collect()] == ["it is c++ here", "a.c"]
    rows = linkage.name_similarity(df, "a", "b", short={"p.v.a": "poly vinyl"}).collect()
    assert [round(r.similarity, 2) for r in rows][0] == 1.0 and rows[1].similarity < 1
    long = spark.createDataFrame([("x" * 12_000 + " " + "y" * 11_000 + "Z",)], "s string")
    assert long.select(F.length(c.camel_id("s"))).first()[0] == 23_001


def test_points_that_are_not_numbers(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "NaN", 2), ("b", "1d", 3), ("c", " 1.5 ", 4), ("d", None, 5)], "f string, v string, o int")
    assert {r.f: r.numeric for r in explore.infer_columns(df, "f", "v", "o").collect()} == {"a": False, "b": False, "c": True, "d": False}


def test_lines_in_rows(spark):
    points = spark.createDataFrame([(k % 2, f"s{k % 5}", k, float(k), None if k % 7 == 0 else 1.0) for k in range(40)], "slot int, s string, o int, x double, y double")
    packed = {r.slot: r for r in series.pack_lines(points, "slot", "s", "o", "x", "y").collect()}
    for slot in (0, 1):
        want = []
        for name in sorted({f"s{k % 5}" for k in range(40) if k % 2 == slot}):
            want += [float(k) for k in range(40) if k % 2 == slot and f"s{k % 5}" == name] + [None]
        assert packed[slot].xs == want[:-1] and packed[slot].samples == 5
    assert series.line_rows(points, "slot", "s", "o", "x", "y").count() == 50


def test_papers_of_files(spark):
    files = spark.createDataFrame([("f1", "Smith", 1990, None), ("f2", "Nobody", 1, "10.1/x"), ("f3", "None", 2, None)], "file string, surname string, year int, doi string")
    papers = spark.createDataFrame([(1, "Smith, J. 1990", None), (2, "Smith, K. 1990", None), (3, "Else", "10.1/X")], "paper int, reference string, doi string")
    assert {r.file: (r.paper, r.n_found) for r in linkage.map_papers(files, papers).collect()} == {"f1": (1, 2), "f2": (3, 1), "f3": (None, 0)}
    assert linkage.map_papers(files.filter("file = 'f2'"), papers, strict=True).first().paper == 3
    for name in ("f1", "f3"):
        with pytest.raises(Exception, match="not one paper"):
            linkage.map_papers(files.filter(f"file = '{name}'"), papers, strict=True).collect()


def test_registry_and_imports(spark):
    headers = spark.createDataFrame([("t", "Tg (C)"), ("m", "Mass (kg)"), ("n", "Name")], "id string, label string")
    none = spark.createDataFrame([], "id string, kind string")
    words = spark.createDataFrame([("t", "verified")], "id string, description string")
    units = spark.createDataFrame([("t", "K")], "id string, unit string")
    pages = spark.createDataFrame([("t", "b"), ("t", "a"), ("t", "a")], "id string, page string")
    got = {r.id: (r.unit, r.description, r.pages) for r in src.build_registry(headers, none, words, words, units, pages).collect()}
    assert got == {"t": ("K", "verified", ["a", "b"]), "m": ("kg", None, []), "n": (None, None, [])}
    own = spark.createDataFrame([(" tg (c)", 0), ("TG (C)", 1), ("what", 2), ("Name", 3)], "header string, position int")
    assert sorted(r.header for r in src.ignored_headers(own, headers).collect()) == ["TG (C)", "what"]
    df = spark.createDataFrame([("tfsi", "1"), ("New", "x"), (None, " 2 ")], "Anion string, N string")
    known = spark.createDataFrame([("TFSI", 0), ("Tfsi", 1)], "value string, rank int")
    rows, report = src.import_table(df, {"anion": ("Anion", "text"), "n": ("N", "numeric")}, categories={"anion": known})
    assert rows.columns == ["anion", "n"] and sorted(map(str, rows.collect())) == sorted(map(str, spark.createDataFrame([("TFSI", 1.0), ("New", None), (None, 2.0)], "anion string, n double").collect()))
    assert tuple(report.first()) == (3, 1, None)
    held = spark.createDataFrame([("a" * 32,)], "record_id string")
    new = spark.createDataFrame([("a" * 32, None), ("b" * 32, None), ("b" * 32, None), ("zz", None), (None, "{"), (None, None)], "record_id string, _corrupt_record string")
    assert assemble.import_report(held, new).first().asDict() == {"seen": 6, "unreadable": 1, "badly_named": 2, "stored": 1, "repeated": 1, "new": 1}


def test_solvents(spark):
    """Letters and digits alone count, subscripts are digits, and unknown names are compared by them."""
    aliases = spark.createDataFrame([("THF", "tetrahydrofuran"), ("t-h-f", "zzz"), ("--", "none"), ("H2O", "water")], "alias string, canonical string")
    asked = [("T.H.F.", "tetrahydrofuran"), ("H₂O", "water"), (" Some  Oil. ", "someoil"), ("di-methyl X", "dimethylx"), ("dimethylx", "dimethylx"), (None, None), (" ", None), ("--", "none")]
    df = spark.createDataFrame(asked, "s string, want string")
    assert all(r.solvent == r.want for r in linkage.canonical_solvent(df, "s", aliases).collect())


def test_alias_order(spark):
    """All prefixes of the whole value come before what stands ahead of a bracket; blank is null."""
    aliases = spark.createDataFrame([("x", "short"), ("x(y)", "whole"), ("lithiumx", "salt")], "alias string, canonical string")
    asked = [("Li x (y)", "whole"), ("x (z)", "short"), ("lithium-x (y)", "whole"), ("Lithium x (q)", "salt"), ("(x)", "(x)"), (" ", None), (None, None)]
    df = spark.createDataFrame(asked, "v string, want string")
    assert all(r.canonical == r.want for r in linkage.canonical_alias(df, "v", aliases).collect())


def test_shares_and_samples(spark):
    df = spark.createDataFrame([("x", "a", 1, 4), ("x", "b", 0, 0), ("y", "a", 3, 4), (None, "a", 0, 8)], "stratum string, mode string, chart_rows int, table_rows int")
    got = {(r.stratum, r.overall): (r.a, r.b) for r in reports.digitised_share(df, "stratum", "mode", ["a", "b"]).collect()}
    assert got == {("x", 0): (0.25, None), ("y", 0): (0.75, None), (None, 0): (0.0, None), (None, 1): (0.25, None)}
    strata = spark.createDataFrame([(i, "a" if i else None) for i in range(5)], "i int, s string")
    assert reports.stratified_sample(strata, "s", 1, "i", strict=True).count() == 2


def test_groups_of_any_number(spark):
    """Every key has a row for each of thousands of groups, and a key without grouped columns has zeros."""
    cells = spark.createDataFrame([("p", "q", "correct", False), ("p", "d", "missing", True), ("r", "none", "wrong", False), (None, "q", "near", False)], "paper string, column string, outcome string, unmatched boolean")
    groups = spark.createDataFrame([("q", f"g{i}") for i in range(1_500)] + [("d", "g7"), ("z", "empty"), ("q", "g7")], "column string, group string")
    got = {(r.paper, r["group"]): r for r in scoring.group_totals(cells, ["paper"], groups).collect()}
    assert len(got) == 3 * 1_501 and got["p", "g7"].correct == got["p", "g7"].missing_unmatched_rows == 1 and got["p", "g7"].recall == 0.5
    assert got[None, "g3"].near == 1 and sum(r.correct + r.wrong for r in got.values() if r.paper == "r") == 0 and got["p", "empty"].accuracy is None
    assert scoring.group_totals(cells.limit(0), ["paper"], groups).count() == 0 and scoring.group_totals(cells.limit(0), [], groups).count() == 1_501
    assert scoring.group_totals(cells, ["paper"], groups.limit(0)).count() == 0


def test_degrees_by_grammar():
    cases = {
        r"T_g = 25 ^\circ C": None, r"\Delta T = 5^{\circ}\mathrm{C}": "Δ T = 5 °C", r"ΔT=5 °K": "ΔT = 5 °K", r"(\approx -2.5 ^{\circ} C )": "(~-2.5 °C)", r"^{\circ}\mathrm{F}": "°F", r"1 0 0 ^ { 0 } \mathrm { C } .": "100 °C.",
        r"10^{3} C": None, r"100^{0}": None, r"20 – − 3 0 ^\circ": "20–-30 °", r"5 ^{\circ} C and": None, r"\alpha 5 ^\circ C": None, r"": None, r"3 . 5 ^\circ C": None, r"{7}{5}^\circ C": "75 °C", r"5^{00}^K": "5 °K", r"2^{0}1 ^\circ C": None,
    }
    assert {k: corpus.plain_degrees(k) for k in cases} == cases


def common(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def nearly(quote, text, cutoff=0.92):
    """By every stretch of the quote's length, and the shorter ones at the ends."""
    if len(quote) > len(text):
        quote, text = text, quote
    n = len(quote)
    stretches = {text[i : i + n] for i in range(len(text) - n + 1)} | {text[:k] for k in range(1, n)} | {text[-k:] for k in range(1, n)}
    sides = [(quote, stretches)]
    if len(quote) == len(text):
        sides.append((text, {quote[:k] for k in range(1, n)} | {quote[-k:] for k in range(1, n)}))
    return bool(n) and any(2 * common(q, w) >= cutoff * (len(q) + len(w)) - 1e-9 for q, ws in sides for w in ws)


def test_near_quotes_against_all_stretches():
    """Changes, gaps and insertions, at the ends too: what any stretch reaches is found, and nothing else."""
    draw, reached = random.Random(12), 0
    for trial in range(400):
        letters = draw.choice(["abcdefghijklmnop0123", "ab", "abc"])
        text = "".join(draw.choice(letters) for _ in range(draw.choice([20, 60, 120])))
        n = draw.randint(8, min(40, len(text)))
        begin = draw.choice([0, len(text) - n, draw.randrange(len(text) - n + 1)])
        quote = list(text[begin : begin + n])
        for _ in range(draw.randint(0, max(1, n // 9))):
            at, kind = draw.randrange(len(quote)), draw.random()
            quote[at : at + 1] = [] if kind < 0.3 else [quote[at], draw.choice(letters)] if kind < 0.6 else [draw.choice("xyz")]
        quote = "".join(quote)
        if draw.random() < 0.1:
            quote, text = text, quote
        want = nearly(quote, text)
        assert quotes_.stands_nearly(["zzzzzzzzz", quote, quote[:8]], text, 0.92) - {0, 2} == ({1} if want else set()), (quote, text)
        reached += want
    assert 100 < reached < 390


def test_quotes_of_repeated_documents(spark, monkeypatch):
    """One row a quote: the best over documents of its id; many quotes of one document go in runs."""
    docs = spark.createDataFrame([("d", "The host matrix was dried"), ("d", "at eighty degrees for two days"), ("d", None), (None, "The host matrix was dried")], "id string, t string")
    quotes = spark.createDataFrame([("d", "host matrix was"), ("d", "eighty degrees for"), ("d", "eighty degreez for two days"), ("d", "nowhere at all"), (None, "host matrix was")] + [("d", f"no such words {i}") for i in range(40)], "id string, quote string")
    monkeypatch.setattr(quotes_, "RUN_QUOTES", 10)
    got = [(r.quote, r.found) for r in corpus.verify_quotes(quotes, docs, "t", "id").collect()]
    assert len(got) == 45 and sorted(x for x in got if x[1] != "none") == [("eighty degrees for", "exact"), ("eighty degreez for two days", "near"), ("host matrix was", "exact")]


def test_pages_of_quotes_as_searched_plainly():
    draw = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "be", "x"]
    for _ in range(200):
        pages = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 30))) for _ in range(5)]
        asked = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 9))) for _ in range(8)] + [""]
        want = []
        for q in asked:
            legs = [q, " ".join(q.split(" ")[:6])]
            want.append(tuple(next((i for i, p in enumerate(pages) if len(x) >= 12 and x in p), None) for x in legs))
        assert quotes_.first_pages(asked, pages) == want


def test_degrees_and_figures_of_repeated_rows(spark):
    """Null and repeated ids, and null texts: a row for every row, each with its own text."""
    text = r"at $70 ^{\circ} \mathrm{C}$ then $2 0 ^{0} C$ and $x$"
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (1, None, "b"), (None, text, "c"), (2, "none", "d"), (1, "$5 ^{\\circ} C$", "e")], "id int, t string, n_marks string")
    got = sorted((r.n_marks, r.t, r.n_degrees, r.n_inferred) for r in corpus.normalise_degrees(df, "t", "id").collect() if r.t is not None)
    plain = "at 70 °C then 20 °C and $x$"
    assert got == [("a", plain, 2, 1), ("a", plain, 2, 1), ("c", plain, 2, 1), ("d", "none", 0, 0), ("e", "5 °C", 1, 0)]
    assert corpus.normalise_degrees(df, "t", "id").count() == 6 and corpus.normalise_degrees(df.limit(0), "t").count() == 0
    docs = spark.createDataFrame([(1, "a ![x](p) b", "k"), (1, "c ![y](p) ![z](q) d", "l"), (1, None, "m"), (None, "![x](p)", "n"), (2, "![x](p)", "o"), (1, "no marks", "p")], "id int, t string, path string")
    figures = spark.createDataFrame([(1, "p", "new"), (None, "p", "never")], "id int, key string, to string")
    out = corpus.rewrite_figures(docs, figures, "t", "id", "key", "to")
    assert out.columns == docs.columns
    assert sorted((r.path, r.t) for r in out.collect()) == [("k", "a ![x](new) b"), ("l", "c ![y](new) ![z](q) d"), ("m", None), ("n", "![x](p)"), ("o", "![x](p)"), ("p", "no marks")]


def test_sources_of_repeated_documents(spark):
    """Points keep their number; of documents of one id the earliest page part counts."""
    text = "start\n<!-- page 1 of 3 -->\nnothing\n<!-- page 2 of 3 -->\nThe samples were dried in vacuum\n"
    docs = spark.createDataFrame([("d", text), ("d", text), ("d", "<!-- page 3 of 3 -->\nThe samples were dried in vacuum"), ("d", None), (None, text)], "id string, t string")
    points = spark.createDataFrame([("d", 1, "samples were dried"), ("d", 1, "samples were dried"), ("d", 2, None), (None, 3, "samples were dried"), ("d", 4, "absent words here")], "id string, point int, quote string")
    points = points.selectExpr("id", "point", "'text' AS kind", "CAST(NULL AS STRING) AS label", "2 AS page", "quote")
    got = sorted((r.point, r.found_page) for r in corpus.resolve_sources(points, docs, "t", "id").collect())
    assert got == [(1, 3), (1, 3), (2, 2), (3, 2), (4, 2)]


def test_quotes_of_odd_rows(spark):
    docs = spark.createDataFrame([("d", "The host matrix was dried for two days"), ("e", None)], "id string, t string")
    quotes = spark.createDataFrame([("d", 1, "host matrix was"), ("d", 1, "host matrix was"), ("d", 2, None), ("e", 3, "host matrix was"), (None, 4, "host matrix was"), ("zz", 5, "host matrix was"), ("d", 6, "")], "id string, t int, quote string")
    got = sorted((r.t, r.found) for r in corpus.verify_quotes(quotes, docs, "t", "id").collect())
    assert got == [(1, "exact"), (1, "exact"), (2, "none"), (3, "none"), (4, "none"), (5, "none"), (6, "none")]


def test_compared_parsers(spark):
    docs = spark.createDataFrame([(1, "a", "p", "x 1.5 y 2.5"), (2, "b", "p", "x 1.5 y"), (3, "a", "q", "same 3.5"), (4, "b", "q", "same 3.5")], "id int, mode string, paper string, text string")
    out = pipelines.compare_parsers(docs, "text", "id", "mode", "paper", ("a", "b"))
    assert {r.paper: (r.similarity, r.only_a, r.only_b) for r in out["pairs"].collect()} == {"p": (77.8, 1, 0), "q": (100.0, 0, 0)}
    r = out["summary"].first()
    assert (r.only_a, r.only_b, r.n, r.median_similarity) == (1, 0, 2, pytest.approx(88.9))
    assert out["metrics"].count() == 4


def test_deep_pages(spark, monkeypatch):
    df = spark.createDataFrame([(i, i * 7919 % 503) for i in range(503)], "i int, v int").repartition(4)
    order = [F.col("v").desc(), F.col("i")]
    shallow = [r.v for r in explore.page(df, 9, 20, order)[0].collect()]
    monkeypatch.setattr(explore, "DEEP", 100)
    deep, info = explore.page(df, 9, 20, order)
    assert [r.v for r in deep.collect()] == shallow == list(range(342, 322, -1)) and deep.columns == df.columns
    assert tuple(info.first()) == (503, 26, 9, 161, 180)


def test_identifiers_must_differ(spark):
    df = spark.createDataFrame([("Tg (C)", 1), ("TG c", 2), ("Mass", 3), ("Mass", 4), (None, 5)], "label string, i int").withColumn("id", c.snake_id("label"))
    assert src.require_unique(df.filter("i <> 2"), "id", "label").count() == 4
    with pytest.raises(Exception, match="not unique: tg_c"):
        src.require_unique(df, "id", "label").collect()


def test_batches_of_a_large_search(spark):
    rows = [(i, "big" if i % 10 else None, i * 31 % 97) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, s string, v int").repartition(5)
    got = {r.i: r.batch for r in graph.batches(df, "s", 40, [F.col("v").desc(), F.col("i")]).collect()}
    for name in ("big", None):
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (-r[2], r[0]))
        assert all(got[r[0]] == n // 40 for n, r in enumerate(own))
    assert graph.batches(df.limit(0), "s", 40, [F.col("i")]).count() == 0
