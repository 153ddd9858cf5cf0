import json

import pytest
from pyspark.sql import functions as F

from labtables.plans import pipelines
from labtables.sources import tables
from labtables.streaming import ingest


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb"\n\n2,\n')
    got = sorted((r.x, r.y or "") for r in tables.read_strict_csv(spark, str(tmp_path / "a.csv"), ["x", "y"]).collect())
    assert got == [("1", "a\nb"), ("2", "")]
    (tmp_path / "b.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception):
        tables.read_strict_csv(spark, str(tmp_path / "b.csv"), ["x", "y"]).collect()


def test_repair_bytes(spark):
    rows = [(1, "Ünïc".encode()), (2, b"caf\xe9 \x93q\x94 \x81"), (3, None), (4, "é".encode() + b"\xff")]
    got = {r.i: r.b for r in tables.repair_bytes(spark.createDataFrame(rows, "i int, b binary"), "b").collect()}
    assert got == {1: "Ünïc", 2: "café “q” \x81", 3: None, 4: "éÿ"}


def test_headers_and_import(spark):
    registry = spark.createDataFrame([("tg", "Tg (C)"), ("name", "Polymer"), ("polymer", "Other")], "id string, label string")
    headers = spark.createDataFrame([(" tg  (c)", 0), ("POLYMER", 1), ("Tg (C)", 2), ("zzz", 3)], "header string, position int")
    assert {r.position: r.id for r in tables.match_headers(headers, registry).collect()} == {0: "tg", 1: "name", 2: None, 3: None}
    raw = spark.createDataFrame([("1", " a "), ("x", ""), ("n/a", "b")], "`T g` string, P string")
    df, report = tables.import_table(raw, {"tg": ("T g", "numeric"), "name": ("P", "text")}, 2)
    assert sorted((r.tg or 0, r.name or "") for r in df.collect()) == [(0, ""), (0, "b"), (1, "a")]
    assert tuple(report.first()) == (3, 1, "too-many-rows")
    with pytest.raises(ValueError, match="missing columns: q"):
        tables.require_columns(raw, ["P", "q"])


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "x\ny", "z​")], "i int, s string, t string").coalesce(1)
    tables.write_csv(df, str(tmp_path / "out"), {"i": "Id", "s": "S (u)", "t": "T"}, clean=True)
    text = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert text.replace("\r\n", "\n").splitlines()[:2] == ["Id,S (u),T", '1,"a,""b""",'] and text.endswith("z\r\n")


def test_runs_and_replay(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "extraction.json").write_text(json.dumps({"paper_id": "p1", "formulations": [{"a": 1}, {"a": 2}]}))
    papers = spark.createDataFrame([("p1",), ("p2",)], "paper_id string")
    got = sorted((r.paper_id, r.status, r.position or 0) for r in tables.read_runs(spark, str(tmp_path), papers, "a:double").collect())
    assert got == [("p1", "ok", 0), ("p1", "ok", 1), ("p2", "no_extraction", 0)]
    calls = spark.createDataFrame([("p", "values", True, '{"values":[{"id":"F1","value":"3"}]}', 1), ("p", "values", False, "{}", 2), ("p", "values", True, " ", 3)], "paper string, stage string, ok boolean, raw_text string, seq int")
    assert [(r.id, r.value) for r in tables.replay_calls(calls, "id:string,value:string").collect()] == [("F1", "3")]


def test_stream_imports_once(spark, tmp_path):
    a, b = "a" * 32, "b" * 32
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"record_id": r, "v": 1}) for r in (a, a, "bad")))
    run = lambda: ingest.import_stream(ingest.watch_records(spark, str(tmp_path / "in"), "record_id string, v int"), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in" / "2.json").write_text("\n".join(json.dumps({"record_id": r, "v": 2}) for r in (a, b)))
    run()
    assert sorted((r.record_id, r.v) for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [(a, 1), (b, 2)]


def test_import_counts_and_restarts(spark, tmp_path):
    """Repeats within and between batches, a restart in between, unreadable lines, and ids held elsewhere."""
    (tmp_path / "in").mkdir()
    name = lambda i: f"{i:032x}"
    held = spark.createDataFrame([(name(3),)], "record_id string")

    def run():
        query = ingest.import_stream(ingest.watch_records(spark, str(tmp_path / "in"), "record_id string, v int"), str(tmp_path / "store"), str(tmp_path / "ck"), held)
        query.awaitTermination()
        return ingest.import_counts(query)

    for batch, ids in enumerate([(1, 2, 2, 3), (2, 4, 1), (5,)]):
        lines = [json.dumps({"record_id": name(i), "v": batch}) for i in ids] + ["{broken", json.dumps({"record_id": "short"})]
        (tmp_path / "in" / f"{batch}.json").write_text("\n".join(lines))
        counts = run()
        assert counts == {"seen": len(ids) + 2, "unreadable": 1, "badly_named": 1, "stored": {0: 2, 1: 1, 2: 1}[batch]}
    stored = spark.read.parquet(str(tmp_path / "store")).collect()
    assert sorted((r.record_id, r.v) for r in stored) == [(name(1), 0), (name(2), 0), (name(4), 1), (name(5), 2)]


def test_checks_of_a_build(spark):
    raw = spark.createDataFrame([(0, "1", "x"), (1, "2", "y"), (2, "n/a", "x")], "i int, a string, c string")
    checks = {"rows": (F.count(F.lit(1)), 3), "filled": (F.count("a"), 3)}
    with pytest.raises(ValueError, match="filled: 2, not 3"):
        pipelines.build_dataset(raw, ["a"], ["c"], "i", checks=checks)
    built = pipelines.build_dataset(raw, ["a"], ["c"], "i", checks=checks, fail=False)
    assert sorted(map(tuple, built["report"].collect())) == [("filled", "2", "3", False), ("rows", "3", "3", True)] and built["dataset"].count() == 3


def test_build_and_score(spark):
    raw = spark.createDataFrame([(0, "1", "x"), (1, "2", "y"), (2, "n/a", "x")], "i int, a string, c string")
    built = pipelines.build_dataset(raw.withColumn("b", F.col("a")), ["a", "b"], ["c"], "i")
    assert built["categories"].count() == 2 and built["correlations"].filter("label_a = 'a' and label_b = 'b'").first().n == 2
    rows = [("p", 1, "x", 10.0, 1.0), ("p", 2, "x", 20.0, 2.0), ("p", 3, None, 5.0, 3.0)]
    gold = spark.createDataFrame(rows, "paper string, id int, block string, q double, d double")
    classes = spark.createDataFrame([("q", "relative")], "column string, class string")
    groups = spark.createDataFrame([("q", "g"), ("d", "g")], "column string, group string")
    same = pipelines.score_run(gold, gold, ["paper"], "block", [("q", "q")], "id", "id", ["q", "d"], classes, groups)
    assert same["totals"].first().accuracy == 1 and same["totals"].first().recall == 1
    changed = pipelines.score_run(gold.filter("id <> 2").withColumn("d", F.col("d") * 10), gold, ["paper"], "block", [("q", "q")], "id", "id", ["q", "d"], classes, groups)
    total = changed["totals"].first()
    assert (total.correct, total.wrong, total.missing_unmatched_rows) == (2, 2, 2)


def test_compare_parsers(spark):
    docs = spark.createDataFrame([(1, "p", "a", "value 1.5 and 2.5"), (2, "p", "b", "value 1.5 and 3.5e2")], "doc int, paper string, mode string, text string")
    out = pipelines.compare_parsers(docs, "text", "doc", "mode", "paper", ("a", "b"))
    pair = out["pairs"].first()
    assert (pair.only_a, pair.only_b) == (1, 1) and 80 < pair.similarity < 100 and out["metrics"].count() == 2
