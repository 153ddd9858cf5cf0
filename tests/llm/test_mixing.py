import duckdb
import pytest

from labtables.llm import mixing

SF = "/root/testdata/sf0.001"


def test_word_count(spark):
    df = spark.createDataFrame([("a b\tc\x0b\x0cd e \x1cf",), ("",), (None,), (" \n",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(df.t)).collect()] == [5, 0, 0, 0]


def test_as_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    assert got == want
    words = {}
    for _, size, source_size, target, taken in got:
        assert taken in (0, size, 2 * size)
        words[source_size, target] = words.get((source_size, target), 0) + taken
    biggest = max(r[1] for r in got)
    assert all(abs(v - t) <= 2 * biggest for (_, t), v in words.items())


def test_odd_rows(spark):
    rows = [(1, "a b c", None, 9), (1, "a b c", None, 9), (2, None, "s", 9), (3, "", "s", 9), (None, "x", "t", 9), (4, "y " * 50, "u", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 6 and sum(r.size for r in plan) == 57
    assert {r.source_size for r in plan} == {6, 0, 1, 50}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in plan)
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_clashing_names_and_equal_rows(spark):
    """Columns named as the operator's own, a map column, and many rows without ids."""
    rows = [(None, "w " * (k % 3 + 1), "s", {"a": k % 2}, k) for k in range(40)] + [(k, "x y z", "t" if k % 2 else None, {"a": 1}, k) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row map<string,int>, copies int").repartition(5)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 60 and all(r.taken in (0, r.size, 2 * r.size) for r in plan)
    mixed = mixing.mix_documents(docs)
    out = mixed.collect()
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in out) == sum(r.taken for r in plan)
    assert max(sum(r.copies == k and r.doc_id is None for r in out) for k in range(40)) <= 2
    again = mixing.mix_documents(docs.repartition(2)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 3], [0, 0], [7]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "src string, size long")
    got = {r.src: r.target for r in mixing.source_targets(df, "src", 1.5, (5, 2, 1)).collect()}
    want, left, budget = {}, {f"s{i}": (n, (5, 2, 1)[i % 3]) for i, n in enumerate(sizes)}, 1.5 * sum(sizes)
    while left:
        level = budget / sum(w for _, w in left.values())
        full = [s for s, (n, w) in left.items() if level * w >= 2 * n]
        if not full:
            want |= {s: level * w for s, (_, w) in left.items()}
            break
        for s in full:
            want[s] = 2.0 * left[s][0]
            budget -= want[s]
            del left[s]
    assert got == pytest.approx(want)
