import hashlib
import os
import random
import zlib

import duckdb
import pytest

from labtables.llm import manifest as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, tree string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lowered=False):
    text = row[4] and row[4].translate(str.maketrans(m.UPPER, m.LOWER)) if lowered else row[4]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes):
    """The root of nodes in order, and for each its lists of left and right siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i - i % 16
            paths[k].append((nodes[start:i], nodes[i + 1 : start + 16]))
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    root, above = climb([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for r, path in zip(groups[s], trees[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(r, hit)
            for left, right in path + up:
                folded = sha(*left, folded, *right)
            proof = sha(*(x for left, right in path + up for x in left + right))
            out.append((r[0], leaf(r), trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, draw, sources):
    texts = [None, "", "A b", "lower only", "É Ünï", "x" * 50_000 + "Z"]
    return [(i, draw.choice(sources), draw.choice(["en", None]), draw.choice([None, i]), draw.choice(texts + [f"Text {i}"]), "clash", "clash") for i in range(n)]


CASES = {
    "one": [(5, None, None, None, None, "c", "c")],
    "ties": [(None, "a", "en", 1, "T", "c", "c")] * 40 + [(7, "a", "en", 1, t, "c", "c") for t in ("T", "t", "T")] + [(7, None, "en", 1, "T", "c", "c")],
    "sixteen": [(i, "a", "en", 1, "T", "c", "c") for i in range(16)] + [(i, "b", "en", 1, "T", "c", "c") for i in range(17)],
    "hot": rows_of(700, random.Random(1), ["hot"] * 20 + ["ü", "z", None, "A", ""]),
    "many_sources": rows_of(400, random.Random(2), [f"s{i}" for i in range(300)]),
}


@pytest.mark.parametrize("case", CASES)
def test_as_brute_force(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = m.dataset_manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_several_rounds(spark):
    """Over 256 blocks of the lowest round need a third one."""
    rows = [(i, "one", "en", i % 7, f"Text {i}" if i % 3 else "low", "c", "c") for i in range(70_000)]
    got = sorted(map(tuple, m.dataset_manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_empty_table(spark):
    assert m.dataset_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    for case in ("hot", "many_sources"):
        documents = spark.createDataFrame(CASES[case], SCHEMA).drop("root", "tree").toPandas()
        documents["n_chars"] = documents["n_chars"].astype("Int64")
        with duckdb.connect() as c:
            c.register("documents", documents)
            assert sorted(c.sql(m.oracle()).fetchall(), key=str) == brute(CASES[case])


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{folder}/documents.parquet'")
        want = sorted(c.sql(m.oracle()).fetchall())
    assert sorted(map(tuple, m.dataset_manifest(spark.read.parquet(f"{folder}/documents.parquet")).collect())) == want
