import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from labtables.llm import recompression as rc

SCHEMA = "doc_id long, text string, slice string, names string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Each window's smallest id, and the words of the windows that have a smaller one."""
    place = [rc.LAST_ID if r[0] is None else r[0] for r in rows]
    words = [WORD.findall(r[1] or "") for r in rows]
    least = {}
    for p, ws in zip(place, words):
        for i in range(len(ws) - rc.WINDOW + 1):
            w = tuple(ws[i : i + rc.WINDOW])
            least[w] = min(p, least.get(w, p))
    out = []
    for r, p, ws in zip(rows, place, words):
        gone = set()
        for i in range(len(ws) - rc.WINDOW + 1):
            if least[tuple(ws[i : i + rc.WINDOW])] < p:
                gone |= set(range(i, i + rc.WINDOW))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((r[0], len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120, vocabulary=40):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "中文", " ", "\x1c", "ａ", "a"]
    fresh = lambda k: [draw.choice(words) + (str(draw.random()) if draw.random() < 0.3 else "") for _ in range(k)]
    passages = [fresh(k) for k in (12, 13, 14, 30, 200)] + [["a"] * k for k in (12, 13, 40)] + [["x", "y"] * 20, ["x", "x", "y"] * 9]
    texts = [None, "", " \n\t", "one two", "A" * 100_000, " ".join(["same"] * 500)]
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(1, 5)):
            parts += fresh(draw.randint(0, 40)) if draw.random() < 0.6 else draw.choice(passages)
        sep = draw.choice([" ", "  ", "\n", "\t \r\n"])
        texts.append(draw.choice(["", " "]) + sep.join(parts) + draw.choice(["", "\n"]))
    texts += [draw.choice(texts) for _ in range(20)]
    ids = [draw.choice([None, i, i, i, draw.randint(0, 9), -i]) for i in range(len(texts))]
    return [(i, t, "clash", "clash") for i, t in zip(ids, texts)]


@pytest.mark.parametrize("seed,slice_bytes,bucket_names", [(1, rc.SLICE_BYTES, rc.BUCKET_NAMES), (2, 6_000, 300), (3, 1, 50)])
def test_as_brute_force(spark, seed, slice_bytes, bucket_names):
    rows = corpus(seed)
    got = rc.kept_words(spark.createDataFrame(rows, SCHEMA).repartition(4), slice_bytes=slice_bytes, bucket_names=bucket_names)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert sum(r[2] for r in brute(rows)) > 100


def test_text_that_stays(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, f"a b\n{shared} c", "", ""), (2, f"x  {shared}\ty", "", ""), (3, "z", "", ""), (4, None, "", "")]
    got = {r.doc_id: r.kept_text for r in rc.kept_words(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    assert got == {1: f"a b {shared} c", 2: "x y", 3: "z", 4: ""}


def test_many_copies_of_one_text(spark):
    """A passage that most documents share stays in the first alone."""
    text = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"own{i} {text} end{i}", "", "") for i in range(3_000)]
    got = rc.kept_words(spark.createDataFrame(rows, SCHEMA).repartition(8), slice_bytes=5_000)
    assert Counter(r.n_removed for r in got.collect()) == {0: 1, 50: 2_999}


def test_packed_rows():
    """What is stored and sent comes back, in seven tenths of its plain bytes at most."""
    draw = np.random.default_rng(3)
    for kind in ("<u4", "<u8", "<i8", "u1"):
        for n in (0, 1, 1000):
            x = draw.integers(0, 120, n).astype(kind)
            assert rc.unpacked(rc.packed(x), kind).tolist() == x.tolist()
    keys, buckets = draw.integers(0, 1 << 32, (1, 60_000), dtype=np.uint64), draw.integers(0, 3, 60_000).astype(np.int32)
    sending = rc.Sending(keys, buckets)
    batch = sending.rows(5, "<u4", np.zeros(len(sending.first), np.uint8))
    names, extras = batch.column("names").to_pylist(), batch.column("extra").to_pylist()
    assert sum(map(len, names)) < 0.7 * 4 * len(sending.first) and sum(map(len, extras)) < 1000
    for name, bucket in zip(names, batch.column("bucket").to_pylist()):
        assert np.cumsum(rc.unpacked(name, "<u4"), dtype=np.uint32).tolist() == sorted(set(keys[0, buckets == bucket].tolist()))
    bits, sizes = rc.in_two_documents([names[0], names[1], names[0]], [extras[0], extras[1], extras[0]])
    assert bits[: sizes[0]].all() and len(bits) == sum(sizes)


def test_symbols_are_locally_consistent():
    """A pair that a window decides has the same name wherever the window stands."""
    draw = random.Random(9)

    def part(words):
        known = {w: k for k, w in enumerate(dict.fromkeys(words))}
        codes = np.array([known[w] for w in words], "<u4")
        import pyarrow as pa

        return rc.Slice({
            "slice": 0, "n_words": len(words), "ids": np.zeros(1, "<i8").tobytes(), "nulls": b"\0", "counts": np.array([len(words)], "<i8").tobytes(),
            "codes": pa.compress(codes.tobytes(), "zstd", asbytes=True), "words": " ".join(known).encode(),
        })

    for trial in range(200):
        window = [draw.choice("abc" if trial % 2 else "abcdefghij") for _ in range(rc.WINDOW)]
        seen = []
        for _ in range(2):
            before, after = ([draw.choice("abcdefgh") for _ in range(draw.randint(0, 9))] for _ in range(2))
            name, low, high, _ = part(before + window + after).pairs()
            inside = (low >= len(before)) & (high <= len(before) + rc.WINDOW)
            seen.append(set(zip((low[inside] - len(before)).tolist(), name[inside].tolist())))
        assert seen[0] == seen[1]


def test_empty_table(spark):
    assert rc.kept_words(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, "", ""), (None, "  ", "", "")], SCHEMA)
    assert sorted(((r.n_words, r.n_removed, r.kept_sha256) for r in rc.kept_words(blank).collect())) == [(0, 0, hashlib.sha256(b"").hexdigest())] * 2


def test_sql(spark):
    rows = corpus(5)
    frame = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})
    with duckdb.connect() as c:
        c.register("documents", frame)
        assert sorted(c.sql(rc.ORACLE).fetchall(), key=str) == brute(rows)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, rc.kept_words(df, slice_bytes=50_000, bucket_names=5_000).collect()), key=str) == brute([tuple(r) for r in df.collect()])
