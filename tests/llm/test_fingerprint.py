import hashlib
import random

import numpy as np
import pytest

from labtables.llm import fingerprint as f


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["the", "on", "er", "é", "ti", "ß"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def test_a_text_alone_or_among_others():
    texts = ["", "a", "aaaaaaaa", prose(50, 1), "ab", prose(400, 2), "", prose(50, 1)]
    together = f.signatures(texts)
    for t, s in zip(texts, together):
        assert (f.signatures([t])[0] == s).all() and len(s) <= f.SIZE and (np.diff(s.astype(np.int64)) > 0).all()
        assert bool(len(s)) == bool(t)


def names_at(text, level):
    names, first = f.mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32) + f.ODD), np.zeros(len(text), bool)
    first[0] = True
    for _ in range(level):
        names, first = f.phrases(names, first)
    return names.tolist()


def test_equal_substrings_share_interior_names_whatever_the_offset():
    core = prose(300, 3)
    for level in (1, 2, 3):
        inside = names_at(core, level)
        for pad in ("", "x", "yz", "some other words " * 7):
            there = names_at(pad + core + pad, level)
            margin = 8
            run = inside[margin:-margin]
            assert any(there[i : i + len(run)] == run for i in range(len(there) - len(run) + 1))


def test_likeness():
    a, b = f.signatures([prose(600, 4), prose(600, 5)])
    assert f.likeness(a, a) == 1 and f.likeness(a, b) < 0.2
    none = np.zeros(0, np.uint32)
    assert f.likeness(none, none) == 1 and f.likeness(a, none) == 0
    near = f.signatures([prose(600, 4).replace("the", "hte", 2)])[0]
    assert f.likeness(a, near) > 0.8


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_as_one_list(spark, partitions):
    draw = random.Random(partitions)
    rows = [(k, None if k % 17 == 0 else prose(draw.randint(0, 60), k % 9), "x") for k in draw.sample(range(-50, 500), 40)] + [(7777, "same", "x"), (7777, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").repartition(4)
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in f.edited_report(df, partitions=partitions).collect())
    ordered = sorted(rows, key=lambda r: -r[0])
    want = []
    for (k, text, _), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = text or "", after or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b = f.signatures([t, u])
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f.written_out(a), f.likeness(a, b)))
    assert got == sorted(want)


def scrambled(x):
    x &= 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def toss(names):
    """Labels under 8 by three coin tosses, symbol by symbol."""
    def one(own, left):
        bit = (own ^ left) & -(own ^ left)
        place = bit.bit_length() - 1
        return 2 * place + (own >> place & 1)

    labels = [one(x, names[i - 1] if i else x ^ 1) for i, x in enumerate(names)]
    for _ in range(2):
        labels = [one(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
    return labels


def plain_signature(text):
    """The fingerprint of one text by a parse of its own, character by character."""
    odd, step = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
    names, hashes = [scrambled(ord(c) + odd) for c in text], set()
    for level in (1, 2, 3):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        symbols = [scrambled(x ^ n * odd) if n > 1 else x for x, n in runs]
        labels, phrases = toss(symbols), []
        for i, x in enumerate(symbols):
            if i == 0 or (0 < i < len(symbols) - 1 and labels[i - 1] > labels[i] < labels[i + 1]):
                phrases.append([])
            phrases[-1].append(x)
        names = [scrambled(sum(scrambled(x) * pow(step, k % 64, 2**64) for k, x in enumerate(p)) + len(p) * odd) for p in phrases]
        if level > 1:
            hashes |= {scrambled(x ^ level) >> 32 for x in names}
    return sorted(hashes)[:64] if text else [], hashes if text else set()


def plain_likeness(a, b):
    both = sorted({*a, *b})[:64]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


@pytest.mark.parametrize("partitions", [1, 4])
def test_as_an_independent_parse(spark, partitions):
    """All columns against a parse without the module's functions, edited texts included."""
    draw = random.Random(8)
    texts = ["", None, "a", "ab", "aaaa" * 30, "abababab" * 9, "é🎉 ü" * 12, *(prose(draw.randint(1, 120), k) for k in range(12)), prose(30, 3), prose(30, 3)]
    rows = [(k, t) for k, t in zip(draw.sample(range(400), len(texts)), texts)]
    got = {r.doc_id: r for r in f.edited_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), partitions=partitions).collect()}
    ordered = sorted(rows, reverse=True)
    as_hex = lambda s: "".join(f"{x:08x}" for x in s)
    for (k, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = text or "", after or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b, c = (plain_signature(x)[0] for x in (t, edited, u))
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_hex(a), as_hex(b))
        assert (r.near_edited, r.near_next) == (plain_likeness(a, b), plain_likeness(a, c))


def test_error_of_the_estimate():
    """The lowest 64 hashes against all phrases: a standard error of 1/16 at most."""
    errors = []
    for k in range(60):
        a = prose(1200, k)
        b = a[: len(a) * (k % 10) // 10] + prose(1200, 1000 + k)
        x, y = plain_signature(a), plain_signature(b)
        exact = len(x[1] & y[1]) / len(x[1] | y[1])
        errors.append(plain_likeness(x[0], y[0]) - exact)
    assert max(map(abs, errors)) < 0.22 and abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.0626


def test_edges(spark):
    one = spark.createDataFrame([(None, "abc def ghi")], "doc_id long, text string")
    r = f.edited_report(one).collect()[0]
    assert r.doc_id is None and r.near_next == 1 and r.n_chars == 11
    assert f.edited_report(one.limit(0)).count() == 0
    assert f.fingerprint(one).collect()[0].fingerprint == r.fingerprint


def test_an_id_that_many_rows_have(spark):
    """Rows without ids are dealt over many ranges, and still make one ring."""
    rows = [(None, prose(5 + k % 7, k)) for k in range(200)] + [(k, prose(4, 500 + k)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = f.with_neighbours(df, "doc_id", "text", 12)
    sizes = [r["count"] for r in dealt.filter("tail = 0").withColumn("p", f.F.spark_partition_id()).groupBy("p").count().collect()]
    assert sum(sizes) == 260 and max(sizes) < 60
    got = f.edited_report(df, partitions=12).collect()
    again = f.edited_report(df, partitions=1).collect()
    plain = lambda rows_: sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.near_next)) for r in rows_)
    assert len(got) == 260 and plain(got) == plain(again)


def test_range_numbers():
    cuts = f.range_cuts([3, 5, 5, 5, 9])
    assert [k for k, _ in cuts] == [3, 5, 5, 5, 9]
    k, d = np.array([2, 3, 5, 5, 5, 6, 9]), np.array([0, 0, f.LEAST, 0, 2**63 - 1, 0, 7])
    assert f.range_numbers(cuts, k, d).tolist() == [0, 1, 2, 3, 4, 4, 5]
    assert f.range_numbers([], k, d).tolist() == [0] * 7
