import hashlib
import math
import random
import re

import duckdb
import pandas as pd

from labtables.llm import secret_scan as s


def base_spans(text):
    """The base kinds by plain matching: every match is consumed, short ones are dropped."""
    out = []
    for k, (name, pattern) in enumerate([("assign", s.ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]):
        for m in re.finditer(pattern, text, re.ASCII):
            if (len(m[2]) >= 6) if name == "assign" else len(m[0]) >= (20 if name == "access" else 24):
                out.append((m.start(), k, name, m.end()))
    return sorted(out)


def entropy_spans(text):
    out = []
    for k, c in enumerate(s.ENTROPY_CLASSES):
        for m in re.finditer(c.pattern, text):
            if any(re.search(a, m[0]) for a in s.ALLOWED):
                continue
            terms, hot = s.entropy_terms(c.window), []
            for i in range(len(m[0]) - c.window + 1):
                w = m[0][i : i + c.window]
                if sum(terms[w.count(x)] for x in set(w)) <= math.floor((math.log2(c.window) - c.bits) * c.window * s.SCALE):
                    hot.append(i)
            if hot:
                out.append((m.start() + hot[0], 3 + k, c.name, m.start() + hot[-1] + c.window))
    return out


def texts():
    draw = random.Random(11)
    alphabet = "abcdefABCDEF0123456789+/_=- "
    bits = ["password=", "PASSWD: '", "api_key = \"", "apikey=abc", "secret:token:abcdefg", "token=token=abcdefgh", "AKIA" + "Q7" * 9, "AKIAAKIA" + "Z" * 11, "deadbeef" * 4, "é🎉", "\n", "ſecret=longenough", "0123456789abcdef" * 3, "x" * 40, "Zm9vYmFyQmF6MTIzNDU2Nzg5MGFiY2RlZg==", "A" * 30 + "b3dE5gH7jK9mN1pQ3sT5vW7" + "A" * 30]
    made = ["".join(draw.choice(bits) if draw.random() < 0.2 else "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(0, 30))) for _ in range(150)]
    return [None, "", " ", *bits, "a1 " + "Ab3dE5gH7jK9mN1pQ3sT5vW7 " * 400, *made]


def test_as_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in s.secret_report(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        base = base_spans(text or "")
        line = lambda xs: ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(xs))
        r = got[i]
        assert r.spans == line(base + entropy_spans(text or "")), text
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in base) for k in ("assign", "access", "hex"))


def test_redaction(spark):
    rows = [(1, "my token=abcdef1234 é end"), (2, "clean"), (3, None), (4, "token=" + "deadbeef0123" * 3 + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(s.redact_secrets(df).select("doc_id", "text").collect())
    assert got == {1: "my [secret] é end", 2: "clean", 3: None, 4: "[secret]!"}
    assert s.redact_secrets(df.limit(0)).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = s.secret_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_secrets_beside_other_parts(spark):
    """Random secrets in assignments and addresses: none may stay because of what stands beside it."""
    draw = random.Random(5)
    make = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    hexa, safe = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    letters = safe[:-2]
    kinds = [("X-Sig=", hexa, 64, 0.99), ("X-Sig=", hexa, 32, 0.93), ("example_app/key=", letters, 24, 0.99), ("your_", letters, 40, 0.99), ("at ", safe, 22, 0.92)]
    rows = [(k * 1000 + i, begin + make(alphabet, n)) for k, (begin, alphabet, n, _) in enumerate(kinds) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in s.redact_secrets(df).collect()}
    # the report has what is redacted
    assert {r.doc_id for r in s.secret_report(df).filter("spans <> ''").collect()} == {i for i, t in got.items() if "[secret]" in t}
    shares = [sum("[secret]" in got[k * 1000 + i] for i in range(300)) / 300 for k in range(len(kinds))]
    assert all(share >= kind[3] for share, kind in zip(shares, kinds)), shares
    plain = ["your_api_key_here_12345678", "https://site.org/docs/2024/example/some-long-title/part/2", "0123456789ABCDEF0123456789ABCDEF", "123e4567-e89b-12d3-a456-426614174000", "/usr/share/placeholder/words/of/paths/12", "example" * 20]
    kept = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert dict(s.redact_secrets(kept).select("doc_id", "text").collect()) == dict(enumerate(plain))
    long = spark.createDataFrame([(1, "Ab3dE5gH7jK9mN1pQ3sT5vW7" * 20_000), (2, "xxxx" * 100_000)], "doc_id long, text string")
    assert [r.text for r in s.redact_secrets(long).orderBy("doc_id").collect()] == ["[secret]", "xxxx" * 100_000]


def test_parts_as_brute_force_and_sql(spark):
    """Runs with words of examples in them, overlapping ones too: by plain matching, and by the SQL."""
    draw = random.Random(7)
    bits = ["example", "EXAMPLE", "examplexample", "placeholder", "your_", "dummyour_", "xxxxx", "XXxx", "0123456789", "abcdefghijk", "k=", "/", "-", "_", "=", "+", " ", "é", "aB3" * 9, "zY8x" * 6, "Q7wE" * 6, "F00DCAFE9182" * 2, "f00dcafe", "deadBEEF" * 4, "123e4567-e89b-12d3-a456-426614174000", "some/path/2024/to"]
    made = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 9))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate([*texts(), "k=example/" + "aB3" * 9 + "q/Example=" + "zY8x" * 9 + "your_" + "Q7wE" * 6, *made])]
    found = {r.doc_id: r for r in s.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(base_spans(t or "") + entropy_spans(t or ""))) for i, t in rows}
    assert {i: r.spans for i, r in found.items()} == want and sum("entropy" in x for x in want.values()) > 200
    # long s and the Kelvin sign are no letters of a keyword for one engine and are for another
    plain = [(i, t) for i, t in rows if not t or not re.search("[ſK]", t)]
    with duckdb.connect() as c:
        c.register("documents", pd.DataFrame(plain, columns=["doc_id", "text"]))
        result = c.sql(s.oracle())
        assert result.columns == list(next(iter(found.values())).asDict())
        assert {r[0]: r for r in result.fetchall()} == {i: tuple(found[i]) for i, _ in plain}


def test_long_runs(spark):
    """Runs of 1 MB of each class: none may end in the JVM's stack, and each has a defined result."""
    size = 1_000_000
    runs = ["a1/" * (size // 3), "-" * size, "=" * size, "Ab3dE5gH7jK9mN1pQ3sT5vW7+/" * (size // 26), "0123456789abcdef" * (size // 16), "ab_" * (size // 3), "F00DCAFE9182" * (size // 12), "password=" + "x" * size, "AKIA" + "Q7" * (size // 2)]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in s.secret_report(df).collect()}
    assert [got[i].spans for i in (0, 1, 2, 5)] == ["", "", "", ""]
    assert got[3].spans == f"entropy_base64:0:{len(runs[3])}" and got[4].spans.startswith(f"hex:0:{len(runs[4])}")
    assert (got[7].n_assign, got[8].n_access) == (1, 1)
    clean = dict(s.redact_secrets(df).select("doc_id", "text").collect())
    assert clean[3] == "[secret]" and clean[4] == "[secret]" and clean[1] == runs[1] and clean[5] == runs[5]


def test_many_spans(spark):
    """Touching, nested and separate spans by the ten thousand, beside a plain version."""
    text = " é ".join(f"{i:032x} token=abcdef{i}" for i in range(12_000))
    rows = [(1, text, 5), (1, text, 6), (2, "", 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __spans int")
    got = s.redact_secrets(df).collect()
    assert s.redact_secrets(df).columns == df.columns and sorted(r["__spans"] for r in got) == [5, 6, 7, 8]
    assert next(r.text for r in got if r["__spans"] == 5) == " é ".join(["[secret] [secret]"] * 12_000)
    assert [r.text for r in got if r["__spans"] > 6] == ["", None]
    assert s.secret_report(df.limit(0)).count() == 0
