import zlib

import numpy as np

from labtables.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.language_report(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = np.mean([r.lang_pred == r.lang for r in held])
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in rows)


def plain_scores(model, text):
    """A forward pass over one text with dictionaries and loops."""
    letters = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text]
    letters = [x if c.isalpha() else 0 for x, c in zip(letters, text)]
    padded, total, n = [0, *letters, *[0] * 8], [0.0] * len(model.languages), 0
    for length in langid.LENGTHS:
        for i in range(len(letters) + 1):
            gram = padded[i : i + length]
            if not all(gram if length < 3 else gram[1:-1]):
                continue
            h = 0x9E3779B1 * length & 0xFFFFFFFF
            for c in gram:
                h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            row = model.table[(h * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS)]
            total, n = [a + float(b) for a, b in zip(total, row)], n + 1
    logits = [x / max(n, 1) / model.temperature for x in total]
    e = [np.exp(x - max(logits)) for x in logits]
    return dict(zip(model.languages, (x / sum(e) for x in e)))


def test_as_a_plain_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(400)
    model = langid.fit_language_model(docs, train_rows=40, calibration_rows=20)
    rows = [("x y z", 1), ("É a ß-Straße 12", 2), *((r.text, 100 + i) for i, r in enumerate(docs.limit(25).collect()))]
    got = {r.doc_id: r for r in langid.predict_language(spark.createDataFrame([(i, t) for t, i in rows], "doc_id long, text string"), model).collect()}
    for text, i in rows:
        want = plain_scores(model, text or "")
        if got[i].lang_pred != langid.UNDETERMINED:
            assert abs(got[i].score - max(want.values())) < 1e-6 and abs(want[got[i].lang_pred] - max(want.values())) < 1e-6
        assert got[i].rejected == (got[i].lang_pred == langid.UNDETERMINED or got[i].score < model.bound)


def test_odd_rows(spark):
    """Null and repeated ids, a label of one row, names of the results among the columns."""
    rows = [(None, "the cat and the dog ran " + "on " * (k % 7), "en", "s") for k in range(60)] + [(k % 3, "der hund und die katze gehen", "de", "s") for k in range(60)]
    rows += [(k, f"le chat et le chien {'ou ' * (k % 9)}", "fr", "s") for k in range(40)] + [(900, None, "xx", None), (901, "???", "yy", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    first = langid.language_report(df).collect()
    assert len(first) == len(rows) and sorted(map(str, first)) == sorted(map(str, langid.language_report(df.repartition(3)).collect()))
    assert {r.rejected for r in first if r.lang_pred == "und"} == {True} and len({r.bound for r in first}) == 1
    model = langid.fit_language_model(df)
    out = langid.predict_language(df, model, keep=("lang", "score"))
    assert out.columns == ["doc_id", "lang", "lang_pred", "score", "rejected"] and out.count() == len(rows)
    sample = langid.labelled_sample(df, "doc_id", "text", "lang", {"all": (langid.F.lit(True), 5)})["all"]
    found = {x: sum(r[0] == x for r in sample) for x in ("en", "de", "fr")}
    assert found["en"] == found["fr"] == 5 and 1 <= found["de"] <= 3  # de has three different rows


def test_whole_features():
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q" for i in range(17_000))
    at, share = langid.text_features(text)
    assert len(at) > 20_000 and abs(share.sum() - 1) < 1e-3


def test_many_languages(spark):
    """Over a hundred languages are all learnt and told apart, from embeddings."""
    names = [f"l{i:03}" for i in range(120)]
    word = lambda i, k: "".join(chr(97 + (i * 7 + k * 3 + j * (i % 5 + 1)) % 26) for j in range(5 + k % 3))
    rows = [(k * 120 + i, " ".join(word(i, (k * 11 + m) % 9) for m in range(30)), name) for i, name in enumerate(names) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language_model(df)
    assert model.languages == names and model.table.shape[1] == langid.DIMENSIONS
    got = langid.predict_language(df, model, keep=("lang",)).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_bounded_sample(spark, monkeypatch):
    """A language's documents end where its share of n-grams does, the first one aside."""
    rows = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    take = lambda: langid.labelled_sample(df, "doc_id", "text", "lang", {"all": (langid.F.lit(True), 50)})["all"]
    whole = take()
    assert len(whole) == 60
    monkeypatch.setattr(langid, "SAMPLE_NGRAMS", 2 * sum(len(r[1]) for r in whole[:3]))
    some = take()
    assert {r[0] for r in some} == {"a", "b"} and 2 <= len(some) < 20
    monkeypatch.setattr(langid, "SAMPLE_NGRAMS", 1)
    assert [r[0] for r in take()] == ["a", "b"]


def test_sample_holds_the_features(spark):
    """Vectors come to the driver packed, in half of their plain bytes at most, and are the texts' features to the bit."""
    draw = np.random.default_rng(2)
    rows = [(i, " ".join("".join(draw.choice(list("etaoinshr"), 6)) for _ in range(300)), "ab"[i % 2]) for i in range(30)]
    pack = langid.packed
    texts = {t: langid.text_features(t) for _, t, _ in rows}
    assert all(2 * (len(pack(np.diff(a, prepend=np.int32(0)))) + len(pack(s))) < 8 * len(a) for a, s in texts.values())
    got = langid.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", {"all": (langid.F.lit(True), 50)})["all"]
    assert len(got) == 30 and {str(a.dtype) + str(s.dtype) for _, a, s in got} == {"int32float32"}
    assert sorted((a.tolist(), s.tolist()) for _, a, s in got) == sorted((a.tolist(), s.tolist()) for a, s in texts.values())


def test_calibrated_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit_language_model(docs)
    assert model.notes["accuracy"] > 0.97
    out = langid.predict_language(docs, model)
    assert out.filter("rejected").count() <= 0.01 * docs.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (4, "ελληνικά κείμενο που δεν γνωρίζει"), (5, "é" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict_language(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].rejected and got[1].score == 0
    assert got[4].lang_pred in model.languages and got[4].score < 0.9
    assert langid.predict_language(odd.limit(0), model).count() == 0


def test_batches_do_not_matter():
    rows = [(lang, *langid.text_features(t)) for lang, t in [("a", "the cat and the dog"), ("b", "der hund und die katze")] * 5]
    model = langid.train(rows, rows)
    texts = ["the dog", "", "die katze, 12", "the cat\nand"]
    alone = [model.predict([t]) for t in texts]
    assert model.predict(texts) == ([a[0][0] for a in alone], [a[1][0] for a in alone])
    assert model.predict(["the dog and the"])[0] == ["a"]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.language_report(docs).collect()] == ["und", "und"]
