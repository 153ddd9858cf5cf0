import hashlib
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    from labtables.llm import ngram_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, seen = docs.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = docs
    assert seen["language_id"].count() >= 0.99 * rows
    groups = ngram_join.ngram_components(seen["language_id"])
    assert seen["near_duplicates"].count() == groups.select("component_id").distinct().count()
    clean = {r.doc_id: r.text for r in seen["near_duplicates"].collect()}
    for r in seen["secrets"].collect():
        assert r.n_chars == len(r.text)
        assert r.text == clean[r.doc_id] or "[secret]" in r.text
        assert not re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text)
    assert seen["secrets"].count() == len(clean)
    size = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert size(seen["mixing"]) == pytest.approx(1.5 * size(seen["secrets"]), rel=0.02)
    out = corpus_pipeline.STAGES[-1][1](spark, seen["mixing"], SF)
    assert out.count() == seen["mixing"].count()


def test_run(spark):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_odd_rows(spark):
    """Nulls in each column, empty and long texts, repeated rows, null ids, and extra columns with the
    operators' own names, through each stage by itself."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select(*corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame(
        [(None, "the cat and the dog went on", "en", None, 27), (None, "the cat and the dog went on", "en", None, 27), (9001, None, "en", "s", None), (9002, "", None, "s", 0), (9003, " \n", "en", None, 2), (9004, "a1/" * 60_000, None, "s", 180_000), (9004, "token=abcdef0123456789abcdef0123", "en", "s", 31)],
        docs.schema,
    )
    rows = docs.unionByName(odd).withColumns({"k": F.lit(1), "row": F.lit("x"), "score": F.lit("y"), "__spans": F.lit(2), "rejected": F.lit(None).cast("boolean"), "m": F.create_map(F.lit("a"), F.lit(1))})
    n = rows.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = out.collect()
        assert stage(spark, rows.limit(0), SF).count() == 0
    texts = lambda name, doc_id: [r.text for r in kept[name] if r.doc_id == doc_id]
    assert texts("language_id", 9001) == texts("language_id", 9002) == texts("language_id", 9003) == []
    assert len(texts("language_id", None)) in (0, 2)
    assert len(texts("near_duplicates", None)) == 1 and len(texts("near_duplicates", 9004)) == 2 and texts("near_duplicates", 9001) == [None]
    assert len(kept["secrets"]) == n and texts("secrets", 9001) == [None] and sorted(texts("secrets", 9004)) == ["[secret]", "a1/" * 60_000]
    assert not {9001, 9002, 9003} & {r.doc_id for r in kept["mixing"]}
    last = corpus_pipeline.STAGES[-1][1]
    coded = last(spark, rows, SF).collect()
    assert len(coded) == n and {r.n_tokens for r in coded if r.doc_id in (9001, 9002, 9003)} == {0}
    assert last(spark, rows.limit(0), SF).count() == 0


def plain_language(model, text):
    """Whether a document goes, by a forward pass with loops."""
    from .test_langid import plain_scores

    return not any(c.isalpha() for c in text or "") or max(plain_scores(model, text).values()) < model.bound


def plain_redacted(text):
    from .test_secret_scan import base_spans, entropy_spans

    if text is None:
        return None
    out, at = [], 0
    covered = []
    for start, _, _, end in sorted(base_spans(text) + entropy_spans(text)):
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    for start, end in covered:
        out += [text[at:start], "[secret]"]
        at = end
    return "".join([*out, text[at:]])


def plain_mix(rows):
    """(id, text) as often as weighted fair queueing takes them, copy by copy."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    left, open_, target = 1.5 * sum(total.values()), {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}, {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level >= 2 * total[s]]
        for s in full or list(open_):
            target[s] = 2.0 * total[s] if full else open_[s] * level
        left -= sum(target[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in target}
    copies = []
    for number, s in enumerate(sources):
        own = sorted(((hashlib.md5(f"42|{k}".encode()).hexdigest(), k, size(t), t) for k, t, x in rows if x == s), key=lambda r: r[:3])
        for turn in (0, 1):
            done = turn * total[s]
            for h, k, n, t in own:
                done += n
                if target[s] > 0:
                    copies.append((done / target[s], number, h, k, n, t))
    out, taken = [], 0
    for *_, k, n, t in sorted(copies, key=lambda c: c[:5]):
        taken += n
        if taken > 1.5 * sum(total.values()):
            break
        out += [(k, t)] * (n > 0)
    return out


def test_all_stages_as_brute_force(spark):
    """The rows of run(): each stage by plain loops on what the plain stage before it kept. Only the fitted
    numbers of the language model are taken from the library."""
    from tokenizers import Tokenizer

    from labtables.llm import langid
    from labtables.llm.bpe import DEFAULT_FILE
    from labtables.llm.common import tokenizer_path

    from .test_ngram_join import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    model = langid.fit_language_model(docs)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if not plain_language(model, r.text)]
    assert len({k for k, _, _ in rows}) == len(rows)
    firsts = {k for _, k, n, component in brute([(k, t) for k, t, _ in rows]) if component == k or not n}
    rows = [(k, plain_redacted(t), s) for k, t, s in rows if k in firsts]
    library = Tokenizer.from_file(tokenizer_path(DEFAULT_FILE))
    want = []
    for k, text in plain_mix(rows):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want) and len(want) > 150


def test_documents_of_earlier_stages_go(spark, monkeypatch):
    """A stage's documents are removed when the next one's are written; the last ones stay for the result."""
    import os

    made, write = [], corpus_pipeline.written

    def seen(df, what):
        made.append(write(df, what))
        return made[-1]

    monkeypatch.setattr(corpus_pipeline, "written", seen)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage{k}", lambda s, docs, d: docs.select("doc_id", "text")) for k in range(4)])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [os.path.exists(df.written_at.removeprefix("file://")) for df in made] == [False, False, True]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
