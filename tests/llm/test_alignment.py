import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from labtables.llm import alignment as al
from labtables.llm.bpe import byte_characters
from labtables.llm.common import tokenizer_path

A = Tokenizer.from_file(tokenizer_path(al.FILE_A))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=tokenizer_path(al.FILE_B))
BYTES = {c: i for i, c in enumerate(byte_characters())}


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def groups_of(text):
    """Groups of whole texts, as the definition has them."""
    if not text:
        return []
    a, b, whole = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text), (" " + text).encode()
    bytes_a = [bytes(BYTES[c] for c in A.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    out, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        m, n = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
        out.append((a[i:m], b[j:n]))
        i, j = m, n
    return out


def brute(rows):
    groups = [groups_of(t) for _, t, *_ in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for pairs in linked for p in pairs)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (key, *_), g, pairs in zip(rows, groups, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(pairs.values()),
            sum(n for p, n in pairs.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in pairs.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


def texts():
    draw = random.Random(4)
    blanks = [" ", "  ", "   ", "\n", "\n\n", " \n ", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " \xa0 ", " ", " ", "   ", " ", " ", " ", "　", "​", "﻿"]
    words = ["the", "Thing's", "don't", "é", "É", "naïve", "中文字", "😀", "👨‍👩‍👧", "x1y2", "123456", "...", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "aaaaaaaaaaaaa", "\x00", "ﬁ", "Å", "ꙮ", "ि", "á", "=" * 9, "µ", "©", "ʼs"]
    out = [None, "", " ", "   ", "\n", " a", "a ", "  a  ", "\x85 a", "\xa0", "▁", "a▁b", "▁ a", "　 x", "same", "same", "same text", "a" * 3000, "ab" * 2000, "é" * 700, " " * 500, "1" * 400, "\U0001f600" * 90]
    for _ in range(400):
        out.append("".join(draw.choice(words) + draw.choice(blanks + [" "] * 30 + [""] * 5) for _ in range(draw.randint(1, 30))))
    return out


SCHEMA = "doc_id long, text string, row string, pairs string"
ROWS = [(i * 7, t, "clash", "clash") for i, t in enumerate(texts())] + [(None, "null id", "c", "c"), (7, "id of another", "c", "c"), (7, "id of another", "c", "c")]


@pytest.mark.parametrize("bound", [al.BROADCAST_PAIRS, 40, 0])
def test_as_brute_force(spark, bound, monkeypatch):
    got = al.tokenizer_alignment(spark.createDataFrame(ROWS, SCHEMA).repartition(5), broadcast_pairs=bound)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_huge_groups_and_forgetting(monkeypatch):
    """Distinct ids of a group give what expanding its links gives, also when stretches are forgotten."""
    monkeypatch.setattr(al, "EXPANDED_LINKS", 1)
    model = al.Aligner(tokenizer_path(al.FILE_A), tokenizer_path(al.FILE_B))
    model.kept = 60
    some = [t or "" for t in texts()]
    assert al.KEPT_STRETCHES > len(model.slot)
    for start in range(0, len(some), 37):
        part = some[start : start + 37]
        figures, digests, owner, pairs, times = model.texts(part)
        for i, text in enumerate(part):
            g = groups_of(text)
            want = Counter((x, y) for a, b in g for x in a for y in b)
            mine = owner == i
            assert {(p // al.SIDE, p % al.SIDE): n for p, n in zip(pairs[mine].tolist(), times[mine].tolist())} == want
            assert figures[i].tolist() == [sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(want.values())]


def test_groups_written_at_once():
    """A batch's groups as text are what joining each group's ids gives."""
    model, draw = al.Aligner(tokenizer_path(al.FILE_A), tokenizer_path(al.FILE_B)), np.random.default_rng(6)
    for groups, stretches in ((1, 1), (7, 3), (400, 60)):
        cut_a, cut_b = np.cumsum(draw.integers(1, 5, groups)), np.cumsum(draw.integers(1, 5, groups))
        ids_a, ids_b = draw.integers(0, len(model.bytes_a), cut_a[-1]), draw.integers(0, len(model.bytes_b), cut_b[-1])
        at = np.sort(np.append([0, groups], 1 + draw.choice(groups - 1, stretches - 1, replace=False) if groups > 1 else []).astype(np.int64))
        side = lambda ids, cut: [",".join(map(str, x)) for x in np.split(ids, cut[:-1])]
        plain = list(map("|".join, zip(side(ids_a, cut_a), side(ids_b, cut_b))))
        assert model.written(ids_a, ids_b, cut_a, cut_b, at) == [";".join(plain[i:j]).encode() for i, j in zip(at.tolist(), at[1:].tolist())]


def test_whole_texts_where_tokenizers_need_them():
    cells, counts = al.stretches_of(["a b", "", "c d e"], parted=False)
    assert cells.to_pylist() == [" a b", " c d e"] and counts.tolist() == [1, 0, 1]
    cells, counts = al.stretches_of(["a b", "", "c  d　 e"])
    assert cells.to_pylist() == [" a", " b", " c", "  d　 e"] and counts.tolist() == [2, 0, 2]


def test_empty_table(spark):
    assert al.tokenizer_alignment(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, "c", "c"), (2, "", "c", "c")], SCHEMA)
    assert sorted(map(tuple, al.tokenizer_alignment(only).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, al.tokenizer_alignment(df).collect()), key=str) == brute(list(map(tuple, df.collect())))
