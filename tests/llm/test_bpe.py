import random
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from labtables.llm import bpe
from labtables.llm.common import tokenizer_path

PATH = tokenizer_path(bpe.DEFAULT_FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


CASES = ["", " ", "Hello, World!", "it's 12 o'clock now", "x" * 3000, "ÀÉ ça é ΣΑΣ İI", "<|endoftext|>a<|startoftext|> b<|END", "a\x1cb\x85c d", "日本語 テスト 🎉🎉", "'S 'T don'T", "²½ⅷ x_y"]


@pytest.mark.parametrize("text", CASES)
def test_as_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = bpe.encode_text(PATH, text.encode()).tolist()
    assert got == want
    assert bpe.model_of(PATH).decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_code_point(library):
    points = [c for c in range(1, 0x32000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = ["".join(f"a{chr(c)}B{chr(c)}{chr(c)}1 " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    bad = [i for i, (t, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))) if bpe.encode_text(PATH, t.encode()).tolist() != e.ids]
    assert not bad, [hex(points[i * 64]) for i in bad[:20]]


def test_long_words_merge_alike():
    model, draw = bpe.model_of(PATH), random.Random(5)
    for n in (2, 17, 399, 400):
        word = bytes(draw.choice(b"abcdehinort") for _ in range(n))
        ids = [model.inner[b] for b in word]
        ids[-1] = model.final[word[-1]]
        assert model._merge_long(ids) == model.merge(word)


def test_matrix_merges_as_one_word():
    model, draw = bpe.model_of(PATH), random.Random(6)
    words = [bytes(draw.choice(b"abcdehinort,") for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.merge_all(words)] == [model.merge(w) for w in words]


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "the cat", "z"), (3, "the cat", "z")], "doc_id long, text string, ids string")
    rows = sorted(bpe.bpe_encode(df).collect())
    assert [len(r.ids) for r in rows] == [0, 0, 2, 2]
    decoded = sorted(bpe.bpe_decode(bpe.bpe_encode(df)).collect())
    assert decoded[2].decoded == "the</w> cat</w>"
    trip = {r.doc_id: r for r in bpe.bpe_round_trip(df).collect()}
    assert trip[1].ids_sha256 == trip[2].ids_sha256 and trip[3].n_tokens == 2
    assert bpe.bpe_round_trip(df.limit(0)).count() == 0


def test_as_little_endian():
    assert encode_bytes("a b") == np.array(bpe.encode_text(PATH, b"a b"), "<u4").tobytes()


def encode_bytes(text):
    return bpe.encode_text(PATH, text.encode()).tobytes()
