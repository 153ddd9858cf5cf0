import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from labtables.llm import packing as p
from labtables.llm.bpe import DEFAULT_FILE
from labtables.llm.common import tokenizer_path


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 15, 16, 17, 23, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_007, dtype=np.uint64).astype(np.uint32)
    data = p.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (p.unpack(data, len(ids), bits) == ids).all()
    assert (p.unpack(data, 100, bits, 9_001) == ids[9_001:9_101]).all()


def test_frame_random_access():
    ids = np.arange(20_000, dtype=np.uint32) % 49_408
    frame = p.Frame(p.frame_image([7, None, 9], np.array([5, 0, 19_995]), ids, 17))
    assert frame.doc_ids == [7, None, 9] and frame.starts.tolist() == [0, 5, 5, 20_000]
    assert (frame.ids(4_000, 9_000) == ids[4_000:9_000]).all() and len(frame.ids(3, 3)) == 0
    with pytest.raises(ValueError):
        p.Frame(b"x" * 64)


def test_bits():
    assert [p.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_as_the_library(spark, tmp_path):
    draw = random.Random(3)
    texts = [None, "", " \n", "The cat's 12 <|endoftext|> ÀÉÇ é***", "same", "same"] + [" ".join(draw.choice(["Ab", "cde,", "f", "é"]) for _ in range(draw.randint(0, 400))) for _ in range(60)]
    rows = [(i * 7 % 66, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = {r.doc_id: r for r in p.packed_digests(df, f"file://{tmp_path}/ids", partitions=3, frame_ids=500).collect()}
    library, start = Tokenizer.from_file(tokenizer_path(DEFAULT_FILE)), 0
    for key, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert p.packed_digests(df, f"file://{tmp_path}/none").count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    """Many rows of one id are dealt over several files, and each keeps its own ids."""
    rows = [(None, f"word{i} x" if i % 9 else None) for i in range(120)] + [(5, "a b"), (5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"file://{tmp_path}/ids"
    got = p.packed_digests(df, folder, partitions=6).collect()
    assert len(got) == 122 and p.read_frames(spark, folder).select("shard").distinct().count() > 3
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and [s[2] for s in spans[-2:]] == [5, 5]
    library = Tokenizer.from_file(tokenizer_path(DEFAULT_FILE))
    want = sorted(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == want
