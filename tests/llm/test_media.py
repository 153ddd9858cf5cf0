import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

from labtables.llm import media as m


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
WAV = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4) + b"abcd"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04ab\xff\xda\x00\x02xx\xff\xd9"
GZIP = gzip.compress(b"hello", mtime=0)
PDF = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    return out.getvalue()


FILES = {"image/png": PNG, "image/gif": GIF, "image/bmp": BMP, "audio/wav": WAV, "image/jpeg": JPEG, "application/gzip": GZIP, "application/pdf": PDF, "application/zip": zipped()}


def test_each_format_is_found_with_its_length():
    for kind, data in FILES.items():
        assert m.carve(data) == [(0, len(data), kind)], kind
        assert m.carve(b"junk " + data + b" junk") == [(5, len(data), kind)], kind
        assert not any(k == kind for _, _, k in m.carve(data[: len(data) * 2 // 3])), kind


def test_false_magic():
    assert m.carve(b"BM GIF89a RIFFxxxxWAVE PK\x03\x04 OggS ftyp fLaC %PDF- \x89PNG") == []
    assert m.sniff(PNG[:-1] + b"\0", "image/png") == ("image/png", False, [])


def test_correction_and_nesting(spark):
    rows = [(1, GIF, "image/png"), (2, b"text", "text/plain"), (3, None, None), (4, b"", "x"), (5, b"..." + PNG + GIF, "a/b"), (5, b"..." + PNG + GIF, "a/b")]
    df = spark.createDataFrame(rows, "k long, media binary, media_type string")
    got = sorted(m.sniff_media(df, "k", "media", "media_type", True).collect(), key=lambda r: r.k)
    assert [(r.k, r.media_type, r.corrected) for r in got] == [(1, "image/gif", True), (2, "text/plain", False), (3, None, False), (4, "x", False), (5, "a/b", False), (5, "a/b", False)]
    assert [bytes(c.bytes) for c in got[4].carved] == [PNG, GIF]
    assert m.sniff_media(df.limit(0), "k", "media", "media_type").count() == 0


def test_round_trip(spark):
    texts = [None, "", "a", "é" * 96, "x" * 193, "BM GIF89a " * 3000, "a", "RIFF\x28\0\0\0WAVEfmt "]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in m.media_features(m.text_media(df)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(payload) + 44
        assert r.feature.startswith("audio/wav!;")
    assert got[2].feature == got[6].feature and got[2].media_sha256 == got[6].media_sha256


def test_feature_as_computed_plainly(spark):
    """Samples, mean, root mean square, zero crossings and carved media of the payload, one by one."""
    texts = ["", "abc", "é" * 300, "".join(chr(32 + i * 7 % 90) for i in range(1000)), "GIF89a and more", "x" * 191, "~" * 193]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in m.media_features(m.text_media(df)).collect():
        raw = texts[r.doc_id].encode()
        wave = [b - 128 for b in raw.ljust(max(192, -(-len(raw) // 192) * 192))]
        n = len(wave)
        mean = sum(wave) * 1000 // n
        root = int((sum(x * x for x in wave) * 1_000_000 // n) ** 0.5)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(wave, wave[1:]))
        assert r.feature == f"audio/wav!;{n};{mean};{root};{crossings};"
        stored = WAV[:4] + struct.pack("<I", n + 36) + WAV[8:40] + struct.pack("<I", n) + bytes(x + 128 for x in wave)
        assert (r.media_sha256, r.media_bytes) == (hashlib.sha256(stored).hexdigest(), len(stored))


def test_media_carved_in_a_payload(spark):
    """A file inside the samples is named with its place; a text of any length keeps its bytes."""
    text = "pad " * 10 + PDF.decode() + " tail " + "y" * 300_000
    r = m.media_features(m.text_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0]
    assert r.feature.endswith(f";application/pdf@40+{len(PDF)}") and r.n_bytes == len(text)


AVI = b"RIFF" + struct.pack("<I", 14) + b"AVI LIST" + struct.pack("<I", 1) + b"x\0"
MP4 = b"\0\0\0\x10ftypisom\0\0\0\0\0\0\0\x08mdat"
OGG = b"OggS\0" + bytes(21) + b"\x01\x05hello"


def test_more_formats():
    for kind, data in {"video/avi": AVI, "video/mp4": MP4, "audio/ogg": OGG}.items():
        assert m.carve(b"ab" + data) == [(2, len(data), kind)], kind


def test_time_is_in_proportion_to_the_bytes():
    """Magic numbers, headers and trailers that lead nowhere, over and over."""
    units = [bytes(before) + magic for magic, before, _ in m.MAGIC]
    units += [b"\0\0\0\x08ftyp", b"%PDF-%%EOF", b"%PDF-startxref%%EOF", b"PK\x03\x04PK\x05\x06", b"RIFF\x20\0\0\0WAVE", b"RIFF\0\x10\0\0WAVEabcd\0\0\0\0"]
    units += [b"GIF89a" + b"\x21" * 7, b"GIF89a" + bytes(5) + b"!!\x01", b"\xff\xd8\xff\xc0\0\x02", b"\xff\xd8\xff\xc0\0\x02\xff\xda\0\x02"]
    for unit in units:
        small, large = (unit * (n // len(unit)) for n in (100_000, 800_000))
        took = []
        for data in (small, large):
            began = time.process_time()
            m.carve(data)
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.5, unit


def test_ten_megabytes_of_each_kind():
    for unit in (b"PK\x03\x04", b"%PDF-", b"\0\0\0\x08ftyp"):
        assert m.carve(unit * (10_000_000 // len(unit))) == []


def plain_chunks(data, at, end):
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + size % 2
    return at


def test_riff_chunks_as_walked_plainly():
    draw = random.Random(6)
    for _ in range(300):
        data = b"".join(b"abcd" + struct.pack("<I", draw.choice([0, 0, 1, 2, 3, 8, 40])) + bytes(draw.choice([0, 0, 2, 4])) for _ in range(60))
        chunks = m.Chunks(data)
        for _ in range(20):
            at, end = sorted(draw.randrange(len(data)) for _ in range(2))
            assert chunks.end(at, end) == plain_chunks(data, at, end)


def test_marks_of_one_walk_keep_others_right():
    """Unfinished files before, after and around whole ones hide none of them."""
    draw, every = random.Random(2), [*FILES.values(), AVI, MP4, OGG]
    broken = [f[: len(f) - 3] for f in every] + [b"\xff\xd8\xff\xe0\0\x04ab", b"\0\0\0\x08ftyp", b"GIF89a" + bytes(7)]
    for _ in range(500):
        parts = [draw.choice(every) if draw.random() < 0.4 else draw.choice(broken) for _ in range(draw.randint(1, 8))]
        data = b"".join(parts)
        alone = [(at, n, k) for at in range(len(data)) for k in m.VALIDATORS if (at, k) in m.Scan(data).hits and (n := m.VALIDATORS[k](m.Scan(data), at)) > 0]
        want, reach = [], {}
        for at, n, kind in alone:
            if at >= reach.get(kind, 0):
                want.append((at, n, kind))
                reach[kind] = at + n
        assert m.carve(data) == sorted(want, key=lambda x: (x[0], -x[1], x[2]))
